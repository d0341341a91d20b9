"""Joins on exact time, as-of joins over vintages, and key comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.checks import duplicate_keys, ensure_none
from tidegrid.functions.scalars import is_finite, number, revision_rank, same_cell
from tidegrid.functions.times import DAY, HOUR, calendar, elapsed_seconds, epoch, floor_to, instant, shift
from tidegrid.operators.scale import BUCKET, TimeFrame, salted_join
from tidegrid.operators.series import accepted, hourly_vintages

KEYS = ("series_id", "ts")


def build_silver(prices: DataFrame, load: DataFrame, generation: DataFrame, weather: DataFrame,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Hours present in all four sources; equal join keys let Spark keep one partitioning."""
    keys = list(keys)
    return prices.join(load, keys).join(generation, keys).join(weather, keys)


def join_monthly(df: DataFrame, monthly: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Attach the month's row to every row of that month, keeping rows without one."""
    dated = df.withColumn("month_start", F.date_trunc("month", ts))
    return salted_join(dated, monthly, [*keys, "month_start"], "left")


def value_at_offset(df: DataFrame, keys: Sequence[str], value: str, offset_s: int, out: str,
                    ts: str = "ts") -> DataFrame:
    """Value exactly ``offset_s`` seconds earlier, null when that time is absent."""
    past = df.select(*keys, shift(ts, offset_s).alias(ts), F.col(value).alias(out))
    return df.join(past, [*keys, ts], "left")


def attach_targets(issues: DataFrame, prices: DataFrame, keys: Sequence[str], value: str,
                   horizons: int = 24, step_s: int = HOUR, ts: str = "ts", how: str = "left") -> DataFrame:
    """One row per issue and horizon with the value observed at the target time."""
    grid = request_grid(issues.withColumnRenamed(ts, "issue"), horizons, step_s, "issue")
    observed = prices.select(*keys, F.col(ts).alias("target_ts"), F.col(value).alias("target_value"))
    return grid.join(observed, [*keys, "target_ts"], how)


def request_grid(cycles: DataFrame, horizons: int = 24, step_s: int = HOUR,
                 issue: str = "issue") -> DataFrame:
    """Every cycle with each of its horizons and target times."""
    return cycles.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn(
        "target_ts", shift(issue, F.col("horizon") * step_s)
    )


# --- vintages as of an issue time ---------------------------------------------

def effective_cycle(cycle: str = "collection_issue_time", acquired: str = "acquired_at_utc") -> Column:
    """The declared cycle, or the hour of acquisition for rows without one."""
    return F.coalesce(F.col(cycle), floor_to(acquired, HOUR))


def within_cycle(df: DataFrame, cycle: str = "collection_issue_time",
                 acquired: str = "acquired_at_utc") -> DataFrame:
    """Rows acquired within one hour of their (possibly derived) cycle."""
    age = elapsed_seconds(acquired, "effective_issue_time")
    return df.withColumn("effective_issue_time", effective_cycle(cycle, acquired)).filter(
        (age >= 0) & (age < HOUR)
    )


# Newest first: cycle, creation, numeric revision, acquisition, document.
def vintage_order(extra: Sequence[str] = ()) -> list[Column]:
    return [
        F.col("effective_issue_time"), F.col("source_created_at_utc"),
        revision_rank("revision_number").alias("_revision_rank"), F.col("acquired_at_utc"),
        F.col("document_id"), *[F.col(c) for c in extra],
    ]


def asof_latest(requests: DataFrame, vintages: DataFrame, keys: Sequence[str], order: Sequence[Column],
                payload: Sequence[str], *, step_s: int = HOUR, horizons: int = 24) -> DataFrame:
    """For each (key, issue, horizon) request the newest vintage whose cycle is not later.

    A request at horizon h sees the vintages made at least h steps before their
    target. So each vintage belongs to the slot min(steps before target,
    ``horizons``): vintages collapse to one per slot first (partial aggregation,
    so a hot target cannot build up), and a running maximum over at most
    ``horizons`` slots per target answers every request. No pair of a request
    and a vintage is ever formed.
    """
    keys = list(keys)
    lead = F.floor(elapsed_seconds("target_ts", "effective_issue_time") / step_s).cast("int")
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*payload).alias("p")))
    slots = (
        vintages.withColumnRenamed("target_timestamp", "target_ts")
        .withColumn("horizon", F.least(lead, F.lit(horizons)))
        .filter("horizon >= 1")
        .groupBy(*keys, "target_ts", "horizon")
        .agg(best.alias("_best"))
    )
    asked = requests.select(
        *keys, "target_ts", F.col("horizon").cast("int").alias("horizon"), "issue",
        F.lit(True).alias("_ask"),
    )
    both = asked.unionByName(slots, allowMissingColumns=True)
    # Value frames: a request sees the slots with the same or a larger lead.
    newest = Window.partitionBy(*keys, "target_ts").orderBy(F.desc("horizon")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    answered = both.withColumn("_best", F.max("_best").over(newest)).filter("_ask")
    return answered.select(
        *keys, "issue", "horizon", "target_ts", *[F.col(f"_best.p.{c}").alias(c) for c in payload]
    )


def asof_kinds(requests: DataFrame, vintages: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], order: Sequence[Column],
               payload: Sequence[str], *, step_s: int = HOUR, horizons: int = 24) -> DataFrame:
    """As ``asof_latest`` for several kinds at once: a struct of the payload for each kind, null without a vintage.

    The kinds are not spread over rows: a slot holds one conditional maximum
    for each, and one window per target answers for all of them.
    """
    keys = list(keys)
    lead = F.floor(elapsed_seconds("target_ts", "effective_issue_time") / step_s).cast("int")
    best = F.struct(F.struct(*order).alias("o"), F.struct(*payload).alias("p"))
    slots = (
        vintages.withColumnRenamed("target_timestamp", "target_ts")
        .withColumn("horizon", F.least(lead, F.lit(horizons)))
        .filter("horizon >= 1")
        .groupBy(*keys, "target_ts", "horizon")
        .agg(*[F.max(F.when(F.col(kind) == k, best)).alias(f"_best{n}") for n, k in enumerate(kinds)])
    )
    asked = requests.select(*keys, "target_ts", F.col("horizon").cast("int").alias("horizon"), "issue", F.lit(True).alias("_ask"))
    newest = Window.partitionBy(*keys, "target_ts").orderBy(F.desc("horizon")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(slots, allowMissingColumns=True)
    answered = both.withColumns({f"_best{n}": F.max(f"_best{n}").over(newest) for n in range(len(kinds))}).filter("_ask")
    return answered.select(*keys, "issue", "horizon", "target_ts", *[F.col(f"_best{n}.p").alias(k) for n, k in enumerate(kinds)])


def asof_prefer(requests: DataFrame, vintages: DataFrame, keys: Sequence[str], order: Sequence[Column],
                payload: Sequence[str], preference: Sequence[str] = ("A40", "A01"),
                *, step_s: int = HOUR, horizons: int = 24) -> DataFrame:
    """As ``asof_latest``, taking any vintage of the first process before the second."""
    ranks = F.create_map(*[
        F.lit(x) for i, name in enumerate(preference) for x in (name, -i)
    ])
    ranked = vintages.withColumn("_prefer", ranks[F.col("process_type")]).filter("_prefer IS NOT NULL")
    return asof_latest(requests, ranked, keys, [F.col("_prefer"), *order], payload,
                       step_s=step_s, horizons=horizons)


def exact_cycle(requests: DataFrame, weather: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Weather of exactly the issue cycle: newest acquisition, then model name."""
    newest = F.max(F.struct("acquired_at_utc", "model", F.struct(*payload).alias("p")))
    per_cycle = weather.groupBy(
        *keys, F.col("collection_issue_time").alias("issue"),
        F.col("target_timestamp").alias("target_ts"),
    ).agg(newest.alias("_w"))
    return requests.join(per_cycle, [*keys, "issue", "target_ts"], "left").select(
        *requests.columns, *[F.col(f"_w.p.{c}").alias(c) for c in payload]
    )


# How each technology is named in the exogenous frame, with its
# document type and the processes that may supply it, in order of preference.
TECHNOLOGIES = {
    "TOTAL_LOAD": ("load", "A65", ("A01",)),
    "TOTAL_GENERATION": ("generation", "A71", ("A01",)),
    "SOLAR": ("solar", "A69", ("A40", "A01")),
    "WIND_OFFSHORE": ("wind_offshore", "A69", ("A40", "A01")),
    "WIND_ONSHORE": ("wind_onshore", "A69", ("A40", "A01")),
}
PROVENANCE = (
    "process_type", "document_id", "revision_number", "source_created_at_utc",
    "effective_issue_time", "acquired_at_utc", "resolution",
)


def build_exogenous(cycles: DataFrame, features: DataFrame, prices: DataFrame, vintages: DataFrame,
                    weather: DataFrame, weather_values: Sequence[str], *,
                    technologies: Mapping[str, tuple] = TECHNOLOGIES, step_s: int = HOUR,
                    horizons: int = 24, hourly: bool = False) -> DataFrame:
    """Grid of cycle x horizon with issue features, target price and every forecast.

    ``vintages`` are source rows with a collection cycle: those acquired within
    their cycle are summed up to hours per vintage, and incomplete hours are
    rejected, before the as-of; ``hourly`` says that this is done already.
    Weather counts if it was acquired within its cycle, too. Each row carries ``reasons``, the parts that are missing; rows with an empty
    list form the dataset (``complete_rows``), the others are counted by
    ``reason_counts``. All technologies are selected by one as-of pass.

    ``features`` has (series_id, ts, ...); ``prices`` has (series_id, ts, price).
    """
    keys = ["series_id"]
    grid = request_grid(cycles.select("series_id", "issue").distinct(), horizons, step_s)
    issue_features = features.withColumnRenamed("ts", "issue").withColumn("_has_features", F.lit(True))
    targets = prices.select("series_id", F.col("ts").alias("target_ts"), F.col("price").alias("target_price"))

    allowed = F.create_map(*[
        F.lit(x) for name, (_, document, processes) in technologies.items()
        for i, process in enumerate(processes) for x in (f"{name}|{document}|{process}", -i)
    ])
    if not hourly:
        vintages = accepted(hourly_vintages(within_cycle(vintages)))
    age = elapsed_seconds("acquired_at_utc", "collection_issue_time")
    weather = weather.filter((age >= 0) & (age < HOUR))
    usable = vintages.withColumn(
        "_prefer", F.try_element_at(allowed, F.concat_ws("|", "technology", "document_type", "process_type"))
    ).filter("_prefer IS NOT NULL")
    payload = ["value_mw", *PROVENANCE]
    names = {name: f"_{label}" for name, (label, _, _) in technologies.items()}
    per_request = asof_kinds(grid, usable, keys, "technology", list(names), [F.col("_prefer"), *vintage_order(("value_mw", "process_type"))],
                             payload, step_s=step_s, horizons=horizons).withColumnsRenamed(names).drop("target_ts")
    weather_payload = [*weather_values, "collection_issue_time", "acquired_at_utc", "provider", "model"]
    sky = exact_cycle(
        grid, weather.withColumn("_has_weather", F.lit(True)), keys, [*weather_payload, "_has_weather"]
    ).select(
        *keys, "issue", "horizon", "_has_weather",
        *[F.col(c).alias(f"forecast_{c}") for c in weather_values],
        F.col("collection_issue_time").alias("weather_forecast_collection_issue_time"),
        F.col("acquired_at_utc").alias("weather_forecast_acquired_at_utc"),
        F.col("provider").alias("weather_forecast_provider"),
        F.col("model").alias("weather_forecast_model"),
    )
    frame = (
        grid.join(per_request, [*keys, "issue", "horizon"], "left")
        .join(sky, [*keys, "issue", "horizon"], "left")
        .join(issue_features, [*keys, "issue"], "left")
        .join(targets, [*keys, "target_ts"], "left")
    )
    labels = [label for label, _, _ in technologies.values()]
    value_name = {"generation": "forecast_total_generation_mw"}
    reasons = F.array_compact(F.array(
        F.when(F.col("_has_features").isNull(), "missing_issue_features"),
        F.when(number("target_price").isNull(), "missing_target_price"),
        *[F.when(F.col(f"_{x}.value_mw").isNull(), f"missing_{x}_forecast") for x in labels],
        F.when(F.col("_has_weather").isNull(), "missing_weather_forecast"),
    ))
    columns = {"reasons": reasons}
    for label in labels:
        columns[value_name.get(label, f"forecast_{label}_mw")] = F.col(f"_{label}.value_mw")
        for name in PROVENANCE:
            out = "collection_issue_time" if name == "effective_issue_time" else name
            if name == "process_type" and label in ("load", "generation"):
                continue
            columns[f"{label}_forecast_{out}"] = F.col(f"_{label}.{name}")
    if {"wind_offshore", "wind_onshore"} <= set(labels):
        columns["forecast_wind_total_mw"] = F.col("_wind_offshore.value_mw") + F.col("_wind_onshore.value_mw")
    columns.update(calendar("target_ts", "target_"))
    return frame.withColumns(columns).drop(
        "_has_features", "_has_weather", *[f"_{x}" for x in labels]
    )


def complete_rows(exogenous: DataFrame) -> DataFrame:
    return exogenous.filter(F.size("reasons") == 0).drop("reasons")


def distinct_cycles(frames: Sequence[DataFrame], column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null cycles over several tables."""
    parts = [f.select(*keys, F.col(column).alias("issue")).filter("issue IS NOT NULL") for f in frames]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.distinct()


# --- forecasts against what came true ------------------------------------------

PAIR_IDENTITY = ("series_id", "model_release", "forecast_issue_time", "horizon_hours")


def match_violations(history: DataFrame, actual: DataFrame, step_s: int = HOUR) -> DataFrame:
    """Forecast or observation rows that may not be scored, with the broken rule."""
    aligned = elapsed_seconds("target_timestamp", "forecast_issue_time") == F.col("horizon_hours") * step_s
    bad_rows = history.select(
        F.when(~is_finite("predicted_price_eur_mwh"), "prediction_not_finite")
        .when(~(F.col("horizon_hours").between(1, 24) & aligned), "target_alignment").alias("reason")
    ).filter("reason IS NOT NULL")
    bad_actual = actual.filter(~is_finite("price_eur_mwh")).select(F.lit("actual_not_finite").alias("reason"))
    twice = duplicate_keys(history, list(PAIR_IDENTITY)).select(F.lit("duplicate_forecast").alias("reason"))
    twice_actual = duplicate_keys(actual, ["series_id", "target_timestamp"]).select(
        F.lit("duplicate_actual").alias("reason")
    )
    return bad_rows.unionByName(bad_actual).unionByName(twice).unionByName(twice_actual)


def match_realized(history: DataFrame, actual: DataFrame, now, step_s: int = HOUR,
                   check: bool = False) -> DataFrame:
    """Pairs of a forecast issued before its target and the value that came true.

    Only hours that have ended by ``now`` count. Bias is predicted minus actual.
    """
    if check:
        ensure_none(match_violations(history, actual, step_s), "Forecasts cannot be scored")
    elapsed = actual.filter(shift("target_timestamp", step_s) <= instant(now)).select(
        "series_id", "target_timestamp", F.col("price_eur_mwh").alias("actual_price_eur_mwh")
    )
    issued = history.filter(
        (F.col("forecast_issue_time") < F.col("target_timestamp"))
        & (F.col("issued_at_utc") < F.col("target_timestamp"))
    )
    error = F.col("predicted_price_eur_mwh") - F.col("actual_price_eur_mwh")
    return (
        issued.join(elapsed, ["series_id", "target_timestamp"])
        .filter("predicted_price_eur_mwh IS NOT NULL AND actual_price_eur_mwh IS NOT NULL")
        .withColumns({"signed_error": error, "absolute_error": F.abs(error), "squared_error": error * error})
    )


def weekly_asof(rows: DataFrame, history: DataFrame, keys: Sequence[str] = ("series_id",),
                offset_s: int = 168 * HOUR, step_s: int = HOUR, horizons: int = 24) -> DataFrame:
    """Newest revision of the value one week before the target that was recorded by issue.

    ``rows`` has (issue, horizon, target_ts); ``history`` has (ts, available_at_utc, value).
    """
    revisions = history.select(
        *keys, shift("ts", offset_s).alias("target_timestamp"),
        F.col("available_at_utc").alias("effective_issue_time"), F.col("value").alias("weekly_value"),
    )
    return asof_latest(rows, revisions, keys, [F.col("effective_issue_time"), F.col("weekly_value")],
                       ["weekly_value"], step_s=step_s, horizons=horizons)


# --- comparing tables -----------------------------------------------------------

def overlap_conflicts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared keys whose cells differ beyond the tolerance, one row per cell."""
    keys = list(keys)
    columns = [c for c in a.columns if c not in keys and c in b.columns]
    shared = a.alias("a").join(b.alias("b"), keys)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("stored"),
            F.col(f"b.{c}").cast("string").alias("received"),
            same_cell(F.col(f"a.{c}"), F.col(f"b.{c}")).alias("same"),
        ) for c in columns
    ])
    return shared.select(*keys, F.inline(cells)).filter("NOT same").drop("same")


def overlapping_periods(periods: DataFrame, keys: Sequence[str], order: Sequence[str] = ("start_ts", "period_id"),
                        width_s: int = 64 * DAY) -> DataFrame:
    """Periods that start before an earlier period of their key has ended.

    Periods collapse to one row per start time; a running maximum of the end
    inside time buckets, carried on by a table with one row per bucket, then
    says how far the earlier starts reach. ``previous_end`` is the latest of
    these ends and of the first lasting period with the same start.
    """
    keys = list(keys)
    start, *ties = order
    # One row per start time: its latest end, and its first period that lasts.
    lasting = F.when(F.col("end_ts") > F.col(start), F.struct(*ties, "end_ts"))
    starts = periods.groupBy(*keys, start).agg(F.max("end_ts").alias("_end"), F.min(lasting).alias("_first"))
    starts = starts.withColumn(BUCKET, F.floor(epoch(start) / width_s))
    per_bucket = starts.groupBy(*keys, BUCKET).agg(F.max("_end").alias("_max"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.withColumn("_carried", F.max("_max").over(earlier)).drop("_max")
    local = Window.partitionBy(*keys, BUCKET).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    known = (
        starts.withColumn("_local", F.max("_end").over(local)).join(carried, [*keys, BUCKET])
        .select(*keys, start, "_first", F.greatest("_local", "_carried").alias("_before"))
    )
    follows = F.struct(*ties) > F.struct(*[F.col(f"_first.{c}").alias(c) for c in ties])
    same_start = F.when(follows, F.col("_first.end_ts"))
    return (
        periods.join(known, [*keys, start])  # the other side is as fine as the periods; no key is hot
        .withColumn("previous_end", F.greatest("_before", same_start))
        .filter(F.col("previous_end") > F.col(start))
        .drop("_before", "_first")
    )


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that the actual table does not have."""
    return expected.join(actual.select(*keys), list(keys), "left_anti")


def new_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return missing_keys(incoming, stored, keys)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.select(*b.columns).distinct().join(b, list(b.columns), "left_anti")


def stored_overlap(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key is delivered again.

    Taken first, so that checks and anti joins read this small part and the
    stored table is passed over once, without a shuffle where Spark finds the
    delivered keys small enough to broadcast.
    """
    return stored.join(incoming.select(*keys), list(keys), "left_semi")


def verify_receipts(history: DataFrame, receipts: DataFrame, window_s: int = 300,
                    check: bool = True) -> DataFrame:
    """History rows proved by a receipt with the same key and value, completed in
    the five minutes before the row was issued. Two such receipts are fatal."""
    keys = [*PAIR_IDENTITY, "target_timestamp", "predicted_price_eur_mwh"]
    delay = elapsed_seconds("issued_at_utc", "completed_at")
    matched = history.join(receipts.select(*keys, "completed_at"), keys).filter(
        (delay >= 0) & (delay <= window_s)
    )
    counted = matched.groupBy(*history.columns).agg(F.count("*").alias("receipts"))
    if check:
        ensure_none(counted.filter("receipts > 1"), "More than one receipt for a forecast row")
    return counted


def issuance_evidence(history: DataFrame, forecast: DataFrame, horizons: int = 24) -> DataFrame:
    """Issues proved by history: every horizon has the same target and value there,
    and all share one issuance time."""
    keys = ["series_id", "model_release", "forecast_issue_time"]
    stored = history.select(
        *keys, "horizon_hours", F.col("target_timestamp").alias("_target"),
        F.col("predicted_price_eur_mwh").alias("_value"), "issued_at_utc",
    )
    same = (
        (F.col("_target") == F.col("target_timestamp"))
        & (F.col("_value") == F.col("predicted_price_eur_mwh"))
        & (F.col("issued_at_utc") >= F.col("forecast_issue_time"))
        & (F.col("issued_at_utc") < F.col("target_timestamp"))
    )
    joined = forecast.select(*keys, "horizon_hours", "target_timestamp", "predicted_price_eur_mwh").join(
        stored, [*keys, "horizon_hours"], "left"
    )
    facts = joined.groupBy(*keys).agg(
        F.count_if(same).alias("matched"), F.countDistinct(F.when(same, F.col("issued_at_utc"))).alias("issuances"),
        F.min(F.when(same, F.col("issued_at_utc"))).alias("_issued"),
    )
    proven = (F.col("matched") == horizons) & (F.col("issuances") == 1)
    return facts.select(
        *keys, "matched", F.when(proven, "available").when(F.col("matched") == 0, "missing")
        .otherwise("no_matching_complete_issue").alias("evidence"),
        F.when(proven, F.col("_issued")).alias("issued_at_utc"),
    )


def compare_coverage(targets: DataFrame, source: DataFrame, stored: DataFrame, keys: Sequence[str],
                     value: str, now, overlap_s: int = 48 * HOUR, history_start=None,
                     ts: str = "ts") -> DataFrame:
    """Whether each target slot is present in the source and in the stored table, and
    whether the next overlapping request will read it again."""
    keys = list(keys)

    def state(df, name):
        flag = df.select(*keys, ts, F.when(is_finite(value), "PRESENT").otherwise("INCOMPLETE").alias(name))
        return flag

    latest = stored.groupBy(*keys).agg(F.max(ts).alias("_latest"))
    start = shift("_latest", -overlap_s)
    if history_start is not None:
        start = F.greatest(start, instant(history_start))
    end = floor_to(instant(now), HOUR)
    states = targets.select(*keys, ts).join(state(source, "source_state"), [*keys, ts], "left").join(
        state(stored, "stored_state"), [*keys, ts], "left")
    return (
        salted_join(states, latest, keys, "left")
        .select(
            *keys, ts,
            F.coalesce("source_state", F.lit("ABSENT")).alias("source_state"),
            F.coalesce("stored_state", F.lit("ABSENT")).alias("stored_state"),
            F.coalesce((F.col(ts) >= start) & (F.col(ts) < end), F.lit(False)).alias("overlap_revisits"),
        )
    )


def join_reference(regimes: DataFrame, reference: DataFrame,
                   keys: Sequence[str] = ("model_name", "validation_period", "price_regime")) -> DataFrame:
    """RMSE change in percent against an untuned reference, where that is positive."""
    base = reference.select(*keys, F.col("rmse").alias("untuned_reference_rmse"))
    gain = (F.col("untuned_reference_rmse") - F.col("rmse")) / F.nullif(
        F.col("untuned_reference_rmse"), F.lit(0.0)) * 100.0
    return regimes.join(base, list(keys), "left").withColumn(
        "rmse_improvement_vs_untuned_pct", F.when(F.col("untuned_reference_rmse") > 0, gain)
    )


# --- features of an issue hour from separate sources ------------------------------

def issue_features(prices: DataFrame, load: DataFrame, generation: DataFrame, weather: DataFrame,
                   now, max_age_s: int = 3 * HOUR, keys: Sequence[str] = ("series_id",),
                   ts: str = "ts") -> DataFrame:
    """The newest fresh hour per series whose lags, rolls, generation and weather are complete.

    Each source keeps its own timeline: a missing price hour empties only the
    price features that reach it. Hours not ended by ``now`` are never used.
    Only the last 168 hours before the freshness limit are read.
    """
    keys = list(keys)
    end = floor_to(instant(now), HOUR)
    fresh_from = shift(instant(now), -max_age_s)

    def recent(df, back_s):
        return df.filter((F.col(ts) >= shift(fresh_from, -back_s)) & (F.col(ts) < end))

    def history(df, value, prefix, lags, with_std):
        frame = TimeFrame(recent(df.select(*keys, ts, value), max(lags) * HOUR), keys, ts,
                          back_s=max(lags) * HOUR)
        columns = {f"{prefix}_lag_{h}h": frame.value_at(value, -h * HOUR) for h in lags}
        columns[f"{prefix}_rolling_mean_24h"] = frame.trailing(F.avg, value, 24, HOUR)
        if with_std:
            columns[f"{prefix}_rolling_std_24h"] = frame.trailing(F.stddev_samp, value, 24, HOUR)
        return frame.select(**columns).filter(F.col(ts) >= fresh_from)

    price = history(prices, "price_eur_mwh", "price", (1, 24, 168), True)
    demand = history(load, "load_mw", "load", (1, 24), False)
    joined = (
        price.join(demand, [*keys, ts])
        .join(renewable(recent(generation, 0), "nuclear_zero"), [*keys, ts])
        .join(recent(weather, 0), [*keys, ts])
        .withColumns(calendar(ts))
    )
    features = [c for c in joined.columns if c not in (*keys, ts)]
    complete = joined
    for name in features:
        complete = complete.filter(is_finite(name))
    newest = F.max(F.struct(F.col(ts), *[F.col(c) for c in features])).alias("_newest")
    return complete.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def renewable(df: DataFrame, policy: str = "strict") -> DataFrame:
    """Renewable generation and its share of all generation.

    ``strict``: null when any part is null. ``positive``: also null when the
    total is not above zero. ``nuclear_zero``: as strict, with nuclear null
    read as 0; ``context``: nuclear null as 0 and total above zero.
    """
    parts = [number(c) for c in ("solar_mw", "wind_total_mw", "biomass_mw", "hydro_mw")]
    other = [number(c) for c in ("lignite_mw", "gas_mw", "hard_coal_mw")]
    nuclear = number("nuclear_mw")
    if policy in ("nuclear_zero", "context"):
        nuclear = F.coalesce(nuclear, F.lit(0.0))
    green = parts[0] + parts[1] + parts[2] + parts[3]
    total = green + other[0] + other[1] + other[2] + nuclear
    share = green / F.nullif(total, F.lit(0.0))
    if policy in ("positive", "context"):
        share = F.when(total > 0, share)
    columns = {"renewable_generation_mw": green, "renewable_share": share}
    if policy == "context":
        columns["renewable_generation_mw"] = F.when(
            (other[0] + other[1] + other[2]).isNotNull(), green)
    if policy == "nuclear_zero":
        columns["nuclear_mw"] = nuclear
    return df.withColumns(columns)
