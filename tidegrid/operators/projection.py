"""Row-wise rules: coercion, contracts, vocabularies, cleaning, gap filling, codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.checks import ensure_none
from tidegrid.functions.scalars import has_explicit_zone, number
from tidegrid.functions.times import DAY, HOUR, instant
from tidegrid.operators.scale import nearest_known, ranked, salted_join


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text that is no number, and NaN, become null."""
    return df.withColumns({c: number(c) for c in columns})


def numeric_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [F.when(F.col(c).isNotNull() & number(c).isNull(), c) for c in columns]
    return df.withColumn("bad_column", F.coalesce(*bad, F.lit(None).cast("string"))).filter(
        "bad_column IS NOT NULL")


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ensure_none(numeric_violations(df, columns), "Not a number")
    return coerce_numeric(df, columns)


def project_map(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Those mapped columns that exist, renamed."""
    present = [F.col(old).alias(new) for old, new in mapping.items() if old in df.columns]
    return df.select(*keep, *present)


def zone_violations(df: DataFrame, column: str) -> DataFrame:
    """Rows whose timestamp text does not end in Z or an offset."""
    return df.filter(~F.coalesce(has_explicit_zone(column), F.lit(False)))


def require_explicit_zone(df: DataFrame, column: str) -> DataFrame:
    ensure_none(zone_violations(df, column), "Timestamps must carry an explicit zone")
    return df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


# Permitted ranges of weather values and horizons.
BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "relative_humidity_2m": (0.0, 100.0),
    "cloud_cover": (0.0, 100.0),
    "wind_speed_10m": (0.0, None),
    "shortwave_radiation": (0.0, None),
    "horizon_hours": (0.0, None),
}


def bound_violations(df: DataFrame, keys: Sequence[str],
                     bounds: Mapping[str, tuple[float | None, float | None]] = BOUNDS) -> DataFrame:
    """One row per value outside its permitted range."""
    cells = []
    for name, (low, high) in bounds.items():
        if name not in df.columns:
            continue
        outside = F.lit(False)
        if low is not None:
            outside = outside | (F.col(name) < low)
        if high is not None:
            outside = outside | (F.col(name) > high)
        cells.append(F.when(outside, F.struct(F.lit(name).alias("column_name"),
                                              F.col(name).cast("double").alias("value"))))
    return df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(*keys, "_c.*")


# Technologies that each (document, process) may carry.
VOCABULARY = {
    ("A65", "A01"): ("TOTAL_LOAD",),
    ("A69", "A01"): ("SOLAR", "WIND_OFFSHORE", "WIND_ONSHORE"),
    ("A69", "A40"): ("SOLAR", "WIND_OFFSHORE", "WIND_ONSHORE"),
    ("A71", "A01"): ("TOTAL_GENERATION",),
}


def vocabulary_violations(df: DataFrame, allowed: Mapping[tuple[str, str], Sequence[str]] = VOCABULARY) -> DataFrame:
    """Rows whose document, process and technology do not belong together (nulls included)."""
    permitted = [F.lit("|".join((*pair, tech))) for pair, techs in allowed.items() for tech in techs]
    label = F.concat(
        F.coalesce("document_type", F.lit("")), F.lit("|"), F.coalesce("process_type", F.lit("")),
        F.lit("|"), F.coalesce("technology", F.lit("")),
    )
    return df.filter(~label.isin(*permitted))


def clean_market(df: DataFrame, text_defaults: Sequence[str] = ("region", "energy_source"),
                 required: Sequence[str] = ("timestamp", "market_price", "demand_mw", "supply_mw"),
                 numeric: Sequence[str] = ("market_price", "demand_mw", "supply_mw", "weather_temperature")) -> DataFrame:
    """Lower-case column names, unique rows, no null keys, no negative amounts, calendar."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    if dict(named.dtypes)["timestamp"] == "string":
        named = named.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    clean = coerce_numeric(named, [c for c in numeric if c in named.columns]).dropDuplicates()
    clean = clean.na.drop(subset=list(required)).fillna("Unknown", subset=list(text_defaults))
    for c in required:
        if c != "timestamp":
            clean = clean.filter(F.col(c) >= 0)
    return clean.withColumns({
        "hour": F.hour("timestamp"), "day": F.dayofmonth("timestamp"), "month": F.month("timestamp"),
        "day_of_week": F.date_format("timestamp", "EEEE"),
        "supply_demand_gap": F.col("supply_mw") - F.col("demand_mw"),
    })


def fill_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], zero: Sequence[str] = (),
                ts: str = "ts", width: int = 100_000) -> DataFrame:
    """Linear interpolation by row position, ends filled from the nearest value; ``zero`` null -> 0."""
    out = ranked(df, keys, ts, width=365 * DAY)
    for c in columns:
        out = nearest_known(out, keys, "rn", c, width=width, before="_b", after="_a")
        rise = (F.col("_a.v") - F.col("_b.v")) * (F.col("rn") - F.col("_b.at"))
        between = F.col("_b.v") + rise / F.nullif(F.col("_a.at") - F.col("_b.at"), F.lit(0))
        out = out.withColumn(c, F.coalesce(F.col(c), between, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero}).drop("rn")


def factorize(df: DataFrame, column: str, order: str, out: str | None = None, width: int = 1_000_000) -> DataFrame:
    """Codes 0, 1, 2, ... by first appearance in the order of a unique integer column; null is -1.

    Only the first order value of each category is ranked, by buckets; the
    codes are joined back with salt, because one category may be most rows.
    """
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    codes = ranked(firsts, [], "_first", width=width, out="_rank", position=F.col("_first"))
    name = out or f"{column}_encoded"
    per_value = codes.select(column, (F.col("_rank") - 1).alias(name))
    return salted_join(df, per_value, [column], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(-1)).cast("long"))


def run_metadata(df: DataFrame, fields: Mapping[str, str], message: str = "message") -> DataFrame:
    """Fields of a JSON object in a text column; text that is no JSON object gives nulls."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    parsed = F.from_json(F.col(message), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_m", parsed).select(*df.columns, *[F.col(f"_m.{n}").alias(n) for n in fields])


def filter_incidents(df: DataFrame, now, severity: str | None = None, component: str | None = None,
                     within_s: int | None = None, ts: str = "run_time") -> DataFrame:
    """Incidents of one severity or component, within a look-back from ``now``."""
    out = df
    if severity:
        out = out.filter(F.col("severity") == severity)
    if component:
        out = out.filter(F.col("component") == component)
    if within_s:
        out = out.filter(F.col(ts) >= instant(now) - F.make_dt_interval(secs=F.lit(float(within_s))))
    return out


def completed_before(df: DataFrame, now, ts: str = "ts") -> DataFrame:
    """Only hours that ended before the hour of ``now``."""
    return df.filter(F.col(ts) < F.date_trunc("hour", instant(now)))


def horizon_consistent(target: str, issue: str, horizon: str, unit_s: int = HOUR) -> Column:
    """The declared horizon equals the time from issue to target."""
    span = (F.unix_micros(target) - F.unix_micros(issue)) / F.lit(1_000_000.0 * unit_s)
    return F.abs(F.col(horizon) - span) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(span)


