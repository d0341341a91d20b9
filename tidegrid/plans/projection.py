"""Queries on row-wise rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import scalars, times
from tidegrid.functions.times import DAY, HOUR
from tidegrid.operators import joins, projection as ops
from tidegrid.operators.series import wind_total
from tidegrid.plans.adapters import (
    D_SQL, F_SQL, H_SQL, Q_SQL, R_SQL, S_SQL, V_SQL, days, forecasts, hours, quarters, runs, silver, table, vintages,
)
from tidegrid.plans.registry import query

MESSY_SQL = """messy AS (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL
    WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || '.5' END AS text FROM events)"""


def messy(spark, d):
    k, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    return table(spark, d, "events").select(
        "event_id", F.when(k == 0, "n/a").when(k == 1, "NaN").when(k == 3, user)
        .when(k != 2, F.concat(user, F.lit(".5"))).alias("text"))


@query("prj1_coerce_numeric", f"""WITH {MESSY_SQL}
SELECT event_id, CASE WHEN isnan(TRY_CAST(text AS DOUBLE)) THEN NULL ELSE TRY_CAST(text AS DOUBLE) END AS text FROM messy""")
def _(spark, d):
    return ops.coerce_numeric(messy(spark, d), ["text"])


@query("prj2_numeric_violations", f"""WITH {MESSY_SQL}
SELECT event_id, text, 'text' AS bad_column FROM messy
WHERE text IS NOT NULL AND (TRY_CAST(text AS DOUBLE) IS NULL OR isnan(TRY_CAST(text AS DOUBLE)))""")
def _(spark, d):
    return ops.numeric_violations(messy(spark, d), ["text"])


@query("prj3_project_map", "SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS state FROM orders")
def _(spark, d):
    return ops.project_map(table(spark, d, "orders"), {
        "o_orderkey": "id", "o_totalprice": "amount", "o_missing": "gone", "o_orderstatus": "state"})


@query("prj4_wind_total", f"""WITH {S_SQL}
SELECT ts, nuclear_mw AS wind_onshore_mw, 0.0 + nuclear_mw AS wind_total_mw FROM s""")
def _(spark, d):
    return wind_total(silver(spark, d).select("ts", F.col("nuclear_mw").alias("wind_onshore_mw")))


ZONE_SQL = """z AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+01:00' ELSE '' END AS stamp FROM events)"""


@query("prj5_zone_violations", f"WITH {ZONE_SQL} SELECT event_id, stamp FROM z WHERE NOT regexp_matches(stamp, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$')")
def _(spark, d):
    k = F.col("event_id") % 3
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                     F.when(k == 0, "Z").when(k == 1, "+01:00").otherwise(""))
    return ops.zone_violations(table(spark, d, "events").select("event_id", stamp.alias("stamp")), "stamp")


@query("prj6_exact_hours", f"WITH {Q_SQL} SELECT series_id, ts FROM q WHERE ts = date_trunc('hour', ts)")
def _(spark, d):
    return quarters(spark, d).filter(times.is_exact("ts")).select("series_id", "ts")


@query("prj7_between_ts", """SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:00'""")
def _(spark, d):
    return table(spark, d, "events").filter(
        times.between_ts("ts", "2024-01-05 00:00:00", "2024-01-09 12:00:00")).select("event_id", "ts")


@query("prj8_within_cycle", f"""WITH {V_SQL}, c AS (
  SELECT *, coalesce(collection_issue_time, date_trunc('hour', acquired_at_utc)) AS effective_issue_time FROM v)
SELECT document_id, revision_number, part_key, effective_issue_time FROM c
WHERE acquired_at_utc >= effective_issue_time AND acquired_at_utc < effective_issue_time + INTERVAL 1 HOUR""")
def _(spark, d):
    return joins.within_cycle(vintages(spark, d)).select("document_id", "revision_number", "part_key", "effective_issue_time")


NOW = "2024-01-20 13:37:00"


@query("prj9_completed_before", f"WITH {H_SQL} SELECT series_id, ts, value FROM h WHERE ts < TIMESTAMP '2024-01-20 13:00:00'")
def _(spark, d):
    return ops.completed_before(hours(spark, d), NOW)


@query("prj10_finite_values", """SELECT event_id, value FROM events WHERE event_id % 5 NOT IN (0, 1, 2)""")
def _(spark, d):
    k = F.col("event_id") % 5
    odd = table(spark, d, "events").select("event_id", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(
        k != 2, F.col("value")).alias("value"))
    return odd.filter(scalars.is_finite("value"))


@query("prj11_drop_incomplete", f"WITH {S_SQL} SELECT ts, nuclear_mw, load_mw FROM s WHERE nuclear_mw IS NOT NULL")
def _(spark, d):
    return ops.drop_incomplete(silver(spark, d).select("ts", "nuclear_mw", "load_mw"), ["nuclear_mw"])


@query("prj12_bound_violations", """WITH w AS (
  SELECT event_id, value AS cloud_cover, value - 5 AS wind_speed_10m, CAST(user_id - 3 AS INTEGER) AS horizon_hours FROM events)
SELECT event_id, 'cloud_cover' AS column_name, cloud_cover AS value FROM w WHERE cloud_cover > 100
UNION ALL SELECT event_id, 'wind_speed_10m', wind_speed_10m FROM w WHERE wind_speed_10m < 0
UNION ALL SELECT event_id, 'horizon_hours', CAST(horizon_hours AS DOUBLE) FROM w WHERE horizon_hours < 0""")
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("value").alias("cloud_cover"), (F.col("value") - 5).alias("wind_speed_10m"),
        (F.col("user_id") - 3).cast("int").alias("horizon_hours"))
    return ops.bound_violations(rows, ["event_id"])


GREEN = "solar_mw + wind_total_mw + biomass_mw + hydro_mw"
for policy, nuclear, positive in (("strict", "nuclear_mw", False), ("positive", "nuclear_mw", True),
                                  ("nuclear_zero", "coalesce(nuclear_mw, 0)", False)):
    total = f"({GREEN} + lignite_mw + gas_mw + hard_coal_mw + {nuclear})"
    guard = f"CASE WHEN {total} > 0 THEN" if positive else "CASE WHEN true THEN"

    @query(f"prj13_renewable_{policy}", f"""WITH {S_SQL}
SELECT ts, round({GREEN}, 6) AS renewable_generation_mw, round({guard} ({GREEN}) / nullif({total}, 0) END, 9) AS renewable_share FROM s""")
    def _(spark, d, policy=policy):
        return joins.renewable(silver(spark, d), policy).select(
            "ts", F.round("renewable_generation_mw", 6).alias("renewable_generation_mw"),
            F.round("renewable_share", 9).alias("renewable_share"))


REGIME_SQL = """CASE WHEN price_eur_mwh < 0 THEN 'Negative' WHEN price_eur_mwh < 100 THEN 'Normal'
  WHEN price_eur_mwh < 200 THEN 'High' ELSE 'Extreme' END"""


@query("prj14_price_regime", f"WITH {D_SQL} SELECT series_id, ts, {REGIME_SQL} AS regime FROM dd")
def _(spark, d):
    return days(spark, d).select("series_id", "ts", scalars.price_regime("price_eur_mwh").alias("regime"))


@query("prj15_vocabulary_violations", f"""WITH {V_SQL}, x AS (
  SELECT document_id, revision_number, part_key, CASE WHEN part_key % 10 = 0 THEN 'A65' ELSE document_type END AS document_type,
    process_type, CASE WHEN part_key % 17 = 0 THEN NULL ELSE technology END AS technology FROM v)
SELECT document_id, revision_number, part_key FROM x WHERE NOT coalesce(
  document_type = 'A69' AND process_type IN ('A01', 'A40') AND technology IN ('SOLAR', 'WIND_OFFSHORE', 'WIND_ONSHORE'), false)""")
def _(spark, d):
    odd = vintages(spark, d).withColumns({
        "document_type": F.when(F.col("part_key") % 10 == 0, "A65").otherwise(F.col("document_type")),
        "technology": F.when(F.col("part_key") % 17 != 0, F.col("technology"))})
    return ops.vocabulary_violations(odd).select("document_id", "revision_number", "part_key")


MARKET_SQL = """market AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS stamp, CASE WHEN o_custkey % 9 = 0 THEN 'bad' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
    o_totalprice - 50000 AS demand_mw, o_totalprice AS supply_mw, o_orderstatus AS region,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS energy_source FROM orders)"""


def raw_market(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias(" Timestamp"),
        F.when(F.col("o_custkey") % 9 == 0, "bad").otherwise(F.col("o_totalprice").cast("string")).alias("Market_Price "),
        (F.col("o_totalprice") - 50000).alias("DEMAND_MW"), F.col("o_totalprice").alias("supply_mw"),
        F.lit(20.0).alias("weather_temperature"), F.col("o_orderstatus").alias("Region"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).alias("energy_source"))


@query("prj16_clean_market", f"""WITH {MARKET_SQL}, t AS (SELECT DISTINCT CAST(stamp AS TIMESTAMP) AS timestamp,
  TRY_CAST(price AS DOUBLE) AS market_price, demand_mw, supply_mw, 20.0::DOUBLE AS weather_temperature, region, energy_source FROM market)
SELECT timestamp, market_price, demand_mw, supply_mw, weather_temperature, coalesce(region, 'Unknown') AS region,
  coalesce(energy_source, 'Unknown') AS energy_source, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(day(timestamp) AS INTEGER) AS day,
  CAST(month(timestamp) AS INTEGER) AS month, dayname(timestamp) AS day_of_week, supply_mw - demand_mw AS supply_demand_gap
FROM t WHERE market_price >= 0 AND demand_mw >= 0 AND supply_mw >= 0""")
def _(spark, d):
    return ops.clean_market(raw_market(spark, d))


@query("prj17_fill_series", f"""WITH {D_SQL}, holes AS (
  SELECT series_id, ts, CASE WHEN orders % 3 = 0 OR day(ts) <= 2 THEN NULL ELSE price_eur_mwh END AS v,
    CASE WHEN orders % 2 = 0 THEN NULL ELSE total END AS rain, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM dd),
near AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn) AS b,
    first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM holes)
SELECT n.series_id, n.ts, coalesce(n.v, pb.v + (pa.v - pb.v) * (n.rn - n.b) / nullif(n.a - n.b, 0), pa.v, pb.v) AS v,
  coalesce(n.rain, 0) AS rain FROM near n LEFT JOIN holes pb ON pb.series_id = n.series_id AND pb.rn = n.b
  LEFT JOIN holes pa ON pa.series_id = n.series_id AND pa.rn = n.a""")
def _(spark, d):
    holes = days(spark, d).select(
        "series_id", "ts", F.when(~((F.col("orders") % 3 == 0) | (F.dayofmonth("ts") <= 2)), F.col("price_eur_mwh")).alias("v"),
        F.when(F.col("orders") % 2 != 0, F.col("total")).alias("rain"))
    return ops.fill_series(holes, ["series_id"], ["v"], ["rain"])


@query("prj18_factorize", """WITH f AS (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1),
c AS (SELECT event_type, row_number() OVER (ORDER BY first_id) - 1 AS code FROM f)
SELECT event_id, event_type, code AS event_type_encoded FROM events JOIN c USING (event_type)""")
def _(spark, d):
    return ops.factorize(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("prj19_redact_query", """WITH u AS (SELECT page_id, replace(url, 'ref=', 'api_key=') AS url FROM pages)
SELECT page_id, regexp_replace(url, '(api_key)=[^&#]*', '\\1=[REDACTED]') AS url FROM u""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "ref=", "api_key=").alias("url"))
    return pages.select("page_id", scalars.redact_query("url").alias("url"))


@query("prj19_redact_text", """SELECT event_id, 'Bearer [REDACTED] token=[REDACTED] at http://[REDACTED]@host/' || user_id AS text FROM events""")
def _(spark, d):
    user = F.col("user_id").cast("string")
    text = F.concat(F.lit("Bearer abc"), user, F.lit(" token: x"), user, F.lit(" at http://me:pw@host/"), user)
    return table(spark, d, "events").select("event_id", scalars.redact_text(text).alias("text"))


@query("prj19_drop_sensitive_keys", """SELECT event_id, '{"note":"' || event_type || '","user":"' || user_id || '"}' AS entries FROM events""")
def _(spark, d):
    names = F.array(*[F.lit(k) for k in ("note", "API-Key", "user", "db_Password", "my credential", "accessKeyId")])
    user = F.col("user_id").cast("string")
    entries = F.map_from_arrays(names, F.array("event_type", user, user, user, user, user))
    return table(spark, d, "events").select("event_id", F.to_json(scalars.drop_sensitive_keys(entries)).alias("entries"))


@query("prj20_run_metadata", f"""WITH {R_SQL}, m AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'not json' ELSE message END AS message FROM runs)
SELECT id, message, CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(json_extract(message, '$.k') AS BIGINT) END AS k, NULL::VARCHAR AS missing FROM m""")
def _(spark, d):
    broken = runs(spark, d).select("id", F.when(F.col("id") % 11 == 0, "not json").otherwise(F.col("message")).alias("message"))
    return ops.run_metadata(broken, {"k": "long", "missing": "string"})


# Credential words, with marks between their letters or not, are masked on both sides first: the check is about blanks and length.
WORDS_SQL = "(?i)(" + "|".join("[^a-z0-9]*".join(word) for word in scalars.SENSITIVE_WORDS) + ")"


@query("prj21_concise", f"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{WORDS_SQL}', '*', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 160 THEN line ELSE rtrim(left(line, 159)) || '…' END AS line FROM t""")
def _(spark, d):
    text = F.regexp_replace("text", WORDS_SQL, "*")
    return table(spark, d, "documents").select("doc_id", scalars.concise(text).alias("line"))


@query("prj21_history_message", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'run ' || event_type || ' of ' || user_id WHEN 1 THEN 'Operational metadata recorded.'
  WHEN 2 THEN user_id || ' missing timestamps; first unresolved t' || event_id WHEN 3 THEN 'No message recorded.' ELSE 'plain ' || event_type END AS line FROM events""")
def _(spark, d):
    kind, user, at = F.col("event_id") % 5, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    message = (
        F.when(kind == 0, F.concat(F.lit('{"message": "run  '), "event_type", F.lit(' of\\n'), user, F.lit('", "k": [1, 2]}')))
        .when(kind == 1, F.concat(F.lit('{"k": '), user, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"missing_count": '), user, F.lit(', "first_unresolved_timestamp": "t'), at, F.lit('"}')))
        .when(kind == 3, F.lit("")).otherwise(F.concat(F.lit(" plain \t"), "event_type")))
    return table(spark, d, "events").select("event_id", scalars.history_message(message).alias("line"))


@query("prj22_filter_incidents", f"""WITH {R_SQL} SELECT id, run_time, component FROM runs
WHERE status = 'FAILED' AND component = 'c3' AND run_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""")
def _(spark, d):
    out = ops.filter_incidents(runs(spark, d).withColumnRenamed("status", "severity"), NOW, "FAILED", "c3", 7 * DAY)
    return out.select("id", "run_time", "component")


@query("prj23_allow_code", "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'UNKNOWN' END AS code FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", scalars.allow_code("event_type", ["error", "view"], "UNKNOWN").alias("code"))


# --- scalar functions ------------------------------------------------------------

@query("sc1_calendar", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS day_of_week,
  CAST(month(ts) AS INTEGER) AS month, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in times.calendar("ts").items()])


@query("sc2_target_calendar", f"""WITH {F_SQL} SELECT series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours,
  CAST(hour(target_timestamp) AS INTEGER) AS target_hour, CAST((dayofweek(target_timestamp) + 6) % 7 AS INTEGER) AS target_day_of_week,
  CAST(month(target_timestamp) AS INTEGER) AS target_month, CASE WHEN dayofweek(target_timestamp) IN (0, 6) THEN 1 ELSE 0 END AS target_is_weekend FROM history""")
def _(spark, d):
    target = times.shift("forecast_issue_time", F.col("horizon_hours") * HOUR)
    return forecasts(spark, d).select("series_id", "model_release", "forecast_issue_time", "horizon_hours",
                                      *[c.alias(n) for n, c in times.calendar(target, "target_").items()])


@query("sc3_floor_times", """SELECT event_id, date_trunc('hour', ts) AS hour_ts, date_trunc('day', ts) AS day_ts,
  date_trunc('month', ts) AS month_ts, strftime(ts, '%Y-%m') AS year_month FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", times.floor_to("ts", HOUR).alias("hour_ts"), times.floor_to("ts", DAY).alias("day_ts"),
        F.date_trunc("month", "ts").alias("month_ts"), F.date_format("ts", "yyyy-MM").alias("year_month"))


@query("sc4_iso_duration", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 900 WHEN 1 THEN (user_id % 9 + 1) * 3600 + 1800 WHEN 2 THEN user_id % 9 + 1 END AS seconds FROM events""")
def _(spark, d):
    k, n = F.col("event_id") % 5, (F.col("user_id") % 9 + 1).cast("string")
    text = (F.when(k == 0, "PT15M").when(k == 1, F.concat(F.lit("PT"), n, F.lit("H30M")))
            .when(k == 2, F.concat(F.lit("PT"), n, F.lit("S"))).when(k == 3, "P1D").otherwise("PT0M"))
    return table(spark, d, "events").select("event_id", times.iso_duration_seconds(text).alias("seconds"))


@query("sc5_horizon_check", f"""WITH {V_SQL} SELECT document_id, revision_number, part_key,
  CAST(epoch(target_timestamp) - epoch(source_created_at_utc) AS DOUBLE) / 60 AS minutes,
  CAST(epoch(target_timestamp) - epoch(acquired_at_utc) AS DOUBLE) / 3600 AS hours,
  part_key % 2 = 0 AS consistent FROM v""")
def _(spark, d):
    rows = vintages(spark, d).withColumn(
        "declared", times.horizon_hours("target_timestamp", "acquired_at_utc") + F.col("part_key") % 2)
    return rows.select(
        "document_id", "revision_number", "part_key", times.horizon_minutes("target_timestamp", "source_created_at_utc").alias("minutes"),
        times.horizon_hours("target_timestamp", "acquired_at_utc").alias("hours"),
        ops.horizon_consistent("target_timestamp", "acquired_at_utc", "declared").alias("consistent"))


@query("sc6_age_label", """WITH a AS (SELECT event_id, (epoch(TIMESTAMP '2024-01-28 00:00:00') - epoch(date_trunc('minute', ts))) / 3600 AS h FROM events)
SELECT event_id, CASE WHEN h < 0 THEN 'N/A' WHEN h < 1 THEN printf('%.0f', round(h * 60, 0)) || ' min'
  WHEN h < 48 THEN printf('%.1f', round(h + 0.0001, 1)) || ' hours' ELSE printf('%.1f', round(h / 24 + 0.00001, 1)) || ' days' END AS label FROM a""")
def _(spark, d):
    # The label is taken just off the exact minute, so that no age falls on a rounding tie.
    rows = table(spark, d, "events").withColumn("ts", F.date_trunc("minute", "ts"))
    exact = times.elapsed_seconds(times.instant("2024-01-28 00:00:00"), "ts") / 3600
    off = F.when(exact < 1, 0.0).when(exact < 48, 0.36).otherwise(0.864)
    moved = rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - (off * 1_000_000).cast("long")))
    return moved.select("event_id", times.age_label("ts", "2024-01-28 00:00:00").alias("label"))


@query("sc7_revision_rank", f"WITH {MESSY_SQL} SELECT event_id, CASE event_id % 7 WHEN 0 THEN -1.0 WHEN 1 THEN -1.0 WHEN 2 THEN -1.0 ELSE TRY_CAST(text AS DOUBLE) END AS rank FROM messy")
def _(spark, d):
    return messy(spark, d).select("event_id", scalars.revision_rank("text").alias("rank"))


@query("sc8_close", """SELECT event_id, abs(value - (value + (event_id % 4) * 1e-9)) <= 1e-12 + 1e-9 * abs(value + (event_id % 4) * 1e-9) AS same FROM events""")
def _(spark, d):
    other = F.col("value") + (F.col("event_id") % 4) * F.lit(1e-9)
    return table(spark, d, "events").select("event_id", scalars.close(F.col("value"), other).alias("same"))


@query("sc9_math", "SELECT event_id, abs(value - 50) AS a, round(sqrt(value), 9) AS s, round(value * value, 4) AS sq, round(pow(0.5, value / 365), 12) AS w FROM events")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.abs(v - 50).alias("a"), F.round(F.sqrt(v), 9).alias("s"),
                                            F.round(v * v, 4).alias("sq"), F.round(F.pow(F.lit(0.5), v / 365), 12).alias("w"))


@query("sc10_slug", "SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_full_match(o_orderpriority, '[A-Za-z0-9._-]{1,120}') AS valid FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.slug("o_orderpriority").alias("slug"),
                                            F.col("o_orderpriority").rlike("^[A-Za-z0-9._-]{1,120}$").alias("valid"))


@query("sc11_url_parts", r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query_text, url AS rebuilt FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("QUERY")).alias("query_text"),
        scalars.redact_query("url").alias("rebuilt"))


@query("sc12_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS built FROM events""")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.cast("long").alias("k"))).alias("built"))


@query("sc13_hash", "SELECT page_id, sha256(url) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("digest"))


@query("sc14_status_label", f"WITH {R_SQL} SELECT id, CASE status WHEN 'SUCCESS' THEN 'Completed' WHEN 'FAILED' THEN 'Failed' ELSE 'Warning' END AS label FROM runs")
def _(spark, d):
    return runs(spark, d).select("id", scalars.run_status_label("status").alias("label"))


@query("sc15_day_name", "SELECT o_orderkey, dayname(o_orderdate) AS day_name FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("day_name"))
