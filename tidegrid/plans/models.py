"""Queries on fits, scoring and selection.

SQL counterparts exist for the sums that the linear fits follow from; the fits
themselves are held against other implementations in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, shift
from tidegrid.operators import boosting, evaluation, features, gram, models as ops
from tidegrid.plans.adapters import DS_SQL, S_SQL, daily_silver, silver, table
from tidegrid.plans.features import ROUNDED, TABLE_SQL, not_null, rounded
from tidegrid.plans.registry import query
from tidegrid.session import written

HORIZONS = tuple(range(1, 25))
YEARS = (1998, 1999, 2000)
HOLDOUT = "2001-01-01"
CALENDAR = ("target_hour", "target_day_of_week", "target_month", "target_is_weekend")
PRIMARY = (*features.FEATURES, *CALENDAR)
FALLBACK = (*features.FALLBACK_FEATURES, *CALENDAR)
MEASURED = (*features.FEATURES, features.TARGET)
DAILY_SQL = TABLE_SQL.replace(S_SQL, DS_SQL).replace(" HOUR", " DAY")


def gold(spark, d):
    return features.build_gold(silver(spark, d))


def daily_gold(spark, d):
    """The 31 features and the next day's value of the daily series, over all years."""
    return rounded(features.build_gold(daily_silver(spark, d), step_s=DAY)).withColumns(
        {"label": F.col(features.TARGET), "target_ts": shift("ts", DAY)})


def issue_rows(spark, d, horizons=24):
    base = silver(spark, d)
    return ops.horizon_rows(features.issue_features(base), base, "price_eur_mwh", horizons=horizons)


def cumulative_groups():
    """The five feature groups, each with the columns of the one before."""
    parts = (("Time Only", features.CALENDAR), ("Time + Price History", features.PRICE_FEATURES),
             ("Time + Price + Load", features.LOAD_FEATURES),
             ("Time + Price + Load + Generation", features.GENERATION + features.DERIVED), ("Full", features.WEATHER))
    groups, so_far = {}, ()
    for name, more in parts:
        so_far += more
        groups[name] = so_far
    return groups


GROUPS = cumulative_groups()


def _pairs_sql(by):
    """Correlations of every two columns of ``x``, where both vary."""
    values = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MEASURED)
    keys = "".join(f"a.{k}, " for k in by)
    same = "".join(f" AND a.{k} = b.{k}" for k in by)
    place = "list_position([" + ", ".join(f"'{c}'" for c in MEASURED) + "], {})"
    return (f"v AS (SELECT row_number() OVER () AS rid, {''.join(f'{k}, ' for k in by)}{values} FROM x), "
            f"u AS (UNPIVOT v ON {', '.join(MEASURED)} INTO NAME name VALUE value), "
            f"c AS (SELECT {keys}a.name AS a, b.name AS b, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 "
            f"THEN corr(a.value, b.value) END AS r "
            f"FROM u a JOIN u b ON a.rid = b.rid{same} AND {place.format('a.name')} < {place.format('b.name')} GROUP BY ALL) "
            f"SELECT {''.join(f'{k}, ' for k in by)}a, b, round(r, 8) AS correlation FROM c")


@query("ml6_correlations", f"WITH {TABLE_SQL}, x AS (SELECT * FROM feat WHERE {not_null(MEASURED)}), " + _pairs_sql([]))
def _(spark, d):
    return gram.correlations(rounded(gold(spark, d)), MEASURED).withColumn("correlation", F.round("correlation", 8))


@query("ml7_fold_sums", f"WITH {DAILY_SQL}, g AS (SELECT *, year(ts + INTERVAL 1 DAY) AS y FROM feat WHERE {not_null(MEASURED)}), "
       f"x AS (SELECT f.validation_period, g.* FROM g JOIN (VALUES {', '.join(f'({y!r})' for y in map(str, YEARS))}) f(validation_period) "
       f"ON y < CAST(f.validation_period AS INTEGER)), " + _pairs_sql(["validation_period"]))
def _(spark, d):
    """Correlations of the folds' training rows, from yearly sums that are added up."""
    rows = daily_gold(spark, d).withColumn("year", F.year("target_ts"))
    origin = gram.origins(rows, MEASURED)
    folds = spark.createDataFrame([(str(y),) for y in YEARS], "validation_period string")
    sums = gram.expanded(gram.moments(rows, ["year"], MEASURED, origin=origin), folds, [])
    sums, fold = written(sums), "validation_period"
    rows_of = sums.filter("i = 0 AND j = 0").select(fold, F.col("value").alias("n"))
    first = sums.filter("i = 0 AND j > 0").select(fold, F.col("j").alias("k"), F.col("value").alias("s"))
    square = sums.filter("i = j AND i > 0").select(fold, F.col("j").alias("k"), F.col("value").alias("q"))
    each = first.join(square, [fold, "k"]).join(rows_of, fold).withColumn("v", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    name = F.get(F.array(*[F.lit(c) for c in MEASURED]), F.col("k") - 1)
    side = lambda at, out: each.select(
        fold, F.col("k").alias(at), name.alias(out), F.col("s").alias(f"s{at}"), F.col("v").alias(f"v{at}"), (F.col("v") > 1e-9 * F.col("q")).alias(f"ok{at}"))
    pairs = sums.filter("0 < i AND i < j").join(side("i", "a"), [fold, "i"]).join(side("j", "b"), [fold, "j"]).join(rows_of, fold)
    cover = (F.col("value") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(F.col("vi") * F.col("vj"))
    return pairs.select(fold, "a", "b", F.when(F.col("oki") & F.col("okj"), F.round(cover, 8)).alias("correlation"))


@query("ml6_fit_linear")
def _(spark, d):
    rows = written(daily_gold(spark, d))
    train = rows.filter(f"target_ts < '{HOLDOUT}'")
    columns, origin = list(features.FEATURES), gram.origins(train, [*features.FEATURES, "label"])
    models = written(gram.fit(gram.moments(train, ["series_id"], [*columns, "label"], origin=origin), ["series_id"], columns,
                              gram.linear_configs(columns, grids=False)[:1], origin))
    scored = gram.score_models(rows.filter(f"target_ts >= '{HOLDOUT}'"), models, ["series_id"], columns, ["label"])
    return evaluation.error_metrics(scored.withColumnsRenamed({"label": "actual", "prediction": "predicted"}), ["series_id", "model_name"])


@query("ml7_linear_family")
def _(spark, d):
    return ops.best_configurations(ops.tune_linear(daily_gold(spark, d), gram.linear_configs(features.FEATURES), YEARS, HOLDOUT))


@query("ml8_boosted_family")
def _(spark, d):
    """Both boosting families, whole grids, three folds."""
    scored = boosting.tune_boosted(daily_gold(spark, d), boosting.boosted_family(
        GROUPS["Time + Price + Load + Generation"], GROUPS["Time + Price History"]), YEARS, HOLDOUT)
    return ops.best_configurations(evaluation.error_metrics(scored, [*ops.CONFIGURATION, "validation_period"]))


@query("ml8_random_forest")
def _(spark, d):
    """The shallower forests of 200 trees, three folds; the deeper and larger entries of the grid take too long (README)."""
    forest = ops.tree_family(GROUPS["Time + Price History"])[0]
    small = forest._replace(grid=[g for g in forest.grid if g.get("numTrees") == 200 and g.get("maxDepth") == 12])
    return ops.best_configurations(ops.tune(daily_gold(spark, d), [small], YEARS, HOLDOUT))


@query("ml9_fit_horizons")
def _(spark, d):
    lists = {"primary": PRIMARY, "fallback": FALLBACK}
    rows = written(issue_rows(spark, d))
    models = ops.fit_linear_horizons(rows.filter("target_ts < '2024-01-24'"), lists, HORIZONS)
    scored = ops.score_linear_horizons(rows.filter("issue >= '2024-01-24'"), models, lists, ["series_id", "label"])
    return evaluation.metrics_by_horizon(scored.withColumnsRenamed({"label": "actual", "prediction": "predicted"}), ["series_id", "feature_group"],
                                         horizon="horizon")


@query("ml10_tune")
def _(spark, d):
    """Errors of every configuration of the linear and boosting families on every fold."""
    rows = written(daily_gold(spark, d))
    linear = ops.tune_linear(rows, gram.linear_configs(features.FEATURES), YEARS, HOLDOUT)
    scored = boosting.tune_boosted(rows, boosting.boosted_family(
        GROUPS["Time + Price + Load + Generation"], GROUPS["Time + Price History"]), YEARS, HOLDOUT)
    return linear.unionByName(evaluation.error_metrics(scored, [*ops.CONFIGURATION, "validation_period"]))


@query("ml11_ablation")
def _(spark, d):
    configs = [c for name, columns in GROUPS.items() for c in gram.linear_configs(columns, name, grids=False)]
    rows = written(daily_gold(spark, d))
    boosted = [boosting.Boost(name, rank, group, tuple(columns), *settings) for group, columns in GROUPS.items()
               for name, rank, *settings in (("Gradient Boosting", 7, 100, 0.1, 3, 0.0), ("XGBoost", 8))]
    scored = boosting.tune_boosted(rows, boosted, YEARS, HOLDOUT)
    errors = ops.tune_linear(rows, configs, YEARS, HOLDOUT).unionByName(evaluation.error_metrics(scored, [*ops.CONFIGURATION, "validation_period"]))
    return evaluation.ablation_aggregate(errors, list(GROUPS), 150.0)


@query("ml12_coefficients")
def _(spark, d):
    rows, columns = written(daily_gold(spark, d)), list(features.FEATURES)
    origin = gram.origins(rows, [*columns, "label"])
    models = gram.fit(gram.moments(rows, [], [*columns, "label"], origin=origin), [], columns, gram.linear_configs(columns, grids=False)[:4], origin)
    return ops.coefficients(models, rows, columns)


@query("ml13_score")
def _(spark, d):
    table_ = gold(spark, d).withColumn("label", F.col(features.TARGET))
    model = ops.fit_linear(table_.filter("ts < '2024-01-24'"), features.FEATURES)
    return ops.score(table_, model, features.FEATURES, "2024-01-25", "2024-01-28", label="label")


@query("ml14_issue_forecasts")
def _(spark, d):
    base = silver(spark, d)
    rows = written(ops.horizon_rows(features.issue_features(base), base, "price_eur_mwh").filter("target_ts < '2024-01-28'"))
    models = ops.fit_linear_horizons(rows, {"all": PRIMARY}, HORIZONS)
    issues = features.issue_features(base).filter("ts >= '2024-01-29'")
    issued, withheld = ops.issue_forecasts(issues, models, PRIMARY, "2024-01-29 14:10:00", "linear-1")
    return issued.unionByName(withheld, allowMissingColumns=True)


@query("ml16_isolation_forest")
def _(spark, d):
    return ops.isolation_forest(silver(spark, d).select("series_id", "ts", "price_eur_mwh", "load_mw"), ["price_eur_mwh", "load_mw"], 0.01,
                                key=["series_id", "ts"])


@query("ml16_isolation_forest_lines")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                               (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    return ops.isolation_forest(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit_price"], 0.05,
                                key=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).filter("is_anomaly")


@query("ml17_evaluate_exogenous")
def _(spark, d):
    base = silver(spark, d)
    history = base.select("series_id", "ts", shift("ts", 4200).alias("available_at_utc"), F.col("price_eur_mwh").alias("value"))
    return ops.evaluate_exogenous(issue_rows(spark, d), PRIMARY, "2024-01-18 00:00:00", "2024-01-24 00:00:00",
                                  persistence="price_eur_mwh", history=history, horizons=HORIZONS)


@query("ml18_final_holdout")
def _(spark, d):
    metrics, _regimes = ops.final_holdout(gold(spark, d), features.FEATURES, "2024-01-24", "2024-01-30")
    return metrics


@query("ml18_final_holdout_regimes")
def _(spark, d):
    _metrics, regimes = ops.final_holdout(gold(spark, d), features.FEATURES, "2024-01-24", "2024-01-30")
    return regimes


@query("ml19_nested_selection")
def _(spark, d):
    base = daily_silver(spark, d)
    rows = ops.horizon_rows(features.issue_features(base, step_s=DAY), base, "price_eur_mwh", horizons=24, step_s=DAY)
    return ops.nested_selection(rows, PRIMARY, "2001-01-01 00:00:00", step_s=DAY, horizons=24, min_train=180).aggregate
