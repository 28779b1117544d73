"""Queries whose rows are the metrics and tables of evidence, so that the calls users make are compared with SQL.

Inference that draws random numbers is compared where the result has a closed
form: a rotation of a series keeps its mean, a dominating strategy is never
exceeded, a block length of one leaves no autocovariance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import costs, cv, decay, events, infer, pit, regime, resample, robustness, signal, transform
from panelwright.plans.catalog import CVR, DATES, EVW, MEMBER, ROLE, TR, _cv_rows, _event_tables, corr, membership, panel, query, r, valid_trades
from panelwright.plans.panels import monthly, regions, table
from panelwright.sources import io

SERIES = "sr AS (SELECT time, avg(y) AS value FROM one GROUP BY time)"
#: Four strategies of one row a month, cut to a number of months that four divides.
STRATEGIES = f"""{SERIES}, wide AS (SELECT time, avg(y) AS a, coalesce(avg(y) FILTER (instrument % 2 = 0), 0.0) AS b, coalesce(avg(y) FILTER (instrument % 2 = 1), 0.0) AS c, avg(y * x * 10) AS d, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM one GROUP BY time),
st AS (SELECT * FROM wide WHERE i < n // 4 * 4)"""
#: The standard normal distribution function as a series, exact to about nine digits within six deviations.
NORMAL = "(0.5 + list_sum(list_transform(range(0, 90), lambda k: pow(-1.0, k) * pow({z}, 2 * k + 1) / (pow(2.0, k) * gamma(k + 1) * (2 * k + 1)))) / sqrt(2 * pi()))"


DATES.update(dict.fromkeys(("neutralize", "neutralize_categories", "neutralize_weighted"), ("time",)))


def metrics(spark: SparkSession, found: Mapping[str, Any], names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, None if found[n] is None else float(found[n])) for n in names], "metric string, value double")


def rows_of(values: Mapping[str, str], source: str, places: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {r(f'CAST({x} AS DOUBLE)', places)} AS value FROM {source}" for n, x in values.items())


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir, "1D").groupBy("time").agg(F.avg("y").alias("value"))


def strategies(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """The strategies of ``STRATEGIES``, the first raised by ``shift``."""
    p = panel(spark, sf_dir, "1D")
    odd = F.col("instrument") % 2
    wide = p.groupBy("time").agg((F.avg("y") + shift).alias("a"), F.coalesce(F.avg(F.when(odd == 0, F.col("y"))), F.lit(0.0)).alias("b"), F.coalesce(F.avg(F.when(odd == 1, F.col("y"))), F.lit(0.0)).alias("c"), F.avg(F.col("y") * F.col("x") * 10).alias("d"))
    n = wide.count() // 4 * 4
    return wide.orderBy("time").limit(n)


# Inference


@query("bootstrap_rotation", f"WITH {SERIES} {rows_of({'observed': 'avg(value)', 'bootstrap_estimate': 'avg(value)', 'standard_error': 'max(0)', 'confidence_lower': 'avg(value)', 'confidence_upper': 'avg(value)', 'n_effective': 'count(*)'}, 'sr')}")
def _(spark, sf_dir):
    s = series(spark, sf_dir)
    e = resample.bootstrap(s, time="time", method="circular", block_length=s.count(), resamples=100, seed=1)
    return metrics(spark, e.metrics, ["observed", "bootstrap_estimate", "standard_error", "confidence_lower", "confidence_upper", "n_effective"])


@query("permutation_of_a_pair", f"WITH {SERIES} {rows_of({'observed': 'corr(value, value)', 'p_value': 'max(1.0 / 201)', 'exceedances': 'max(0)', 'n_effective': 'count(*)'}, 'sr')}")
def _(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("other", F.col("value"))
    e = resample.permutation_test(s, paired_with="other", statistic="pearson", scheme="unrestricted", alternative="greater", permutations=200, seed=3)
    return metrics(spark, e.metrics, ["observed", "p_value", "exceedances", "n_effective"])


@query("permutation_of_signs", f"WITH {SERIES} {rows_of({'observed': 'avg(abs(value))', 'p_value': 'max(1.0 / 201)', 'exceedances': 'max(0)'}, 'sr')}")
def _(spark, sf_dir):
    e = resample.permutation_test(series(spark, sf_dir).withColumn("value", F.abs("value")), scheme="sign_flip", alternative="greater", permutations=200, seed=5)
    return metrics(spark, e.metrics, ["observed", "p_value", "exceedances"])


PBO = f"""{STRATEGIES}, long AS (SELECT i * 4 // (n // 4 * 4) AS part, unnest(['a', 'b', 'c', 'd']) AS s, unnest([a, b, c, d]) AS v FROM st),
half AS (SELECT row_number() OVER (ORDER BY p, q) - 1 AS combination, p, q FROM (SELECT unnest(range(0, 4)) AS p) JOIN (SELECT unnest(range(0, 4)) AS q) ON p < q),
perf AS (SELECT combination, s, avg(v) FILTER (part IN (p, q)) / stddev_samp(v) FILTER (part IN (p, q)) AS inside, avg(v) FILTER (part NOT IN (p, q)) / stddev_samp(v) FILTER (part NOT IN (p, q)) AS outside FROM long JOIN half ON true GROUP BY ALL),
pick AS (SELECT combination, arg_max(s, inside) AS s, max(inside) AS inside FROM perf GROUP BY combination),
ranked AS (SELECT k.combination, k.s AS selected, k.inside AS in_sample, any_value(o.outside) AS out_of_sample, (count(*) FILTER (f.outside < o.outside) + (count(*) FILTER (f.outside = o.outside) + 1) / 2.0) / 5.0 AS relative_rank FROM pick k JOIN perf o ON o.combination = k.combination AND o.s = k.s JOIN perf f ON f.combination = k.combination GROUP BY ALL)"""


@query("overfitting_splits", f"WITH {PBO} SELECT CAST(combination AS BIGINT) AS combination, selected, {r('in_sample')} AS in_sample, {r('out_of_sample')} AS out_of_sample, {r('relative_rank')} AS relative_rank, {r('ln(relative_rank / (1 - relative_rank))')} AS logit FROM ranked")
def _(spark, sf_dir):
    e = resample.probability_of_backtest_overfitting(strategies(spark, sf_dir), partitions=4)
    rows = [(x["combination"], x["selected"], x["in_sample"], x["out_of_sample"], x["relative_rank"], x["logit"]) for x in e.rows("combinations")]
    return spark.createDataFrame(rows, "combination long, selected string, in_sample double, out_of_sample double, relative_rank double, logit double")


@query("probability_of_overfitting", f"WITH {PBO} {rows_of({'pbo': 'avg(CAST(relative_rank <= 0.5 AS INT))', 'n_combinations': 'count(*)'}, 'ranked')}")
def _(spark, sf_dir):
    e = resample.probability_of_backtest_overfitting(strategies(spark, sf_dir), partitions=4)
    return metrics(spark, e.metrics, ["pbo", "n_combinations"])


@query("reality_check_dominating", f"WITH {STRATEGIES} {rows_of({'statistic': 'sqrt(count(*)) * (avg(a) + 100)', 'p_value': 'max(1.0 / 201)', 'exceedances': 'max(0)', 'best_mean_differential': 'avg(a) + 100', 'n_observations': 'count(*)', 'n_strategies': 'max(4)'}, 'st')}")
def _(spark, sf_dir):
    e = resample.reality_check(strategies(spark, sf_dir, 100.0), resamples=200, seed=7)
    return metrics(spark, e.metrics, ["statistic", "p_value", "exceedances", "best_mean_differential", "n_observations", "n_strategies"])


@query("spa_dominating", f"WITH {STRATEGIES} {rows_of({'statistic': 'sqrt(count(*)) * (avg(a) + 100) / stddev_pop(a)', 'p_value_lower': 'max(1.0 / 201)', 'p_value_consistent': 'max(1.0 / 201)', 'p_value_upper': 'max(1.0 / 201)', 'n_observations': 'count(*)'}, 'st', 3)}", places=3)
def _(spark, sf_dir):
    e = resample.superior_predictive_ability(strategies(spark, sf_dir, 100.0), expected_block_length=1, resamples=200, seed=9)
    return metrics(spark, e.metrics, ["statistic", "p_value_lower", "p_value_consistent", "p_value_upper", "n_observations"])


@query("joint_bootstrap_means", f"WITH {STRATEGIES} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, {r(f'avg({s})')} AS mean FROM st" for s in "abcd"))
def _(spark, sf_dir):
    e = resample.joint_stationary_bootstrap(strategies(spark, sf_dir), resamples=100, seed=2)
    return spark.createDataFrame([(x["strategy"], x["mean"]) for x in e.rows("strategy_statistics")], "strategy string, mean double")


SHARPE = f"""{SERIES}, mo AS (SELECT count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, stddev_pop(value) AS sp FROM sr),
sh AS (SELECT any_value(n) AS n, any_value(m / sd) AS s, avg(pow((value - m) / sp, 3)) AS g, avg(pow((value - m) / sp, 4)) AS k FROM sr JOIN mo ON true),
se AS (SELECT *, sqrt((1 - g * s + (k - 1) / 4 * s * s) / (n - 1)) AS e FROM sh)"""


@query("sharpe_inference", f"WITH {SHARPE} " + rows_of({"observed_sharpe": "s * sqrt(12)", "standard_error": "e * sqrt(12)", "confidence_lower": "(s - 1.959963984540054 * e) * sqrt(12)", "confidence_upper": "(s + 1.959963984540054 * e) * sqrt(12)", "probabilistic_sharpe_ratio": NORMAL.format(z="(s / e)"), "minimum_track_record_observations": "CASE WHEN s > 0 THEN 1 + (1 - g * s + (k - 1) / 4 * s * s) * pow(1.6448536269514722 / s, 2) END", "skewness": "g", "kurtosis": "k", "n_effective": "n"}, "se"))
def _(spark, sf_dir):
    e = infer.sharpe_inference(series(spark, sf_dir), annualization=12)
    return metrics(spark, e.metrics, ["observed_sharpe", "standard_error", "confidence_lower", "confidence_upper", "probabilistic_sharpe_ratio", "minimum_track_record_observations", "skewness", "kurtosis", "n_effective"])


@query("multiple_testing_evidence", rows_of({"trial_count": "count(*)", "rejected_count": "count(*) FILTER (p * 100 <= 0.05)", "rejected_fraction": "avg(CAST(p * 100 <= 0.05 AS INT))"}, "(SELECT p_partkey, (p_partkey % 997 + 1) / 100000.0 AS p FROM part)"), with_panel=False)
def _(spark, sf_dir):
    trials = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), ((F.col("p_partkey") % 997 + 1) / 100000.0).alias("p_value"))
    e = infer.multiple_testing(trials, method="bonferroni", effective_trials=100)
    return metrics(spark, e.metrics, ["trial_count", "rejected_count", "rejected_fraction"])


# Neutralisation


@query("neutralize", f"WITH f AS (SELECT time, regr_slope(signal, adv) AS b, regr_intercept(signal, adv) AS a FROM px GROUP BY time HAVING count(*) >= 4) SELECT px.time, instrument, {r('signal - a - b * adv')} AS residual FROM px JOIN f ON px.time = f.time")
def _(spark, sf_dir):
    found = transform.neutralize(monthly(spark, sf_dir), exposures="adv", insufficient_policy="drop")
    return found.frame.select("time", "instrument", "residual")


@query("neutralize_categories", f"WITH z AS (SELECT px.time, px.instrument, signal, sector FROM px JOIN sector ON px.instrument = sector.instrument), ok AS (SELECT time FROM z GROUP BY time HAVING count(*) - count(DISTINCT sector) >= 2) SELECT z.time, instrument, {r('signal - avg(signal) OVER (PARTITION BY z.time, sector)', 12)} AS residual FROM z JOIN ok ON z.time = ok.time", places=12)
def _(spark, sf_dir):
    data = monthly(spark, sf_dir).join(regions(spark, sf_dir), "instrument")
    return transform.neutralize(data, exposures="sector", categorical=["sector"], insufficient_policy="drop").frame.select("time", "instrument", "residual")


@query("neutralize_weighted", f"WITH m AS (SELECT time, sum(adv * close) / sum(adv) AS mx, sum(adv * signal) / sum(adv) AS my FROM px GROUP BY time HAVING count(*) >= 4), f AS (SELECT px.time, any_value(mx) AS mx, any_value(my) AS my, sum(adv * (close - mx) * (signal - my)) / sum(adv * (close - mx) * (close - mx)) AS b FROM px JOIN m ON px.time = m.time GROUP BY px.time) SELECT f.time, 'close' AS exposure, {r('b', 9)} AS coefficient FROM f UNION ALL SELECT f.time, 'intercept', {r('my - b * mx', 9)} FROM f", places=9)
def _(spark, sf_dir):
    found = transform.neutralize(monthly(spark, sf_dir), exposures="close", weight="adv", insufficient_policy="drop")
    return found.evidence.tables["neutralization_coefficients"].join(found.frame.select("time").distinct(), "time").select("time", "exposure", "coefficient")


# Events


@query("event_response", f"WITH {EVW}, whole AS (SELECT event_id FROM win GROUP BY event_id HAVING count(*) = count(response)), cm AS (SELECT \"offset\" AS o, avg(response) AS complete_mean FROM win SEMI JOIN whole USING (event_id) GROUP BY o) SELECT CAST(w.\"offset\" AS BIGINT) AS \"offset\", {r('avg(response)')} AS mean_response, count(response) AS n, {r('any_value(complete_mean)')} AS complete_mean FROM win w LEFT JOIN cm ON cm.o = w.\"offset\" GROUP BY w.\"offset\"", with_panel=False)
def _(spark, sf_dir):
    ev, prices = _event_tables(spark, sf_dir)
    windows = events.event_windows(ev, prices, before=2, after=3, overlap_policy="keep")
    e = events.event_response(windows, resamples=100, seed=4, min_clusters=2)
    return spark.createDataFrame([(x["offset"], x["mean_response"], x["n"], x.get("complete_mean")) for x in e.rows("event_response")], "offset long, mean_response double, n long, complete_mean double")


# Costs


@query("break_even_cost", f"WITH {TR}, gn AS (SELECT sum(gross_pnl) AS g, sum(v) AS v FROM ok) " + rows_of({"solution_bps": "CASE WHEN g > 0 AND g / v * 1e4 < 1000 THEN g / v * 1e4 WHEN g <= 0 THEN 0 END", "monotonic_decreasing": "1"}, "gn"), with_panel=False)
def _(spark, sf_dir):
    e = costs.break_even_cost(valid_trades(spark, sf_dir), upper_bps=1000.0, tolerance_bps=1e-10)
    return metrics(spark, e.metrics, ["solution_bps", "monotonic_decreasing"])


@query("cost_estimate", f"WITH {TR} SELECT CAST(instrument AS BIGINT) AS instrument, {r('sum(greatest(q * 0.01 + v * 2.5 / 1e4, 1.5))', 2)} AS commission FROM ok GROUP BY instrument", with_panel=False, places=2)
def _(spark, sf_dir):
    found = costs.cost_frame(costs.canonical_trades(valid_trades(spark, sf_dir)), [costs.CommissionModel(per_unit=0.01, bps=2.5, minimum=1.5)])
    return found.groupBy(F.col("instrument").cast("long").alias("instrument")).agg(F.sum([c for c in found.columns if "commission" in c][0]).alias("commission"))


# Point in time


@query("survivorship_diagnostics", f"WITH {MEMBER}, o AS (SELECT *, bool_or(valid_to IS NULL) OVER w AS open_before, max(valid_to) OVER w AS reach FROM mb WINDOW w AS (PARTITION BY instrument ORDER BY valid_from, valid_to NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) " + rows_of({"rows": "count(*)", "membership_identities": "count(DISTINCT instrument)", "invalid_intervals": "count(*) FILTER (valid_to <= valid_from)", "overlapping_intervals": "count(*) FILTER (coalesce(open_before, false) OR coalesce(reach > valid_from, false))", "missing_availability_rows": "count(*) FILTER (available_time IS NULL)", "late_availability_rows": "count(*) FILTER (available_time > valid_from)"}, "o"), with_panel=False)
def _(spark, sf_dir):
    e = pit.survivorship_diagnostics(membership(spark, sf_dir), identity=["instrument"])
    return metrics(spark, e.metrics, ["rows", "membership_identities", "invalid_intervals", "overlapping_intervals", "missing_availability_rows", "late_availability_rows"])


# Folds


@query("fold_evidence", "WITH " + CVR.format(k=4) + f", fold AS (SELECT g AS fold, max(i) AS last FROM gr GROUP BY g), ts AS (SELECT DISTINCT g AS fold, c.s, c.e FROM cvr c JOIN gr USING (t)), x AS (SELECT fold, c.t, gr.g = fold AS tested, EXISTS (SELECT 1 FROM ts WHERE ts.fold = f.fold AND c.s < ts.e AND c.e > ts.s) AS overlap, gr.i > last AND gr.i <= last + 2 AS embargo FROM cvr c JOIN gr USING (t) JOIN fold f ON true), ro AS (SELECT CAST(fold AS INT) AS fold, {ROLE} AS role, t FROM x) SELECT fold, role, CAST(min(t) AS VARCHAR) AS start, CAST(max(t) AS VARCHAR) AS \"end\", count(*) AS n FROM ro GROUP BY fold, role")
def _(spark, sf_dir):
    e = cv.PurgedKFold(4, embargo=2).split(_cv_rows(spark, sf_dir)).evidence
    return e.tables["folds"].where("n > 0").select("fold", "role", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


@query("combinatorial_paths", "SELECT CAST(p AS BIGINT) AS path, CAST(g AS BIGINT) AS \"group\", CAST(fold AS BIGINT) AS fold FROM (SELECT fold, g, row_number() OVER (PARTITION BY g ORDER BY fold) - 1 AS p FROM (SELECT fold, unnest([a, b]) AS g FROM (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM (SELECT unnest(range(0, 6)) AS a) JOIN (SELECT unnest(range(0, 6)) AS b) ON a < b)))", with_panel=False)
def _(spark, sf_dir):
    return spark.createDataFrame([(x["path"], x["group"], x["fold"]) for x in cv.CombinatorialPurgedKFold(6, 2).path_table()], "path long, group long, fold long")


# Robustness


@query("subperiod_analysis", f"WITH {SERIES}, p AS (SELECT 'early' AS period, DATE '1990-01-01' AS a, DATE '1994-01-01' AS b UNION ALL SELECT 'middle', DATE '1994-01-01', DATE '1996-01-01' UNION ALL SELECT 'late', DATE '1996-01-01', DATE '2030-01-01') SELECT period, {r('avg(value)')} AS objective FROM p LEFT JOIN sr ON time >= a AND time < b GROUP BY period")
def _(spark, sf_dir):
    cuts = {"early": (date(1990, 1, 1), date(1994, 1, 1)), "middle": (date(1994, 1, 1), date(1996, 1, 1)), "late": (date(1996, 1, 1), date(2030, 1, 1))}
    e = robustness.subperiod_analysis(lambda d: d.agg(F.avg("value")).collect()[0][0], data=series(spark, sf_dir), periods=cuts)
    return spark.createDataFrame([(x["period"], x["objective"]) for x in e.rows("subperiods")], "period string, objective double")


@query("universe_perturbation", f"WITH u AS (SELECT 'all' AS universe, instrument FROM one UNION SELECT 'even', instrument FROM one WHERE instrument % 2 = 0 UNION SELECT 'thirds', instrument FROM one WHERE instrument % 3 = 0) SELECT universe, count(DISTINCT u.instrument) AS size, {r('avg(y)')} AS objective, {r('count(DISTINCT u.instrument) * 1.0 / (SELECT count(DISTINCT instrument) FROM one)')} AS jaccard FROM u JOIN one ON one.instrument = u.instrument GROUP BY universe")
def _(spark, sf_dir):
    p = panel(spark, sf_dir, "1D").select("instrument", "y").persist()
    every = sorted(x["instrument"] for x in p.select("instrument").distinct().collect())
    sets = {"all": every, "even": [i for i in every if i % 2 == 0], "thirds": [i for i in every if i % 3 == 0]}
    e = robustness.universe_perturbation(lambda s: p.where(F.col("instrument").isin(list(s))).agg(F.avg("y")).collect()[0][0], universes=sets, baseline="all")
    p.unpersist()
    return spark.createDataFrame([(x["universe"], x["size"], x["objective"], x["jaccard"]) for x in e.rows("universes")], "universe string, size long, objective double, jaccard double")


@query("parameter_surface", f"WITH {SERIES}, grid AS (SELECT unnest([0.5, 1.0, 2.0]) AS scale, unnest([0.0]) AS z), g AS (SELECT scale, lag FROM (SELECT unnest([0.5, 1.0, 2.0]) AS scale) JOIN (SELECT unnest([1, 2]) AS lag) ON true), m AS (SELECT avg(value) AS v FROM sr) SELECT CAST(scale AS DOUBLE) AS scale, CAST(lag AS BIGINT) AS lag, {r('scale * v / lag')} AS objective FROM g JOIN m ON true")
def _(spark, sf_dir):
    mean = series(spark, sf_dir).agg(F.avg("value")).collect()[0][0]
    e = robustness.parameter_surface(lambda p: p["scale"] * mean / p["lag"], grid={"scale": [0.5, 1.0, 2.0], "lag": [1, 2]})
    found = next(iter(t for name, t in e.tables.items() if "surface" in name or "points" in name))
    rows = found if isinstance(found, list) else [x.asDict() for x in found.collect()]
    return spark.createDataFrame([(float(x["scale"]), int(x["lag"]), x["objective"]) for x in rows], "scale double, lag long, objective double")


# Decay


@query("decay_fit", "SELECT 0.08::DOUBLE AS amplitude, 6.5::DOUBLE AS tau, 1.0::DOUBLE AS r_squared", with_panel=False)
def _(spark, sf_dir):
    h = np.array([1.0, 2.0, 5.0, 10.0, 20.0])
    return spark.createDataFrame([decay.fit_exponential(h, 0.08 * np.exp(-h / 6.5))], "amplitude double, tau double, r_squared double")


# Sources


@query("vendor_schema", "SELECT l_suppkey AS instrument, l_extendedprice AS price, CAST(l_shipdate AS VARCHAR) AS available_time FROM lineitem WHERE l_linenumber = 1", with_panel=False)
def _(spark, sf_dir):
    schema = io.VendorSchema("line items", {"instrument": "l_suppkey", "price": "l_extendedprice", "available_time": "l_shipdate"}, ("instrument", "price"), availability="point_in_time")
    found = io.adapt_vendor(table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), schema).frame
    return found.select("instrument", "price", F.date_format("available_time", "yyyy-MM-dd HH:mm:ss").alias("available_time"))


@query("factor_panel", f"WITH p AS (SELECT time, instrument, x, y, sector FROM one) SELECT CAST(time AS VARCHAR) AS time, instrument, sector AS \"group\", {r('x')} AS signal, {r('y')} AS forward_return FROM p")
def _(spark, sf_dir):
    source = panel(spark, sf_dir, "1D").select(F.col("time").alias("date"), F.col("instrument").alias("asset"), F.col("x").alias("factor"), F.col("y").alias("1D"), F.col("sector").alias("group"))
    schema = io.FactorPanelSchema("factor panel", {"time": "date", "instrument": "asset", "signal": "factor", "forward_return": "1D", "group": "group"})
    return io.adapt_factor_panel(source, schema).frame.select(F.col("time").cast("string").alias("time"), "instrument", "group", "signal", "forward_return")


# Signal evidence


@query("ic_evidence", f"WITH p AS (SELECT time, {corr()} AS ic FROM one GROUP BY time HAVING count(*) >= 3) " + rows_of({"mean_ic": "avg(ic)", "n_periods": "count(ic)"}, "p"))
def _(spark, sf_dir):
    p = panel(spark, sf_dir, "1D")
    e = signal.ic(p.select("time", "instrument", F.col("x").alias("signal")), p.select(F.col("time").alias("observation_time"), "instrument", F.col("y").alias("forward_return")), method="pearson")
    return metrics(spark, e.metrics, ["mean_ic", "n_periods"])


@query("regime_evidence", f"WITH {SERIES}, g AS (SELECT time, CASE WHEN value < 0 THEN 'down' ELSE 'up' END AS regime, value, sum(value) OVER (PARTITION BY value < 0 ORDER BY time) AS cum FROM sr), d AS (SELECT *, cum - greatest(0, max(cum) OVER (PARTITION BY regime ORDER BY time)) AS down FROM g) SELECT regime, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('sum(value)')} AS total, {r('avg(CAST(value > 0 AS INT))')} AS hit_rate, {r('min(down)')} AS max_drawdown, {r('sum(abs(value)) / sum(sum(abs(value))) OVER ()')} AS absolute_share, {r('sum(sum(value)) OVER () - sum(value)')} AS leave_one_out_total FROM d GROUP BY regime")
def _(spark, sf_dir):
    data = series(spark, sf_dir).select("time", F.when(F.col("value") < 0, "down").otherwise("up").alias("regime"), F.col("value").alias("outcome"))
    return regime.analysis_frame(data).select("regime", F.col("valid_count").alias("n"), "mean", "std", "total", "hit_rate", "max_drawdown", "absolute_share", "leave_one_out_total")
