"""Closed-form inference: Sharpe ratios and multiple testing."""

from __future__ import annotations

from collections.abc import Sequence
from math import e as EULER
from math import isfinite, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import infinite, missing
from panelwright.registry import ExperimentRegistry
from panelwright.result import Evidence, Finding, Metadata, Severity, State

#: Fixed value: the Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329


def moment_frame(data: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, population skewness and Pearson kurtosis from four power sums."""
    clean = data.where(~missing(value))
    x = F.col(value).cast("double")
    a = (clean.groupBy(*by) if by else clean.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_pop(x).alias("v"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("k"))
    return a.select(*by, "n", "mean", "std", F.when(F.col("v") > 0, F.col("skewness")).alias("skewness"), F.when(F.col("v") > 0, F.col("k") + 3).alias("kurtosis"))


def sharpe_inference(data: DataFrame, *, value: str = "value", benchmark: float = 0.0, confidence_level: float = 0.95, annualization: float = 1.0, trial_sharpes: Sequence[float] | None = None, independent_trials: int | None = None, null_policy: str = "raise") -> Evidence:
    """Moment-adjusted error of a Sharpe ratio, its probability, and its deflation for the number of trials.

    All data work is one aggregate; the rest is a formula.  Ratios are
    reported annualised.
    """
    if not 0 < confidence_level < 1 or annualization <= 0:
        raise MethodContractError("the level must lie in (0, 1) and annualization be positive")
    C.require_columns(data, [value])
    c = C.checked(data, {"missing": missing(value), "infinite": infinite(value)})
    C.refuse(c, ["infinite", *(["missing"] if null_policy == "raise" else [])])
    m = moment_frame(data, value).collect()[0]
    if m["n"] < 3 or not m["std"]:
        raise DataContractError("at least three observations that are not constant are needed")
    root, normal = sqrt(annualization), NormalDist()
    s, n, g, k = m["mean"] / m["std"], m["n"], m["skewness"], m["kurtosis"]
    factor = 1 - g * s + (k - 1) / 4 * s * s
    if factor <= 0:
        raise DataContractError("the moments imply no variance of the ratio")
    error, base = sqrt(factor / (n - 1)), benchmark / root
    z = normal.inv_cdf((1 + confidence_level) / 2)
    psr = normal.cdf((s - base) / error)
    one_sided = normal.inv_cdf(confidence_level)
    record = 1 + factor * (one_sided / (s - base)) ** 2 if s > base else None
    deflated = threshold = trial_mean = trial_sd = None
    trials = independent_trials or (len(trial_sharpes) if trial_sharpes else None)
    if trial_sharpes and trials and trials >= 2:
        t = np.asarray(trial_sharpes, dtype=float) / root
        trial_mean, trial_sd = float(t.mean()), float(t.std(ddof=1))
        expected = (1 - EULER_GAMMA) * normal.inv_cdf(1 - 1 / trials) + EULER_GAMMA * normal.inv_cdf(1 - 1 / (trials * EULER))
        threshold = trial_mean + trial_sd * expected
        deflated = normal.cdf((s - threshold) / error)
    good = psr >= confidence_level
    finding = Finding("SHARPE_EXCEEDS_BENCHMARK" if good else "SHARPE_UNCERTAIN", "Sharpe ratio", f"Probability {psr:.4f}.", State.PASS if good else State.WARN, Severity.INFO if good else Severity.MEDIUM, "statistical_validity")
    up = lambda v: None if v is None else v * root
    metrics = {"observed_sharpe": up(s), "standard_error": up(error), "confidence_lower": up(s - z * error), "confidence_upper": up(s + z * error), "probabilistic_sharpe_ratio": psr, "minimum_track_record_observations": record if record is None or isfinite(record) else None, "deflated_sharpe_ratio": deflated, "deflated_sharpe_threshold": up(threshold), "trial_count": trials, "trial_sharpe_mean": up(trial_mean), "trial_sharpe_standard_deviation": up(trial_sd), "n_raw": c["rows"], "n_effective": n, "excluded_rows": c["rows"] - n, "mean": m["mean"], "standard_deviation": m["std"], "skewness": g, "kurtosis": k}
    return Evidence(Metadata("validation.sharpe_inference", parameters={"benchmark": benchmark}), metrics, (finding,), {"trial_sharpes": [{"trial": i, "sharpe": float(v)} for i, v in enumerate(trial_sharpes or ())]})


#: Equal parts of [0, 1] in which the step methods order p-values.
_PARTS = 1024
#: Trials up to which the harmonic number is summed; beyond it the expansion is exact to the last digit.
_SUMMED = 64


def _harmonic(m: Column) -> Column:
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(_SUMMED)).cast("int")), F.lit(0.0), lambda total, k: total + F.lit(1.0) / k)
    x = m.cast("double")
    return F.when(m <= _SUMMED, few).otherwise(F.log(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def adjusted_frame(data: DataFrame, *, p_value: str = "p_value", trial: str = "trial_id", method: str = "bh", alpha: float = 0.05, effective_trials: float | None = None) -> DataFrame:
    """``data`` with ``adjusted_p_value`` and ``rejected``; the p-values are not null.

    Trials with equal p-values have equal adjusted ones, so only distinct
    p-values with their counts are ordered: within equal parts of [0, 1], each
    offset by what the parts before it hold.  No window spans all trials; the
    one over the parts has ``_PARTS`` rows at most.
    """
    C.require_one_of(method, ("bonferroni", "holm", "bh", "by"), "method")
    p = F.col("__p")
    distinct = data.groupBy(F.col(p_value).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", F.least(F.floor(p * _PARTS), F.lit(_PARTS - 1)))
    if method == "bonferroni":
        total = data.agg(F.count(F.lit(1)).alias("__m"))
        out = data.crossJoin(F.broadcast(total)) if not effective_trials else data.withColumn("__m", F.lit(float(effective_trials)))
        return out.withColumn("adjusted_p_value", F.least(F.lit(1.0), F.col(p_value) * F.col("__m"))).drop("__m").withColumn("rejected", F.col("adjusted_p_value") <= alpha)
    parts, earlier = Window.partitionBy(), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = distinct.groupBy("__part").agg(F.sum("__n").alias("__k")).select("__part", F.coalesce(F.sum("__k").over(earlier), F.lit(0)).alias("__before"), F.sum("__k").over(parts).alias("__m"))
    rising = Window.partitionBy("__part").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    placed = distinct.join(F.broadcast(sizes), "__part").withColumn("__last", F.col("__before") + F.sum("__n").over(rising))
    m = F.col("__m")
    if method == "holm":
        # A run of equal values is led by its first, which has the largest factor; values never fall.
        placed = placed.withColumn("__raw", (m - F.col("__last") + F.col("__n")) * p)
        placed, pick, neighbours = placed.withColumn("__best", F.max("__raw").over(rising)), F.max, earlier
        bound = F.greatest
    else:
        # A run of equal values ends with its last, which has the smallest factor; values never rise on the way down.
        placed = placed.withColumn("__raw", p * m * (_harmonic(m) if method == "by" else F.lit(1.0)) / F.col("__last"))
        falling = Window.partitionBy("__part").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
        placed, pick, neighbours = placed.withColumn("__best", F.min("__raw").over(falling)), F.min, Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
        bound = F.least
    edges = placed.groupBy("__part").agg(pick("__raw").alias("__edge")).select("__part", pick("__edge").over(neighbours).alias("__beyond"))
    adjusted = placed.join(F.broadcast(edges), "__part").select("__p", F.least(F.lit(1.0), bound("__best", F.coalesce("__beyond", "__best"))).alias("adjusted_p_value"))
    return data.join(adjusted, F.col(p_value).cast("double") == p).drop("__p").withColumn("rejected", F.col("adjusted_p_value") <= alpha)


def registry_p_values(spark: SparkSession, registry: ExperimentRegistry, *, metric: str = "p_value", family: str | None = None) -> DataFrame:
    """``trial_id, p_value`` of the latest attempt of every trial; refused unless each of these completed with the metric."""
    latest = {a["trial_id"]: a for a in registry.attempts(family)}
    values = {t: a["metrics"].get(metric) if a["status"] == "completed" else None for t, a in latest.items()}
    if open_ := sum(v is None for v in values.values()):
        raise DataContractError(f"{open_} trials have no completed latest attempt with {metric}")
    return spark.createDataFrame([(t, float(v)) for t, v in sorted(values.items())], "trial_id string, p_value double")


def multiple_testing(data: DataFrame | ExperimentRegistry, *, p_value: str = "p_value", trial: str = "trial_id", method: str = "bh", alpha: float = 0.05, effective_trials: float | None = None, null_policy: str = "raise") -> Evidence:
    """Adjusted p-values of a family of trials, given as a frame or by the record of their attempts."""
    if isinstance(data, ExperimentRegistry):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise MethodContractError("a registry needs an active session")
        data, p_value, trial = registry_p_values(spark, data, metric=p_value), "p_value", "trial_id"
    if not 0 < alpha < 1 or effective_trials is not None and (method != "bonferroni" or effective_trials < 1):
        raise MethodContractError("alpha must lie in (0, 1); effective trials go with bonferroni only")
    C.require_columns(data, [p_value, trial])
    c = C.checked(data, {"missing": missing(p_value), "outside [0, 1]": (F.col(p_value) < 0) | (F.col(p_value) > 1)})
    C.refuse(c, ["outside [0, 1]", *(["missing"] if null_policy == "raise" else [])])
    C.require_unique(data, [trial])
    table = adjusted_frame(data.where(~missing(p_value)), p_value=p_value, trial=trial, method=method, alpha=alpha, effective_trials=effective_trials).persist()
    n, rejected = table.agg(F.count(F.lit(1)), F.count_if("rejected")).collect()[0]
    code, state, severity = ("MULTIPLE_TESTING_DISCOVERIES", State.PASS, Severity.INFO) if rejected else ("MULTIPLE_TESTING_NO_DISCOVERY", State.WARN, Severity.MEDIUM)
    metrics = {"trial_count": n, "rejected_count": rejected, "rejected_fraction": rejected / n if n else None, "alpha": alpha, "excluded_rows": c["rows"] - n}
    return Evidence(Metadata(f"validation.multiple_testing.{method}", parameters={"effective_trials": effective_trials}), metrics, (Finding(code, "Multiple testing", f"{rejected} of {n}.", state, severity, "statistical_validity"),), {"adjusted_p_values": table})
