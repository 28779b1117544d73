"""Projection of buckets to target weights, and what the weights earn and turn over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import average_rank, herfindahl, missing
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State, attrition


def weight_frame(panel: DataFrame, *, long_buckets: Sequence[int], short_buckets: Sequence[int], weighting: str = "equal", gross: float = 1.0, net: float = 0.0, group: str | None = None) -> DataFrame:
    """``time, instrument, bucket, x, y[, group]`` to the same with ``leg``, ``weight`` and ``contribution``.

    Only groups with both legs take part.  A leg's allocation is split equally
    over a cohort's groups and within a group by score; where the scores of a
    leg sum to zero it falls back to equal (``fallback``).
    """
    g = [group] if group else []
    leg = F.when(F.col("bucket").isin(list(long_buckets)), 1).when(F.col("bucket").isin(list(short_buckets)), -1)
    in_group = Window.partitionBy("time", *g)
    rows = panel.withColumn("leg", leg).where("leg is not null")
    rows = rows.withColumn("complete", F.bool_or(F.col("leg") == 1).over(in_group) & F.bool_or(F.col("leg") == -1).over(in_group)).where("complete").drop("complete")
    part = ["time", *g, "leg"]
    if weighting == "equal":
        score = F.lit(1.0)
    elif weighting == "rank":
        score = average_rank(F.col("leg") * F.col("x"), part)
    else:
        score = F.abs("x")
    over = Window.partitionBy(*part)
    rows = rows.withColumn("score", score)
    total = F.sum("score").over(over)
    share = F.when(total > 0, F.col("score") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count(F.lit(1)).over(over))
    rows = rows.withColumns({"share": share, "fallback": ~(total > 0)})
    if group:
        groups = rows.select("time", group).distinct().groupBy("time").agg(F.count(F.lit(1)).alias("groups"))
        rows = rows.join(groups, "time")
    else:
        rows = rows.withColumn("groups", F.lit(1))
    allocation = F.when(F.col("leg") == 1, (gross + net) / 2).otherwise((gross - net) / 2)
    rows = rows.withColumn("weight", F.col("leg") * F.col("share") * allocation / F.col("groups"))
    return rows.withColumn("contribution", F.col("weight") * F.col("y")).drop("score", "share", "groups")


def cohort_frame(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy("time").agg(
        F.sum("contribution").alias("cohort_return"),
        F.sum(F.abs(w)).alias("gross_exposure"),
        F.sum(w).alias("net_exposure"),
        F.count_if(w > 0).alias("n_long"),
        F.count_if(w < 0).alias("n_short"),
        herfindahl(F.abs(w)).alias("hhi"),
    )


def turnover_frame(weights: DataFrame) -> DataFrame:
    """One-way turnover between consecutive cohorts: half the absolute changes over the union of instruments."""
    periods = weights.select("time").distinct().withColumn("p", F.row_number().over(Window.orderBy("time")))
    held = weights.join(periods, "time").select("p", "instrument", "weight")
    # Each weight counts for its own cohort and, negated, for the next one.
    moves = held.unionByName(held.select((F.col("p") + 1).alias("p"), "instrument", (-F.col("weight")).alias("weight")))
    net = moves.groupBy("p", "instrument").agg(F.sum("weight").alias("change"))
    turnover = net.groupBy("p").agg((F.sum(F.abs("change")) / 2).alias("one_way_turnover"))
    return turnover.join(periods, "p").where("p > 1").select("time", "one_way_turnover")


def portfolio_projection(bucketed: DataFrame, labels: DataFrame, *, horizon: str, long_buckets: Sequence[int], short_buckets: Sequence[int], weighting: str = "equal", gross_exposure: float = 1.0, net_exposure: float = 0.0, group_neutral: str | None = None, incomplete_group_policy: str = "raise", time: str = "time", instrument: str = "instrument", signal_value: str = "signal") -> FrameResult:
    """Target weights of a long-short projection of one horizon and the evidence about them."""
    C.require_one_of(weighting, ("equal", "rank", "signal"), "weighting")
    C.require_one_of(incomplete_group_policy, ("raise", "drop"), "incomplete_group_policy")
    if gross_exposure <= 0 or abs(net_exposure) > gross_exposure or set(long_buckets) & set(short_buckets) or not long_buckets or not short_buckets:
        raise MethodContractError("legs must be disjoint and not empty, gross positive and net within gross")
    C.require_columns(bucketed, [time, instrument, "bucket", signal_value, *([group_neutral] if group_neutral else [])], "bucketed")
    C.require_columns(labels, ["observation_time", "instrument", "horizon", "forward_return"], "labels")
    one = labels.where(F.col("horizon") == horizon).select(F.col("observation_time").alias("time"), "instrument", F.col("forward_return").alias("y"))
    C.require_unique(one, ["time", "instrument"], "labels")
    source = bucketed.select(F.col(time).alias("time"), F.col(instrument).alias("instrument"), "bucket", F.col(signal_value).cast("double").alias("x"), *([F.col(group_neutral)] if group_neutral else []))
    rows = source.count()
    joined = source.join(one, ["time", "instrument"]).persist()
    counts = C.checked(joined, {"bad": missing("x") | missing("y")})
    clean = joined.where(~(missing("x") | missing("y")))
    weights = weight_frame(clean, long_buckets=long_buckets, short_buckets=short_buckets, weighting=weighting, gross=gross_exposure, net=net_exposure, group=group_neutral).persist()
    in_legs = clean.where(F.col("bucket").isin([*long_buckets, *short_buckets])).count()
    kept, fallback = weights.agg(F.count(F.lit(1)), F.count_if("fallback")).collect()[0]
    if kept < in_legs and incomplete_group_policy == "raise":
        raise DataContractError(f"{in_legs - kept} rows lie in groups without both legs")
    cohorts = cohort_frame(weights).persist()
    off = cohorts.where((F.abs(F.col("gross_exposure") - gross_exposure) > 1e-10) | (F.abs(F.col("net_exposure") - net_exposure) > 1e-10)).count()
    if off:
        raise DataContractError(f"the exposure of {off} cohorts does not reconcile")
    turned = turnover_frame(weights)
    mean = cohorts.agg(F.avg("cohort_return"), F.count(F.lit(1))).collect()[0]
    findings = []
    if kept < in_legs:
        findings.append(Finding("PORTFOLIO_INCOMPLETE_GROUPS_EXCLUDED", "Incomplete groups left out", f"{in_legs - kept} rows lie in groups without both legs.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    if fallback:
        findings.append(Finding("PORTFOLIO_ZERO_SIGNAL_FALLBACK", "Equal weights used", f"{fallback} rows lie in legs whose scores sum to zero.", State.WARN, Severity.LOW, "statistical_validity"))
    metrics = {"n_rows": kept, "n_cohorts": mean[1], "matched_rows": counts["rows"], "excluded_alignment_rows": rows - counts["rows"], "excluded_non_finite_rows": counts["bad"], "excluded_incomplete_group_rows": in_legs - kept, "mean_cohort_return": mean[0], "mean_one_way_target_turnover": turned.agg(F.avg("one_way_turnover")).collect()[0][0]}
    tables = {"exposure_reconciliation": cohorts.select("time", "gross_exposure", "net_exposure"), "cohort_returns": cohorts.select("time", "cohort_return"), "coverage": cohorts.select("time", "n_long", "n_short"), "concentration": cohorts.select("time", "hhi"), "target_weight_turnover": turned, "data_attrition": [attrition("alignment", "no label", input_rows=rows, retained_rows=counts["rows"], policy="drop")]}
    return FrameResult(weights, Evidence(Metadata("signal.portfolio_projection", parameters={"horizon": horizon, "weighting": weighting}), metrics, tuple(findings), tables))
