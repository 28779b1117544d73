import numpy as np
import pandas as pd
import pytest

from panelwright.errors import DataContractError, MethodContractError
from panelwright.operators import decay, labels, portfolio, signal, transform
from panelwright.operators.study import SignalStudy
from panelwright.operators.transform import BucketSpec


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(t, i, 10.0 + t + 0.5 if i == "A" else 20.0 - t, 10.5 + t if i == "A" else 20.5 - t) for t in range(4) for i in "AB"]
    return spark.createDataFrame(rows, "time long, instrument string, open double, close double")


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    rows = [(t, f"i{k:02d}", float(k + 0.01 * np.sin(t)), ["x", "y"][k % 2], float(0.01 * k + 0.002 * r.normal())) for t in range(24) for k in range(12)]
    return spark.createDataFrame(rows, "time long, instrument string, signal double, sector string, ret double")


@pytest.fixture(scope="module")
def label_table(panel):
    from pyspark.sql import functions as F

    return panel.select(F.col("time").alias("observation_time"), F.col("time").alias("label_start"), F.col("time").alias("entry_time"), (F.col("time") + 1).alias("label_end"), "instrument", F.lit("1D").alias("horizon"), F.col("ret").alias("forward_return"))


def test_forward_returns_known_answer(prices):
    found = labels.forward_returns(prices, horizons=[1, 2], entry="current_close", allow_same_close=True)
    rows = {(r.observation_time, r.instrument, r.horizon): r.forward_return for r in found.frame.collect()}
    assert rows[0, "A", "2D"] == pytest.approx(12.5 / 10.5 - 1)
    assert len(rows) == 10 and found.evidence.metrics["censored_rows"] == 6
    assert found.evidence.codes() == {"PRICE_ADJUSTMENT_UNKNOWN", "DELISTING_RETURNS_UNKNOWN"}


def test_same_close_is_refused(prices):
    with pytest.raises(MethodContractError):
        labels.forward_returns(prices, entry="current_close")


def test_duplicate_prices_are_refused(prices):
    with pytest.raises(DataContractError):
        labels.forward_returns(prices.unionByName(prices), horizons=2)


def test_delisting_return_fills_a_missing_exit(spark):
    df = spark.createDataFrame([(0, "A", 10.0, None), (1, "A", None, -0.9), (2, "A", None, None)], "time long, instrument string, close double, dl double")
    got = labels.forward_returns(df, horizons=1, entry="current_close", allow_same_close=True, delisting_return="dl").frame.collect()
    assert [(r.observation_time, r.forward_return) for r in got] == [(0, -0.9)]


def test_spearman_of_ties(spark):
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip((1, 2, 2, 4), (1, 2, 3, 4), strict=True)], "time long, x double, y double")
    assert signal.ic_frame(df).collect()[0].ic == pytest.approx(0.9486832980505138)


def test_ic_matches_pandas_and_pooled_is_not_the_mean(panel, label_table):
    found = signal.ic(panel, label_table, by=["time", "sector"])
    p = panel.toPandas()
    want = p.groupby("time").apply(lambda g: g["signal"].rank().corr(g["ret"].rank()), include_groups=False)
    got = {r["time"]: r["ic"] for r in found.rows("ic_overall_by_period")}
    assert got == pytest.approx(want.to_dict())
    assert found.metrics["mean_ic"] == pytest.approx(want.mean())
    assert "GROUP_AVAILABILITY_UNKNOWN" in found.codes()


def test_constant_signal_is_undefined_not_nan(panel, label_table):
    from pyspark.sql import functions as F

    found = signal.ic(panel.withColumn("signal", F.lit(1.0)), label_table)
    assert found.metrics["mean_ic"] is None and found.metrics["undefined_groups"] == 24
    assert "IC_UNDEFINED_GROUPS" in found.codes() and "NaN" not in found.to_json()


def test_quantile_buckets_differ_from_ntile(spark):
    df = spark.createDataFrame([(0, f"i{k}", float(k)) for k in range(7)], "time long, instrument string, signal double")
    got = transform.bucketize(df, spec=BucketSpec.quantiles(3)).frame.groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == [2, 3, 2]


def test_small_groups_raise_or_drop(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 1.0)], "time long, instrument string, signal double")
    with pytest.raises(DataContractError):
        transform.bucketize(df, spec=BucketSpec.quantiles(2))
    kept = transform.bucketize(df, spec=BucketSpec.quantiles(2), small_group_policy="drop")
    assert kept.frame.count() == 2 and kept.evidence.metrics["excluded_bucket_rows"] == 1


def test_neutralize_is_least_squares(panel):
    from pyspark.sql import functions as F

    df = panel.withColumn("beta", F.col("ret") * 3 + F.col("signal") * 0.1)
    found = transform.neutralize(df, exposures=["beta", "sector"], categorical=["sector"])
    p = found.frame.toPandas()
    for _, g in p.groupby("time"):
        x = np.column_stack([np.ones(len(g)), g["beta"], (g["sector"] == "y").astype(float)])
        want = g["signal"] - x @ np.linalg.lstsq(x, g["signal"], rcond=None)[0]
        assert np.allclose(g["residual"], want)
    single = transform.single_exposure_frame(df, by=["time"], exposure="beta").toPandas()
    assert np.allclose(single.groupby("time")["residual"].sum(), 0, atol=1e-9)


def test_projection_reconciles(panel, label_table):
    bucketed = transform.bucketize(panel, spec=BucketSpec.quantiles(4)).frame
    found = portfolio.portfolio_projection(bucketed, label_table, horizon="1D", long_buckets=[4], short_buckets=[1], weighting="rank", group_neutral="sector")
    w = found.frame.toPandas()
    assert np.allclose(w.groupby("time")["weight"].apply(lambda x: x.abs().sum()), 1.0)
    assert np.allclose(w.groupby("time")["weight"].sum(), 0.0)
    wide = w.pivot(index="time", columns="instrument", values="weight").fillna(0)
    want = wide.diff().abs().sum(axis=1).iloc[1:] / 2
    assert found.evidence.metrics["mean_one_way_target_turnover"] == pytest.approx(want.mean())


def test_turnover_needs_the_exact_lag(spark):
    rows = [(t, i, float(k)) for t in range(4) for k, i in enumerate("abcd") if not (i == "a" and t == 1)]
    found = signal.turnover(spark.createDataFrame(rows, "time long, instrument string, signal double"), quantiles=2, lags=[1, 2])
    common = {(r["time"], r["lag"]): r["n_common"] for r in found.rows("turnover_by_period_lag")}
    assert common == {(1, 1): 3, (2, 1): 3, (3, 1): 4, (2, 2): 4, (3, 2): 3}


def test_decay_fit_recovers_the_half_life(spark):
    r = np.random.default_rng(0)
    rows = [(t, f"{h}D", float(0.1 * np.exp(-h / 8.0) + 0.002 * r.normal())) for t in range(60) for h in (1, 2, 5, 10, 20)]
    from panelwright.result import Evidence, Metadata

    ev = Evidence(Metadata("signal.decay"), {}, (), {"ic_by_period_horizon": [{"time": t, "horizon": h, "ic": v, "n": 10} for t, h, v in rows]})
    fit = decay.fit_decay(ev, resamples=200, seed=1)
    assert fit.metrics["tau"] == pytest.approx(8.0, rel=0.1)
    assert fit.metrics["half_life_lower"] < 8 * np.log(2) < fit.metrics["half_life_upper"]
    short = Evidence(Metadata("signal.decay"), {}, (), {"ic_by_period_horizon": [x for x in ev.tables["ic_by_period_horizon"] if x["horizon"] in ("1D", "2D")]})
    assert decay.fit_decay(short, resamples=200).metrics["half_life"] is None


def test_study_audit(panel, label_table):
    study = SignalStudy(panel.select("time", "instrument", "signal"), labels_data=label_table)
    found = study.audit(horizon="1D", quantiles=3, resamples=200)
    assert 0 <= found.metrics["robustness_score"] <= 100 and found.metrics["finding_count"] == 13
    assert pd.DataFrame(found.rows("score_components"))["possible_weight"].sum() == found.metrics["possible_weight"]
