from itertools import combinations

import numpy as np
import pytest

from panelwright import audit, report
from panelwright.config import config, get_config, parse_memory
from panelwright.errors import DataContractError, MethodContractError, ReportError
from panelwright.operators import costs, infer, options, regime, resample, robustness
from panelwright.registry import ExperimentRegistry, canonical_json, fingerprint, frame_fingerprint
from panelwright.result import Evidence
from panelwright.sources import io


@pytest.fixture(scope="module")
def series(spark):
    x = np.random.default_rng(5).normal(0.05, 1, 60)
    return x, spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "time long, value double").repartition(3)


@pytest.fixture(scope="module")
def matrix(spark):
    x = np.random.default_rng(6).normal(0, 1, (32, 4)) + [0, 0, 0, 0.6]
    return x, spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "time long, a double, b double, c double, d double")


@pytest.mark.parametrize("method", ["iid", "stationary", "moving", "circular"])
def test_bootstrap_follows_its_streams(series, method):
    x, df = series
    found = resample.bootstrap(df, time="time", method=method, resamples=120, seed=9, store_distribution=True)
    want = [x[resample.bootstrap_index(60, method, 4, resample.stream(9, 1, i))].mean() for i in range(120)]
    assert [r["value"] for r in found.rows("resample_distribution")] == pytest.approx(want)
    assert found.metrics["confidence_lower"] == pytest.approx(np.quantile(want, 0.025))


def test_permutation_counts_exceedances(series):
    x, df = series
    found = resample.permutation_test(df, permutations=150, seed=3)
    want = sum(abs((x * resample.stream(3, 2, i).choice([-1, 1], size=60)).mean()) >= abs(x.mean()) for i in range(150))
    assert found.metrics["exceedances"] == want and found.metrics["p_value"] == (want + 1) / 151
    with pytest.raises(MethodContractError):
        resample.permutation_test(df, scheme="unrestricted")


def test_overfitting_matches_slices(matrix):
    x, df = matrix
    found = resample.probability_of_backtest_overfitting(df, partitions=4)
    parts, logits = np.split(x, 4), []
    sharpe = lambda m: m.mean(axis=0) / m.std(axis=0, ddof=1)
    for c in combinations(range(4), 2):
        a, b = sharpe(np.concatenate([parts[k] for k in c])), sharpe(np.concatenate([parts[k] for k in range(4) if k not in c]))
        rank = (b <= b[a.argmax()]).sum() / 5
        logits.append(np.log(rank / (1 - rank)))
    assert found.metrics["pbo"] == pytest.approx(np.mean(np.array(logits) <= 0)) and found.metrics["n_combinations"] == 6


def test_reality_check_and_spa(matrix):
    x, df = matrix
    found = resample.reality_check(df, resamples=200, seed=4)
    means = np.array([x[resample.joint_index(32, 3, resample.stream(4, 4, i))].mean(axis=0) for i in range(200)])
    draws = np.maximum(0, (np.sqrt(32) * (means - x.mean(axis=0))).max(axis=1))
    assert found.metrics["exceedances"] == (draws >= np.sqrt(32) * x.mean(axis=0).max()).sum() and found.metrics["best_strategy"] == "d"
    spa = resample.superior_predictive_ability(df, resamples=200, seed=4).metrics
    assert spa["p_value_lower"] <= spa["p_value_consistent"] <= spa["p_value_upper"]
    i = np.arange(1, 32)
    k = (32 - i) / 32 * (1 - 1 / 3) ** i + i / 32 * (1 - 1 / 3) ** (32 - i)
    y = x[:, 0] - x[:, 0].mean()
    want = (y @ y) / 32 + 2 * sum(k[j - 1] * (y[:-j] @ y[j:]) / 32 for j in i)
    assert resample.long_run_variance(x, 3)[0] == pytest.approx(want)
    joint = resample.joint_stationary_bootstrap(df, resamples=100, seed=1)
    assert len(joint.rows("long_run_covariance")) == 16


def test_sharpe_formulas(series):
    x, df = series
    m = infer.sharpe_inference(df, trial_sharpes=[0.1, 0.2, 0.0], annualization=4).metrics
    s = x.mean() / x.std(ddof=1)
    z = (x - x.mean()) / x.std()
    v = 1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s
    assert m["observed_sharpe"] == pytest.approx(2 * s) and m["standard_error"] == pytest.approx(2 * np.sqrt(v / 59))
    assert 0 < m["deflated_sharpe_ratio"] < 1


@pytest.mark.parametrize(("method", "want"), [("bonferroni", [0.04, 0.16, 0.12, 0.8]), ("holm", [0.04, 0.09, 0.09, 0.2]), ("bh", [0.04, 0.16 / 3, 0.16 / 3, 0.2]), ("by", [1 / 12, 1 / 9, 1 / 9, 5 / 12])])
def test_multiple_testing(spark, method, want):
    df = spark.createDataFrame([(f"t{k}", p) for k, p in enumerate([0.01, 0.04, 0.03, 0.2])], "trial_id string, p_value double")
    got = {r["trial_id"]: r["adjusted_p_value"] for r in infer.multiple_testing(df, method=method).rows("adjusted_p_values")}
    assert [got[f"t{k}"] for k in range(4)] == pytest.approx(want)


def test_regimes(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=80)
    x[[5, 40]] = np.nan
    df = spark.createDataFrame([(k, None if v != v else float(v)) for k, v in enumerate(x)], "time long, value double")
    for method, window in (("expanding", None), ("rolling", 20), ("retrospective", None)):
        got = regime.threshold_frame(df, method=method, lower=0.3, upper=0.7, min_history=10, window=window).orderBy("time").toPandas()
        for k, row in got.iterrows():
            past = x if method == "retrospective" else x[max(0, k - window) : k] if window else x[:k]
            past = past[~np.isnan(past)]
            assert row["history_count"] == len(past)
            want = np.quantile(past, [0.3, 0.7]) if method == "retrospective" or len(past) >= 10 else [np.nan, np.nan]
            assert np.allclose([row["threshold_lower"], row["threshold_upper"]], want, equal_nan=True)
    df = df.where("value is not null")
    found = regime.quantile_regimes(df, min_history=3)
    assert found.evidence.metrics["unknown_rows"] == 3
    out = spark.createDataFrame([(k, "ordinary" if k < 10 else "rare", 1.0 if k < 10 else 10.0) for k in range(12)], "time long, regime string, outcome double")
    rows = {r["regime"]: r for r in regime.regime_analysis(out, min_observations=1).rows("conditional_evidence")}
    assert rows["rare"]["absolute_share"] == pytest.approx(2 / 3) and rows["rare"]["leave_one_out_total"] == 10


@pytest.fixture(scope="module")
def trades(spark):
    rows = [(0, 1, "A", "buy", 10.0, 100.0, 100.0, 5.0, 10000.0, 0.2, None, 3.0), (0, 2, "B", "Sell", -20.0, 50.0, 50.0, 8.0, None, 0.1, 0.05, 10.0)]
    return spark.createDataFrame(rows, "decision_time long, execution_time long, instrument string, side string, quantity double, price double, reference_price double, gross_pnl double, adv double, volatility double, borrow_rate double, holding_days double")


def test_cost_models(trades):
    from pyspark.sql import functions as F

    models = costs.CompositeCostModel((costs.CommissionModel(bps=10), costs.SpreadModel(bps=20), costs.SquareRootImpactModel(1.0, max_participation=0.0001), costs.BorrowCostModel()))
    found = costs.estimate(trades, models, currency="USD")
    m = found.evidence.metrics
    assert m["component_totals"]["commission"] == pytest.approx(2.0) and m["component_totals"]["borrow"] == pytest.approx(1000 * 0.05 * 10 / 365)
    assert m["unknown_rows"] == 1 and m["total_cost"] is None and "COST_PARTICIPATION_LIMIT_EXCEEDED" in found.evidence.codes()
    for bad in (F.col("quantity") * -1, F.lit(float("inf"))):
        with pytest.raises(DataContractError):
            costs.canonical_trades(trades.withColumn("quantity", bad))
    with pytest.raises(DataContractError):
        costs.estimate(found.frame.drop("total_cost"), models, currency="USD")


def test_surfaces(spark, trades):
    s = costs.stress(trades, spread_bps=[0, 10], slippage_bps=[0, 5], period="execution_time", capital=1000.0)
    rows = {(r["spread_bps"], r["slippage_bps"]): r["net_pnl"] for r in s.rows("stress_surface")}
    assert rows == pytest.approx({(0, 0): 13.0, (0, 5): 12.0, (10, 0): 12.0, (10, 5): 11.0})
    even = costs.break_even_cost(trades, upper_bps=200)
    assert even.metrics["status"] == "converged" and even.metrics["solution_bps"] == pytest.approx(65, abs=0.01)
    one = trades.where("instrument = 'A'").select("*").drop("price", "reference_price", "quantity").selectExpr("*", "10.0D as price", "10.0D as reference_price", "100.0D as quantity")
    c = costs.capacity_curve(one, capital=[1000.0, 4000.0], base_capital=1000.0, max_participation=0.02)
    assert [r["impact_cost"] for r in c.rows("capacity_curve")] == pytest.approx([20.0, 160.0]) and "COST_CAPACITY_CONSTRAINT_BREACH" in c.codes()
    assert costs.liquidity_diagnostics(trades).metrics["unknown_rows"] == 1


def test_options(spark):
    from datetime import date

    rows = [(date(2024, 1, 1), "c", "U", date(2024, 7, 1), 100.0, "call", 4.0, 6.0, 95.0, 0.05, 0.01, 0.5, 0.2, 0.19), (date(2024, 1, 1), "p", "U", date(2024, 7, 1), 90.0, "put", 2.0, 4.0, 95.0, 0.05, 0.01, -1.0, 0.3, 0.31)]
    df = spark.createDataFrame(rows, "time date, instrument string, underlying string, expiration date, strike double, option_type string, bid double, ask double, underlying_price double, rate double, dividend double, delta double, iv double, expected_iv double")
    chain = options.validate_chain(df)
    got = {r.instrument: r for r in chain.frame.collect()}
    assert (got["c"].mid, got["p"].mid) == (5.0, 3.0) and got["c"].forward == pytest.approx(95 * np.exp(0.04 * 182 / 365.25))
    assert {r.delta_bucket for r in options.delta_buckets(chain).frame.collect()} == {"[0.4,0.6)", "[0.9,1]"}
    assert options.empirical_residual(chain).evidence.metrics["rmse"] == pytest.approx(0.01)
    with pytest.raises(DataContractError):
        options.validate_chain(df.selectExpr("* except (bid)", "9.0D as bid"))


def test_robustness(spark):
    peak = robustness.parameter_surface(lambda p: {"objective": 10.0 if p["a"] == 2 else 1.0 + 0.01 * p["a"]}, grid={"a": [0, 1, 2, 3, 4]})
    assert "PARAMETER_ISOLATED_OPTIMUM" in peak.codes() and peak.metrics["plateau_width"] == 1
    draws = robustness.continuous_perturbation(lambda p: p["a"], selected_parameters={"a": 1.0}, perturbations={"a": {"scale": 1.0, "lower": 0.0}}, draws=50, seed=1)
    assert draws.metrics["accepted_samples"] == 50 and draws.metrics["rejected_samples"] > 0
    df = spark.createDataFrame([(k, float(k - 3)) for k in range(10)], "time long, v double")
    sub = robustness.subperiod_analysis(lambda d: d.agg({"v": "sum"}).collect()[0][0], data=df, periods={"a": (0, 3), "b": (3, 10)})
    assert sub.metrics["sign_consistency"] == 0.5 and "SUBPERIOD_SIGN_INSTABILITY" in sub.codes()
    uni = robustness.universe_perturbation(lambda s: len(s), universes={"x": "AB", "y": "BC"}, baseline="x")
    assert uni.metrics["minimum_composition_jaccard"] == pytest.approx(1 / 3)


def test_registry_and_fingerprints(spark):
    reg = ExperimentRegistry()
    a = reg.record("f", "n", parameters={"x": 1})
    reg.record("f", "n", parameters={"x": 2}, status="failed")
    reg.record_selection("f", selected=[a], eligible=[a], reason="best")
    assert reg.to_result().metrics["attempt_count"] == 2
    with pytest.raises(MethodContractError):
        reg.record("f", "other", parameters={"x": 1}, supersedes=a)
    with pytest.raises(Exception, match="append only"):
        reg._db.execute("DELETE FROM attempts")
    assert canonical_json({"b": -0.0, "a": [1]}) == '{"a":[1],"b":0.0}' and fingerprint(1) != fingerprint(1, namespace="x")
    with pytest.raises(DataContractError):
        canonical_json({"api_key": "x"})
    df = spark.range(50).selectExpr("id", "cast(id % 7 as string) s")
    assert frame_fingerprint(df) == frame_fingerprint(df.orderBy("s").repartition(3)) != frame_fingerprint(df.where("id > 0"))


def test_documents_and_bundles(series, tmp_path):
    _, df = series
    found = resample.bootstrap(df, method="iid", resamples=100, seed=1)
    assert Evidence.from_json(found.to_json()).to_dict() == found.to_dict()
    with pytest.raises(DataContractError):
        Evidence.from_json(found.to_json().replace('"metrics"', '"x": 1, "metrics"', 1))
    rep = report.AuditReport(audit.audit(results={"b": found}))
    assert "<script" not in rep.to_html() and rep.to_markdown().startswith("# audit")
    one, two = tmp_path / "a.zip", tmp_path / "b.zip"
    rep.bundle(one, configuration={"password": "x", "p": "/home/me/x"}), rep.bundle(two, configuration={"password": "x", "p": "/home/me/x"})
    assert one.read_bytes() == two.read_bytes() and b"/home/me" not in one.read_bytes()
    report.verify_bundle(one)
    data = bytearray(one.read_bytes())
    at = data.index(b"finding_count")
    data[at] ^= 1
    two.write_bytes(bytes(data))
    with pytest.raises(ReportError):
        report.verify_bundle(two)
    with pytest.raises(ReportError):
        rep.bundle(one)


def test_multiple_testing_of_a_registry(spark):
    from panelwright.registry import ExperimentRegistry

    book = ExperimentRegistry()
    first = book.record("f", "a", parameters={"k": 1}, metrics={"p_value": 0.9})
    book.record("f", "a", parameters={"k": 1}, metrics={"p_value": 0.01}, supersedes=first)
    book.record("f", "b", parameters={"k": 2}, metrics={"p_value": 0.04})
    found = infer.multiple_testing(book, method="holm")
    assert found.metrics["trial_count"] == 2 and sorted(x["adjusted_p_value"] for x in found.rows("adjusted_p_values")) == pytest.approx([0.02, 0.04])
    book.record("f", "c", parameters={"k": 3}, status="failed")
    with pytest.raises(DataContractError):
        infer.multiple_testing(book)
    book.close()


def test_views_choose_tables():
    from panelwright.result import Metadata

    e = Evidence(Metadata("signal.decay"), {}, (), {"other": [], "ic_decay": [{"horizon": "1D", "mean_ic": 0.1}]})
    assert report.resolved_view(e) == "signal" and report.view_tables(e) == ["ic_decay"] and report.view_tables(e, "event") == ["other", "ic_decay"]
    assert report.resolved_view(audit.audit(results={"w": Evidence(Metadata("events.event_windows"), {})})) == "event" and report.resolved_view(audit.audit()) == "audit"
    with pytest.raises(ReportError):
        report.resolved_view(e, "pie")


def test_diagnostics_have_states(spark):
    from panelwright.config import diagnose_installation

    found = diagnose_installation(spark)
    assert found.metrics["usable"] and found.metrics["check_count"] == len(found.findings) == 12 and "SHARED_FOLDER" in found.codes()


def test_duckdb_batches_are_spooled(spark, tmp_path):
    import duckdb

    got = io.from_duckdb(duckdb.sql("SELECT range AS x, range % 3 AS y FROM range(5000)"), spark, required=["x"], batch_size=2048, spool=str(tmp_path))
    assert got.evidence.metrics["row_count"] == 5000 and got.frame.agg({"x": "sum"}).collect()[0][0] == 5000 * 4999 // 2
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 4
    assert io.from_duckdb(duckdb.sql("SELECT 1 AS x WHERE false"), spark, spool=str(tmp_path)).frame.count() == 0


def test_addresses_lose_their_credentials():
    got = report.redacted({"a": "see https://me:pw@host.example/x/y?token=1#z and s3://bucket/k", "url": ["ftp://u@h/p"]})
    assert got == {"a": "see https://host.example/x/y and s3://bucket/k", "url": ["ftp://h/p"]}


def test_audit_rules_score_by_weight():
    from panelwright.result import Metadata

    ev = lambda method, metrics=None, **tables: Evidence(Metadata(method), metrics or {}, (), tables)
    results = {
        "ic": ev("signal.ic.spearman", {"mean_ic": 0.1, "n_periods": 30}),
        "quantiles": ev("signal.quantiles", {"spearman_monotonicity": 0.3}),
        "bootstrap": ev("validation.bootstrap.iid", {"confidence_lower": 0.01, "confidence_upper": 0.2, "n_raw": 40}),
        "decay": ev("signal.decay", ic_decay=[{"horizon": h, "mean_ic": 0.1 if h < 5 else None} for h in (1, 2, 5)]),
        "labels": ev("labels.forward_returns"),
        "split": ev("cv.walk_forward"),
    }
    found = audit.audit(results=results, policies={"study_type": "signal", "survivorship_safe": True, "trial_history_available": False})
    state = {f.code: str(f.state).upper() for f in found.findings}
    assert {k: state[k] for k in ("IC_DEFINED", "IC_PERIOD_SUPPORT", "QUANTILE_MONOTONICITY", "BOOTSTRAP_INTERVAL", "HORIZON_DECAY_COVERAGE", "PURGED_VALIDATION_SUPPLIED")} == {"IC_DEFINED": "PASS", "IC_PERIOD_SUPPORT": "WARN", "QUANTILE_MONOTONICITY": "FAIL", "BOOTSTRAP_INTERVAL": "PASS", "HORIZON_DECAY_COVERAGE": "WARN", "PURGED_VALIDATION_SUPPLIED": "UNKNOWN"}
    assert state["TRANSACTION_COST_EVIDENCE"] == "NOT_APPLICABLE" and state["TRIAL_HISTORY_AVAILABLE"] == "WARN"
    possible = 12 * 3 + 10 * 4 + 8 * 2 + 4 + 2 * 2
    earned = 12 + 6 + 0 + 12 + 5 + 10 + 8 + 8 + 2 + 1
    assert found.metrics["possible_weight"] == possible and found.metrics["earned_weight"] == earned and found.metrics["unknown_weight"] == 14
    assert found.metrics["robustness_score"] == pytest.approx(100 * earned / possible) and found.metrics["evidence_coverage"] == pytest.approx(1 - 14 / possible)


def test_standard_profile_by_scope():
    kinds = {s: {r.capability_id: str(r.disposition) for r in audit.standard_profile(s).requirements} for s in ("signal", "strategy", "options")}
    assert all(len(k) == 16 for k in kinds.values())
    assert [kinds[s]["execution_realism"] for s in kinds] == ["not_applicable", "required", "required"] and kinds["options"]["survivorship"] == "optional"


def test_standard_audit(series):
    _, df = series
    found = audit.standard_audit(results={"b": resample.bootstrap(df, method="iid", resamples=100, seed=1)}, scope="signal")
    assert found.metrics["recognized_result_count"] == 1 and not found.metrics["required_evidence_complete"]
    assert "DOMAIN_RESAMPLING_INFERENCE_BOOTSTRAP_IID_ASSUMPTION" in found.codes()


def test_sources_and_config(spark, tmp_path):
    import duckdb
    import pandas as pd

    df = io.as_spark({"t": [1, 2], "id": ["a", "b"], "f": [0.1, 0.2]}, spark)
    panel = io.adapt_factor_panel(df, io.FactorPanelSchema("s", {"time": "t", "instrument": "id", "signal": "f"}))
    assert panel.frame.columns == ["time", "instrument", "signal"] and "FACTOR_PANEL_SEMANTICS_UNKNOWN" in panel.evidence.codes()
    with pytest.raises(DataContractError):
        io.adapt_vendor(df, io.VendorSchema("v", {"f": "t"}, ()))
    assert io.from_duckdb(duckdb.sql("SELECT 1 AS x"), spark).frame.collect()[0].x == 1
    pd.DataFrame({"x": [1]}).to_csv(tmp_path / "a.csv", index=False)
    assert io.read(spark, str(tmp_path / "a.csv")).collect()[0].x == 1
    with config(seed=7):
        assert get_config().seed == 7
    assert get_config().seed is None and parse_memory("2GiB") == 2 << 30


def test_command_line(tmp_path, series):
    from panelwright.cli import main

    _, df = series
    path = tmp_path / "e.json"
    path.write_text(resample.bootstrap(df, method="iid", resamples=100, seed=1).to_json())
    assert main(["audit", "--evidence", f"b={path}", "--output", str(tmp_path / "r.md"), "--fail-on", "UNKNOWN"]) == 3
    assert (tmp_path / "r.md").exists() and main(["bundle", "verify", str(path)]) == 1
