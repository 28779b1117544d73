"""Robustness of a result to its parameters, periods and universe.

The evaluator is the caller's: it may submit Spark jobs of its own.  What is
here is the loop around it on the driver, and the geometry of the outcomes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations, product
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.result import Evidence, Finding, Metadata, Severity, State


def _objective(result: Any, name: str) -> float:
    """The objective of an evaluation: a number, a mapping of metrics or an evidence."""
    if isinstance(result, Evidence):
        result = result.metrics
    value = result[name] if isinstance(result, Mapping) else result
    value = float(value)
    if not np.isfinite(value):
        raise DataContractError("the objective is not finite")
    return value


def _run(evaluate: Callable, argument: Any, name: str) -> tuple[float | None, str | None]:
    try:
        return _objective(evaluate(argument), name), None
    except Exception as error:  # noqa: BLE001 - a failed evaluation is a recorded outcome
        return None, f"{type(error).__name__}: {error}"


def _find(code: str, title: str, message: str, state: State, severity: Severity, category: str = "robustness") -> Finding:
    return Finding(code, title, message, state, severity, category)


def parameter_surface(evaluate: Callable[[dict], Any], *, grid: Mapping[str, Sequence[Any]], objective: str = "objective", maximize: bool = True, threshold: float = 0.0, selected: Mapping[str, Any] | None = None, isolation_limit: float = 3.0, plateau_tolerance: float = 0.1, selection_sample: str | None = None, evaluation_sample: str | None = None) -> Evidence:
    """Every point of a grid, and how the selected one compares with its neighbours.

    Neighbours differ by one step in one parameter; the plateau is what can be
    reached over neighbours whose objective is within a tolerance of the best.
    """
    names = sorted(grid)
    if not names or any(len(grid[n]) == 0 for n in names):
        raise MethodContractError("the grid must not be empty")
    shape = [len(grid[n]) for n in names]
    points = list(product(*[range(k) for k in shape]))
    value: dict[tuple, float | None] = {}
    rows = []
    for i, at in enumerate(points):
        setting = {n: grid[n][k] for n, k in zip(names, at, strict=True)}
        got, error = _run(evaluate, setting, objective)
        value[at] = got
        rows.append({"point_id": i, **setting, "objective": got, "status": "failed" if error else "ok", "error": error})
    sign = 1.0 if maximize else -1.0
    good = {k: v for k, v in value.items() if v is not None}
    meta = Metadata("validation.parameter_surface", parameters={"grid": {n: list(grid[n]) for n in names}, "objective": objective})
    base = {"attempted_points": len(points), "successful_points": len(good), "failed_points": len(points) - len(good)}
    blank = {k: None for k in ("selected_point_id", "selected_objective", "local_median", "local_mad", "isolation_score", "objective_to_local_median_ratio", "plateau_width", "neighbor_count", "neighbor_failed_fraction", "neighbor_positive_fraction", "neighbor_passing_fraction", "boundary_parameters")}
    if not good:
        return Evidence(meta, {**base, **blank}, (_find("PARAMETER_SURFACE_NO_VALID_POINT", "No valid point", "Every evaluation failed.", State.FAIL, Severity.HIGH),), {"parameter_surface": rows, "selected_neighborhood": []})
    if selected is not None:
        try:
            best = tuple(list(grid[n]).index(selected[n]) for n in names)
        except (KeyError, ValueError) as error:
            raise MethodContractError("the selected point is not on the grid") from error
    else:
        best = max(good, key=lambda k: (sign * good[k], [-x for x in k]))
    if value[best] is None:
        return Evidence(meta, {**base, **blank, "selected_point_id": points.index(best)}, (_find("PARAMETER_SELECTED_POINT_FAILED", "Selected point failed", "Its evaluation failed.", State.FAIL, Severity.HIGH),), {"parameter_surface": rows, "selected_neighborhood": []})

    def around(at: tuple) -> list[tuple]:
        return [(*at[:d], at[d] + s, *at[d + 1 :]) for d in range(len(at)) for s in (-1, 1) if 0 <= at[d] + s < shape[d]]

    near = around(best)
    near_values = np.array([good[k] for k in near if k in good])
    top = good[best]
    findings = []
    median = float(np.median(near_values)) if len(near_values) else None
    mad = float(np.median(np.abs(near_values - median))) if len(near_values) else None
    score = None
    if len(near_values) < 2:
        findings.append(_find("PARAMETER_ISOLATION_UNKNOWN", "Too few neighbours", "Isolation cannot be judged.", State.UNKNOWN, Severity.MEDIUM))
    else:
        score = sign * (top - median) / max(1.4826 * mad, 1e-12 + 1e-3 * abs(median))
        if score > isolation_limit:
            findings.append(_find("PARAMETER_ISOLATED_OPTIMUM", "Isolated optimum", f"Score {score:.2f}.", State.WARN, Severity.HIGH))
        else:
            findings.append(_find("PARAMETER_LOCAL_STABILITY", "Stable neighbourhood", f"Score {score:.2f}.", State.PASS, Severity.INFO))
    floor = sign * top - plateau_tolerance * abs(top)
    plateau, queue = {best}, [best]
    while queue:
        for k in around(queue.pop()):
            if k not in plateau and k in good and sign * good[k] >= floor:
                plateau.add(k)
                queue.append(k)
    edge = [n for d, n in enumerate(names) if shape[d] > 1 and best[d] in (0, shape[d] - 1)]
    if edge:
        findings.append(_find("PARAMETER_BOUNDARY_OPTIMUM", "Optimum at the boundary", f"{edge}.", State.WARN, Severity.MEDIUM))
    if len(good) < len(points):
        findings.append(_find("PARAMETER_SURFACE_FAILURES", "Failed evaluations", f"{len(points) - len(good)}.", State.WARN, Severity.MEDIUM))
    if selection_sample is None or evaluation_sample is None:
        findings.append(_find("PARAMETER_SELECTION_SAMPLE_UNKNOWN", "Samples not declared", "Selection and evaluation may share data.", State.UNKNOWN, Severity.MEDIUM, "research_process"))
    elif selection_sample == evaluation_sample:
        findings.append(_find("PARAMETER_SELECTION_REUSE", "Sample reused", "Selection and evaluation share data.", State.WARN, Severity.HIGH, "research_process"))
    else:
        findings.append(_find("PARAMETER_SELECTION_SEPARATION", "Samples apart", "Selection and evaluation use different data.", State.PASS, Severity.INFO, "research_process"))
    share = lambda f: float(np.mean([f(v) for v in near_values])) if len(near_values) else None
    metrics = {**base, "selected_point_id": points.index(best), "selected_objective": top, "local_median": median, "local_mad": mad, "isolation_score": score, "objective_to_local_median_ratio": top / median if median else None, "plateau_width": len(plateau), "neighbor_count": len(near), "neighbor_failed_fraction": 1 - len(near_values) / len(near) if near else None, "neighbor_positive_fraction": share(lambda v: v > 0), "neighbor_passing_fraction": share(lambda v: sign * v >= sign * threshold), "boundary_parameters": edge}
    return Evidence(meta, metrics, tuple(findings), {"parameter_surface": rows, "selected_neighborhood": [rows[points.index(k)] for k in near]})


def _drawn(rng: np.random.Generator, base: Mapping[str, float], spec: Mapping[str, Mapping[str, Any]]) -> tuple[dict, str | None]:
    """One draw over the parameters in name order; stops at the first that leaves its bounds."""
    out = dict(base)
    for name in sorted(spec):
        s = spec[name]
        kind, scale = s.get("distribution", "normal"), float(s["scale"])
        step = rng.normal(0, scale) if kind in ("normal", "lognormal") else rng.uniform(-scale, scale)
        x = base[name] * float(np.exp(step)) if kind == "lognormal" else base[name] + step
        x = round(x) if s.get("integer") else x
        if s.get("lower") is not None and x < s["lower"] or s.get("upper") is not None and x > s["upper"]:
            return out, f"{name} out of bounds"
        out[name] = x
    return out, None


def continuous_perturbation(evaluate: Callable[[dict], Any], *, selected_parameters: Mapping[str, float], perturbations: Mapping[str, Mapping[str, Any]], objective: str = "objective", threshold: float = 0.0, draws: int = 500, seed: int = 0, constraint: Callable[[dict], bool] | None = None, max_attempts: int | None = None) -> Evidence:
    """Outcomes around a setting; rejected draws use up randomness and are counted by reason."""
    if draws < 1 or not perturbations or not set(perturbations) <= set(selected_parameters):
        raise MethodContractError("draws must be positive and perturbed parameters selected ones")
    for name, s in perturbations.items():
        C.require_one_of(s.get("distribution", "normal"), ("normal", "lognormal", "uniform"), f"distribution of {name}")
        if s["scale"] <= 0:
            raise MethodContractError("scales must be positive")
    rng = np.random.default_rng(seed)
    limit = max_attempts or 20 * draws
    rows, rejected, tried = [], {}, 0
    while len(rows) < draws and tried < limit:
        tried += 1
        setting, reason = _drawn(rng, selected_parameters, perturbations)
        if reason is None and constraint is not None:
            verdict = constraint(setting)
            if not isinstance(verdict, bool):
                raise MethodContractError("a constraint must return true or false")
            reason = None if verdict else "constraint"
        if reason:
            rejected[reason] = rejected.get(reason, 0) + 1
            continue
        got, error = _run(evaluate, setting, objective)
        rows.append({"draw": len(rows), **setting, "objective": got, "error": error})
    good = np.array([r["objective"] for r in rows if r["objective"] is not None])
    failed, n_rejected = len(rows) - len(good), sum(rejected.values())
    findings = []
    if len(rows) < draws:
        findings.append(_find("PERTURBATION_ACCEPTANCE_SHORTFALL", "Too few accepted draws", f"{len(rows)} of {draws}.", State.FAIL, Severity.HIGH))
    if tried and n_rejected / tried > 0.5:
        findings.append(_find("PERTURBATION_HIGH_REJECTION_RATE", "Many rejected draws", f"{n_rejected} of {tried}.", State.WARN, Severity.MEDIUM))
    if failed:
        findings.append(_find("PERTURBATION_EVALUATION_FAILURES", "Failed evaluations", f"{failed}.", State.WARN, Severity.MEDIUM))
    findings.append(_find("PERTURBATION_REPRODUCIBLE", "Seeded", f"Seed {seed}.", State.PASS, Severity.INFO, "reproducibility"))
    metrics = {"requested_draws": draws, "attempted_samples": tried, "accepted_samples": len(rows), "successful_evaluations": len(good), "failed_evaluations": failed, "rejected_samples": n_rejected, "rejection_rate": n_rejected / tried if tried else None, "objective_median": float(np.median(good)) if len(good) else None, "objective_dispersion": float(good.std(ddof=1)) if len(good) > 1 else None, "positive_fraction": float((good > 0).mean()) if len(good) else None, "passing_fraction": float((good >= threshold).mean()) if len(good) else None}
    return Evidence(Metadata("robustness.continuous_perturbation", seed=seed), metrics, tuple(findings), {"perturbations": rows, "rejections": [{"reason": k, "count": v} for k, v in sorted(rejected.items())]})


def subperiod_analysis(evaluate: Callable[[DataFrame], Any], *, data: DataFrame, periods: Mapping[str, tuple[Any, Any]], time: str = "time", objective: str = "objective", sign_threshold: float = 0.8, concentration_threshold: float = 0.5) -> Evidence:
    """The same evaluation over half-open windows of the data."""
    if len(periods) < 2 or any(a >= b for a, b in periods.values()):
        raise MethodContractError("at least two periods that are not empty are needed")
    rows = []
    for name, (a, b) in periods.items():
        got, error = _run(evaluate, data.where((F.col(time) >= F.lit(a)) & (F.col(time) < F.lit(b))), objective)
        rows.append({"period": name, "start": a, "end": b, "objective": got, "error": error})
    pairs = [(x, y) for x, y in combinations(periods, 2) if periods[x][0] < periods[y][1] and periods[y][0] < periods[x][1]]
    good = np.array([r["objective"] for r in rows if r["objective"] is not None])
    positive = float((good > 0).mean()) if len(good) else None
    consistency = max(positive, 1 - positive) if positive is not None else None
    total = float(np.abs(good).sum())
    top = float(np.abs(good).max() / total) if total else None
    trend = float(np.polyfit(np.arange(len(good)), good, 1)[0]) if len(good) > 1 else None
    findings = []
    if len(good) < len(rows):
        findings.append(_find("SUBPERIOD_EVALUATION_FAILURES", "Failed evaluations", f"{len(rows) - len(good)}.", State.WARN, Severity.MEDIUM))
    if pairs:
        findings.append(_find("SUBPERIOD_OVERLAP", "Periods overlap", f"{pairs}.", State.WARN, Severity.MEDIUM))
    if consistency is not None:
        findings.append(_find("SUBPERIOD_SIGN_CONSISTENCY", "Signs agree", f"{consistency:.2f}.", State.PASS, Severity.INFO) if consistency >= sign_threshold else _find("SUBPERIOD_SIGN_INSTABILITY", "Signs differ", f"{consistency:.2f}.", State.WARN, Severity.HIGH))
    if top is not None and top > concentration_threshold:
        findings.append(_find("SUBPERIOD_OUTCOME_CONCENTRATION", "Outcome in one period", f"{top:.2f}.", State.WARN, Severity.HIGH))
    metrics = {"period_count": len(rows), "successful_periods": len(good), "failed_periods": len(rows) - len(good), "overlap_count": len(pairs), "positive_fraction": positive, "sign_consistency": consistency, "worst_objective": float(good.min()) if len(good) else None, "best_objective": float(good.max()) if len(good) else None, "objective_dispersion": float(good.std(ddof=1)) if len(good) > 1 else None, "objective_trend_per_period": trend, "top_absolute_outcome_share": top}
    return Evidence(Metadata("robustness.subperiod_analysis"), metrics, tuple(findings), {"subperiods": rows})


def universe_perturbation(evaluate: Callable[[frozenset], Any], *, universes: Mapping[str, Sequence[Any]], baseline: str, objective: str = "objective", membership_mode: str = "unknown") -> Evidence:
    """The same evaluation over different sets of instruments, and how the sets differ."""
    C.require_one_of(membership_mode, ("point_in_time", "retrospective", "unknown"), "membership_mode")
    if baseline not in universes or len(universes) < 2:
        raise MethodContractError("the baseline must be one of at least two universes")
    base = frozenset(universes[baseline])
    rows = []
    for name, members in universes.items():
        s = frozenset(members)
        got, error = _run(evaluate, s, objective)
        rows.append({"universe": name, "size": len(s), "jaccard": len(s & base) / len(s | base) if s | base else None, "retained_share": len(s & base) / len(base) if base else None, "added": len(s - base), "removed": len(base - s), "objective": got, "error": error})
    good = np.array([r["objective"] for r in rows if r["objective"] is not None])
    jaccards = [r["jaccard"] for r in rows if r["jaccard"] is not None]
    findings = []
    if membership_mode == "retrospective":
        findings.append(_find("UNIVERSE_RETROSPECTIVE_MEMBERSHIP", "Membership sees the future", "Declared retrospective.", State.WARN, Severity.HIGH, "bias"))
    elif membership_mode == "point_in_time":
        findings.append(_find("UNIVERSE_POINT_IN_TIME_DECLARED", "Membership as known", "Declared.", State.PASS, Severity.INFO, "bias"))
    if len(good) < len(rows):
        findings.append(_find("UNIVERSE_EVALUATION_FAILURES", "Failed evaluations", f"{len(rows) - len(good)}.", State.WARN, Severity.MEDIUM))
    metrics = {"universe_count": len(rows), "successful_universes": len(good), "failed_universes": len(rows) - len(good), "retrospective_universes": len(rows) if membership_mode == "retrospective" else 0, "minimum_composition_jaccard": min(jaccards, default=None), "maximum_composition_change": 1 - min(jaccards) if jaccards else None, "worst_objective": float(good.min()) if len(good) else None, "best_objective": float(good.max()) if len(good) else None, "objective_dispersion": float(good.std(ddof=1)) if len(good) > 1 else None}
    return Evidence(Metadata("robustness.universe_perturbation"), metrics, tuple(findings), {"universes": rows})
