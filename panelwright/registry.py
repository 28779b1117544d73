"""Experiment registry: an append-only record of attempts and selections.

The control plane is tiny, so it is a SQLite file on the driver; its content
can be read back as DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import math
import sqlite3
import threading
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.errors import DataContractError, MethodContractError
from panelwright.result import Evidence, Finding, Metadata, Severity, State, plain

_SECRET = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "private_key")
STATUSES = ("completed", "failed", "cancelled")


def canonical(value: Any) -> Any:
    """JSON data in one form: sorted keys, UTC times, no NaN, no negative zero, no credentials."""
    if isinstance(value, Mapping):
        for k in value:
            if any(s in str(k).lower() for s in _SECRET):
                raise DataContractError(f"{k} looks like a credential")
        return {str(k): canonical(v) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if isinstance(value, list | tuple):
        return [canonical(v) for v in value]
    if isinstance(value, set | frozenset):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(value, float):
        if not math.isfinite(value):
            raise DataContractError("NaN and infinities have no canonical form")
        return 0.0 if value == 0 else value
    if isinstance(value, bytes):
        return {"bytes": value.hex()}
    if isinstance(value, date | datetime):
        return plain(value)
    return plain(value)


def canonical_json(value: Any) -> str:
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: Any, *, namespace: str = "value") -> str:
    text = canonical_json(value)
    return "sha256:c14n-v1:" + hashlib.sha256(f"{namespace}\x00{text}".encode()).hexdigest()


def frame_fingerprint(df: DataFrame) -> str:
    """Identity of a table's rows, whatever their order or partitioning: one aggregate of row hashes.

    It is another scheme than ``fingerprint`` and says so in its prefix.
    """
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in cols])
    other = F.xxhash64(F.lit(7), *[F.col(f"`{c}`").cast("string") for c in cols])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.sum(other.cast("decimal(38,0)")).alias("b")).collect()[0]
    return "sha256:rows-v1:" + hashlib.sha256(f"{cols}|{df.schema.simpleString()}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


class ExperimentRegistry:
    def __init__(self, path: str = ":memory:"):
        self._lock = threading.RLock()
        self._db = sqlite3.connect(path, check_same_thread=False)
        self._db.row_factory = sqlite3.Row
        with self._db:
            self._db.execute("CREATE TABLE IF NOT EXISTS attempts (sequence INTEGER PRIMARY KEY, attempt_id TEXT UNIQUE NOT NULL, trial_id TEXT NOT NULL, family TEXT NOT NULL, name TEXT NOT NULL, status TEXT NOT NULL CHECK (status IN ('completed', 'failed', 'cancelled')), parameters TEXT NOT NULL, metrics TEXT NOT NULL, complete INTEGER NOT NULL, supersedes TEXT, recorded_at TEXT NOT NULL)")
            self._db.execute("CREATE TABLE IF NOT EXISTS selections (sequence INTEGER PRIMARY KEY, family TEXT NOT NULL, selected TEXT NOT NULL, eligible TEXT NOT NULL, reason TEXT NOT NULL, recorded_at TEXT NOT NULL)")
            for t in ("attempts", "selections"):
                for verb in ("UPDATE", "DELETE"):
                    self._db.execute(f"CREATE TRIGGER IF NOT EXISTS {t}_{verb.lower()} BEFORE {verb} ON {t} BEGIN SELECT RAISE(ABORT, 'append only'); END")

    @staticmethod
    def trial_id(family: str, name: str, parameters: Mapping[str, Any], *, method: str = "", data: str | None = None, code: str | None = None) -> str:
        return fingerprint([family, name, parameters, method, data, code], namespace="trial")

    def record(self, family: str, name: str, *, parameters: Mapping[str, Any], status: str = "completed", metrics: Mapping[str, Any] | None = None, method: str = "", data: str | None = None, code: str | None = None, supersedes: str | None = None) -> str:
        """Append an attempt; a correction must supersede an attempt of the same trial."""
        if status not in STATUSES:
            raise MethodContractError(f"status must be one of {STATUSES}")
        trial = self.trial_id(family, name, parameters, method=method, data=data, code=code)
        with self._lock, self._db:
            if supersedes is not None:
                old = self._db.execute("SELECT trial_id FROM attempts WHERE attempt_id = ?", (supersedes,)).fetchone()
                if old is None or old["trial_id"] != trial:
                    raise MethodContractError("a correction must supersede an attempt of the same trial")
            n = self._db.execute("SELECT coalesce(max(sequence), 0) + 1 AS n FROM attempts").fetchone()["n"]
            attempt = fingerprint([trial, n], namespace="attempt")
            self._db.execute("INSERT INTO attempts VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", (n, attempt, trial, family, name, status, canonical_json(parameters), canonical_json(metrics or {}), int(data is not None and code is not None), supersedes, plain(datetime.now(timezone.utc))))
        return attempt

    def record_selection(self, family: str, *, selected: Sequence[str], eligible: Sequence[str], reason: str) -> None:
        if not selected or not set(selected) <= set(eligible):
            raise MethodContractError("what is selected must be eligible")
        known = {r["attempt_id"] for r in self.attempts(family)}
        if not set(eligible) <= known:
            raise MethodContractError("eligible attempts must be recorded in the family")
        with self._lock, self._db:
            n = self._db.execute("SELECT coalesce(max(sequence), 0) + 1 AS n FROM selections").fetchone()["n"]
            self._db.execute("INSERT INTO selections VALUES (?, ?, ?, ?, ?, ?)", (n, family, canonical_json(list(selected)), canonical_json(list(eligible)), reason, plain(datetime.now(timezone.utc))))

    def attempts(self, family: str | None = None) -> list[dict]:
        rows = self._db.execute("SELECT * FROM attempts WHERE ? IS NULL OR family = ? ORDER BY sequence", (family, family)).fetchall()
        return [{**dict(r), "parameters": json.loads(r["parameters"]), "metrics": json.loads(r["metrics"]), "complete": bool(r["complete"])} for r in rows]

    def selections(self, family: str | None = None) -> list[dict]:
        rows = self._db.execute("SELECT * FROM selections WHERE ? IS NULL OR family = ? ORDER BY sequence", (family, family)).fetchall()
        return [{**dict(r), "selected": json.loads(r["selected"]), "eligible": json.loads(r["eligible"])} for r in rows]

    def to_result(self, family: str | None = None) -> Evidence:
        a, s = self.attempts(family), self.selections(family)
        count = {k: sum(x["status"] == k for x in a) for k in STATUSES}
        open_ = sum(not x["complete"] for x in a)
        findings = []
        if count["failed"]:
            findings.append(Finding("EXPERIMENT_FAILED_ATTEMPTS", "Failed attempts", f"{count['failed']}.", State.WARN, Severity.MEDIUM, "research_process"))
        if open_:
            findings.append(Finding("EXPERIMENT_IDENTITY_INCOMPLETE", "Identity incomplete", f"{open_} attempts lack data or code.", State.UNKNOWN, Severity.MEDIUM, "reproducibility"))
        if not s:
            findings.append(Finding("EXPERIMENT_SELECTION_MISSING", "No selection", "No selection is recorded.", State.UNKNOWN, Severity.LOW, "research_process"))
        metrics = {"attempt_count": len(a), "trial_count": len({x["trial_id"] for x in a}), **{f"{k}_attempts": count[k] for k in ("completed", "failed", "cancelled")}, "selection_count": len(s), "identity_incomplete_attempts": open_}
        return Evidence(Metadata("experiment.registry_snapshot"), metrics, tuple(findings), {"attempts": a, "selections": s})

    def close(self) -> None:
        self._db.close()
