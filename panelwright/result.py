"""Evidence: metrics, findings and small tables with provenance.

Tables stay lazy DataFrames until a document is written; metrics are plain
numbers.  Undefined numbers are null: NaN and infinities are refused.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame

from panelwright.errors import DataContractError

SCHEMA_VERSION = "1"

# The names of states and severities, and below the field names of a document, which documents are exchanged by.


class State(StrEnum):
    PASS = "PASS"
    WARN = "WARN"
    FAIL = "FAIL"
    UNKNOWN = "UNKNOWN"
    NOT_APPLICABLE = "NOT_APPLICABLE"


class Severity(StrEnum):
    INFO = "info"
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"
    CRITICAL = "critical"


def plain(value: Any, where: str = "value") -> Any:
    """``value`` as JSON data."""
    if value is None or isinstance(value, bool | str):
        return str(value) if isinstance(value, StrEnum) else value
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return value.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    if isinstance(value, date):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise DataContractError(f"{where} is not finite")
        return value
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, Mapping):
        return {str(k): plain(v, f"{where}.{k}") for k, v in value.items()}
    if isinstance(value, Sequence):
        return [plain(v, f"{where}[{k}]") for k, v in enumerate(value)]
    return str(value)


@dataclass(frozen=True)
class Finding:
    code: str
    title: str
    message: str
    state: State
    severity: Severity
    category: str
    evidence: Mapping[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return plain({k: getattr(self, k) for k in self.__dataclass_fields__})


@dataclass(frozen=True)
class Metadata:
    method: str
    method_version: str = "1"
    parameters: Mapping[str, Any] = field(default_factory=dict)
    seed: int | None = None
    input_fingerprint: str | None = None
    created_at: str = field(default_factory=lambda: plain(datetime.now(timezone.utc)))


@dataclass(frozen=True)
class Evidence:
    metadata: Metadata
    metrics: Mapping[str, Any] = field(default_factory=dict)
    findings: tuple[Finding, ...] = ()
    tables: Mapping[str, DataFrame | list[dict]] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    def rows(self, name: str) -> list[dict]:
        """A table as rows; tables are small by design."""
        table = self.tables[name]
        return [r.asDict(recursive=True) for r in table.collect()] if isinstance(table, DataFrame) else list(table)

    def codes(self) -> set[str]:
        return {f.code for f in self.findings}

    def to_dict(self) -> dict:
        meta = {k: getattr(self.metadata, k) for k in Metadata.__dataclass_fields__}
        return plain({"schema_version": SCHEMA_VERSION, "metadata": meta, "metrics": self.metrics, "findings": [f.to_dict() for f in self.findings], "tables": {k: self.rows(k) for k in self.tables}, "warnings": list(self.warnings)})

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, indent=indent, allow_nan=False)

    @classmethod
    def from_dict(cls, value: Mapping[str, Any]) -> Evidence:
        if not isinstance(value, Mapping) or value.get("schema_version") != SCHEMA_VERSION:
            raise DataContractError("not an evidence document of this version")
        if extra := set(value) - {"schema_version", "metadata", "metrics", "findings", "tables", "warnings"}:
            raise DataContractError(f"unknown fields {sorted(extra)}")
        try:
            findings = tuple(Finding(**{**f, "state": State(f["state"]), "severity": Severity(f["severity"])}) for f in value["findings"])
            return cls(Metadata(**value["metadata"]), plain(value["metrics"]), findings, {k: list(v) for k, v in value["tables"].items()}, tuple(value.get("warnings", ())))
        except (KeyError, TypeError, ValueError) as error:
            raise DataContractError(f"malformed evidence document: {error}") from error

    @classmethod
    def from_json(cls, text: str) -> Evidence:
        return cls.from_dict(strict_json(text))


def strict_json(text: str) -> Any:
    """JSON without repeated keys and without NaN."""

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise DataContractError("repeated key in JSON")
        return out

    def refuse(name: str):
        raise DataContractError(f"{name} in JSON")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


@dataclass(frozen=True)
class FrameResult:
    """A lazy frame and the evidence about it."""

    frame: DataFrame
    evidence: Evidence

    def to_json(self, indent: int | None = 2) -> str:
        return self.evidence.to_json(indent)


def attrition(stage: str, reason: str, *, input_rows: int, retained_rows: int, policy: str) -> dict:
    return {"stage": stage, "reason": reason, "input_rows": input_rows, "retained_rows": retained_rows, "excluded_rows": input_rows - retained_rows, "policy": policy}
