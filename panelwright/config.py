"""Settings of a context, extension discovery and installation diagnostics."""

from __future__ import annotations

import importlib.metadata
import os
import platform
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields, replace
from typing import Any

from panelwright.errors import ConfigurationError, PluginError
from panelwright.result import Evidence, Finding, Metadata, Severity, State

PROTOCOL = 1
GROUPS = ("adapters", "audit_rules", "cost_models", "methods", "report_sections")


@dataclass(frozen=True)
class Config:
    threads: int | str = "auto"
    seed: int | None = None
    memory_limit: str | int | None = None
    cache_dir: str | None = None
    log_level: str = "warning"

    def __post_init__(self) -> None:
        if self.threads != "auto" and (not isinstance(self.threads, int) or self.threads < 1):
            raise ConfigurationError("threads must be auto or a positive number")
        parse_memory(self.memory_limit)
        if self.log_level not in ("debug", "info", "warning", "error"):
            raise ConfigurationError("unknown log level")

    @classmethod
    def from_environment(cls) -> Config:
        given = {f.name: os.environ[k] for f in fields(cls) if (k := f"PANELWRIGHT_{f.name.upper()}") in os.environ}
        return cls(**{k: int(v) if k == "seed" or k == "threads" and v.isdigit() else v for k, v in given.items()})


def parse_memory(value: str | int | None) -> int | None:
    """Bytes of ``"512MB"``, ``"2GiB"`` or a number."""
    if value is None or isinstance(value, int):
        return value
    m = re.fullmatch(r"(\d+)\s*([KMGT]?)(i?)B?", str(value).strip(), re.IGNORECASE)
    if not m:
        raise ConfigurationError(f"no amount of memory: {value!r}")
    return int(m[1]) * (1024 if m[3] else 1000) ** " KMGT".index(m[2].upper() or " ")


_current: ContextVar[Config | None] = ContextVar("panelwright_config", default=None)


def get_config() -> Config:
    return _current.get() or Config.from_environment()


def configure(**changes: Any) -> Config:
    _current.set(replace(get_config(), **changes))
    return get_config()


@contextmanager
def config(**changes: Any) -> Iterator[Config]:
    token = _current.set(replace(get_config(), **changes))
    try:
        yield get_config()
    finally:
        _current.reset(token)


def discover_plugins(group: str | None = None) -> list[dict]:
    """Entry points by their metadata; nothing is imported."""
    groups = [group] if group else GROUPS
    if set(groups) - set(GROUPS):
        raise PluginError(f"unknown group {group!r}")
    return [{"group": g, "name": e.name, "value": e.value, "distribution": e.dist.name if e.dist else None} for g in groups for e in importlib.metadata.entry_points(group=f"panelwright.{g}")]


def activate_plugin(group: str, name: str) -> Any:
    """Import one plugin; its ``protocol`` must be of this major version."""
    found = [e for e in importlib.metadata.entry_points(group=f"panelwright.{group}") if e.name == name]
    if group not in GROUPS or len(found) != 1:
        raise PluginError(f"{len(found)} plugins {group}/{name}")
    plugin = found[0].load()
    if int(str(getattr(plugin, "protocol", "0")).split(".")[0]) != PROTOCOL:
        raise PluginError("the plugin follows another protocol")
    return plugin


def diagnose_installation(spark: Any = None) -> Evidence:
    """Whether an installation, and a session if given, can carry a run: one finding a check, and the versions."""
    versions: dict[str, str | None] = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "plotly"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    number = lambda v: int(re.match(r"\d+", v or "0").group())
    checks = [
        ("PYTHON_VERSION", sys.version_info >= (3, 11), State.FAIL, f"Python {platform.python_version()}."),
        ("PYSPARK_VERSION", number(versions["pyspark"]) >= 4, State.FAIL, f"pyspark {versions['pyspark']}."),
        *[(f"{n.upper()}_PRESENT", versions[n] is not None, State.FAIL, f"{n} {versions[n]}.") for n in ("pyarrow", "pandas", "numpy")],
        *[(f"{n.upper()}_PRESENT", versions[n] is not None, State.WARN, f"{n} {versions[n]}, which is optional.") for n in ("duckdb", "plotly")],
    ]
    if spark is not None:
        conf, master = spark.conf.get, spark.sparkContext.master
        versions |= {"java": spark.sparkContext._jvm.System.getProperty("java.version"), "spark": spark.version, "ansi": conf("spark.sql.ansi.enabled"), "master": master}
        local = master == "local" or master.startswith("local[")
        shared = conf("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        checks += [
            ("JAVA_VERSION", number(versions["java"]) >= 17, State.FAIL, f"Java {versions['java']}."),
            ("SPARK_VERSIONS_AGREE", spark.version == versions["pyspark"], State.FAIL, f"Spark {spark.version}, pyspark {versions['pyspark']}."),
            ("TIME_ZONE", conf("spark.sql.session.timeZone") == "UTC", State.WARN, f"Times are shown in {conf('spark.sql.session.timeZone')}."),
            ("ADAPTIVE_PLANS", conf("spark.sql.adaptive.enabled") == "true", State.WARN, "Skewed joins need adaptive plans."),
            ("SHARED_FOLDER", local or bool(shared), State.FAIL, "spark.checkpoint.dir is set." if shared else "spark.checkpoint.dir is not set."),
        ]
    findings = tuple(Finding(code, code.replace("_", " ").lower(), message, State.PASS if good else bad, Severity.INFO if good else Severity.HIGH if bad == State.FAIL else Severity.LOW, "operational") for code, good, bad, message in checks)
    count = lambda s: sum(f.state == s for f in findings)
    metrics = {"python": platform.python_version(), "missing": sum(v is None for v in versions.values()), "check_count": len(findings), "failed_checks": count(State.FAIL), "warned_checks": count(State.WARN), "usable": not count(State.FAIL)}
    return Evidence(Metadata("diagnostics.installation"), metrics, findings, {"versions": [{"name": k, "version": v} for k, v in versions.items()]})
