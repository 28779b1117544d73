"""Reports: JSON, Markdown and HTML of an evidence, and verified bundles of them."""

from __future__ import annotations

import hashlib
import html
import json
import re
import zipfile
from collections.abc import Mapping
from dataclasses import dataclass
from fnmatch import fnmatchcase
from pathlib import Path
from typing import Any

from panelwright import __version__
from panelwright.errors import ReportError
from panelwright.result import SCHEMA_VERSION, Evidence, plain, strict_json

SHOWN_ROWS = 50
MAX_MEMBERS, MAX_BYTES = 256, 64 << 20
_EPOCH = (1980, 1, 1, 0, 0, 0)
_SECRET = re.compile(r"password|passwd|secret|token|api_?key|credential|private_key", re.IGNORECASE)
_LOCAL = re.compile(r"(?:/home/|/Users/|/root/|[A-Za-z]:\\Users\\)[^\s\"']*")


def _table(rows: list[dict]) -> tuple[list[str], list[list[str]]]:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return names, [["" if r.get(n) is None else str(plain(r[n])) for n in names] for r in rows[:SHOWN_ROWS]]


def _shown(e: Evidence, name: str) -> list[dict]:
    table = e.tables[name]
    return list(table)[: SHOWN_ROWS + 1] if isinstance(table, list) else [r.asDict(recursive=True) for r in table.limit(SHOWN_ROWS + 1).collect()]


def to_markdown(e: Evidence) -> str:
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ")
    out = [f"# {e.metadata.method}", "", f"Version {e.metadata.method_version}, {e.metadata.created_at}", "", "## Metrics", ""]
    out += [f"- {k}: {plain(v)}" for k, v in e.metrics.items()]
    out += ["", "## Findings", ""] + [f"- **{f.state}** ({f.severity}) {f.code}: {f.message}" for f in e.findings]
    for name in e.tables:
        names, rows = _table(got := _shown(e, name))
        out += ["", f"## {name}", ""]
        if names:
            out += ["| " + " | ".join(map(cell, names)) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        if len(got) > SHOWN_ROWS:
            out.append(f"\nFirst {SHOWN_ROWS} rows.")
    return "\n".join(out) + "\n"


def to_html(e: Evidence) -> str:
    """Self-contained and escaped."""
    x = html.escape
    parts = [f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{x(e.metadata.method)}</title><style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style></head><body><h1>{x(e.metadata.method)}</h1><dl>"]
    parts += [f"<dt>{x(k)}</dt><dd>{x(str(plain(v)))}</dd>" for k, v in e.metrics.items()]
    parts.append("</dl><h2>Findings</h2><ul>")
    parts += [f"<li class='{x(f.state)}'><b>{x(f.state)}</b> {x(f.code)}: {x(f.message)}</li>" for f in e.findings]
    parts.append("</ul>")
    for name in e.tables:
        names, rows = _table(_shown(e, name))
        parts.append(f"<h2>{x(name)}</h2><table><tr>" + "".join(f"<th>{x(n)}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(f"<td>{x(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
    return "".join(parts) + "</body></html>"


#: Views of interactive reports: the methods that a view stands for, and the tables it shows.
VIEWS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "event": (("events.*",), ("event_response", "event_coverage")),
    "portfolio": (("signal.portfolio_projection*",), ("cohort_returns", "turnover", "exposure_reconciliation")),
    "signal": (("signal.*", "labels.*"), ("ic_by_period", "ic_decay", "bucket_returns", "quantile_returns", "turnover_by_lag", "decay_fit")),
    "audit": (("audit.*",), ("score_components", "finding_summary", "category_coverage", "evidence_requirements")),
}


def resolved_view(e: Evidence, view: str = "auto") -> str:
    """The view asked for; ``auto`` takes the first whose methods the evidence, or what it was made from, follows."""
    if view != "auto" and view not in VIEWS:
        raise ReportError(f"a view is auto or one of {', '.join(VIEWS)}")
    if view != "auto":
        return view
    methods = [e.metadata.method, *map(str, (e.metadata.parameters.get("result_methods") or {}).values())]
    return next((name for name, (patterns, _) in VIEWS.items() if any(fnmatchcase(m, p) for m in methods for p in patterns)), "audit")


def view_tables(e: Evidence, view: str = "auto") -> list[str]:
    """Tables of the evidence that a view shows, in its order; all of them where it has none of these."""
    wanted = [t for t in VIEWS[resolved_view(e, view)][1] if t in e.tables]
    return wanted or list(e.tables)


def to_plotly_html(e: Evidence, view: str = "auto") -> str:
    """Interactive charts of the tables of a view, where plotly is installed: bars by label where a table has one, lines otherwise."""
    chosen, names = resolved_view(e, view), view_tables(e, view)
    try:
        import plotly.graph_objects as go
    except ImportError as error:
        raise ReportError("plotly is not installed") from error
    parts = []
    for name in names:
        rows = _shown(e, name)
        columns = list(rows[0]) if rows else []
        numeric = [k for k in columns if all(isinstance(r.get(k), int | float | None) and not isinstance(r.get(k), bool) for r in rows)]
        label = next((k for k in columns if k not in numeric), None)
        x = [str(r.get(label)) for r in rows] if label else None
        figure = go.Figure([(go.Bar if label else go.Scatter)(x=x, y=[r.get(k) for r in rows], name=k) for k in numeric])
        figure.update_layout(title=f"{chosen}: {name}")
        parts.append(figure.to_html(include_plotlyjs=not parts, full_html=False))
    return "<!DOCTYPE html><html><body>" + "".join(parts) + "</body></html>"


@dataclass(frozen=True)
class AuditReport:
    evidence: Evidence

    def table(self, name: str) -> list[dict]:
        return self.evidence.rows(name)

    def summary(self) -> dict:
        return {"method": self.evidence.metadata.method, **plain(self.evidence.metrics)}

    def to_json(self, indent: int | None = 2) -> str:
        return self.evidence.to_json(indent)

    def to_markdown(self) -> str:
        return to_markdown(self.evidence)

    def to_html(self) -> str:
        return to_html(self.evidence)

    def show(self) -> None:
        print(self.to_markdown())

    def write(self, path: str | Path, *, overwrite: bool = False) -> Path:
        """By suffix: .json, .md or .html."""
        path = Path(path)
        render = {".json": self.to_json, ".md": self.to_markdown, ".html": self.to_html}.get(path.suffix)
        if render is None:
            raise ReportError(f"no format for {path.suffix!r}")
        if path.exists() and not overwrite:
            raise ReportError(f"{path} exists")
        path.write_text(render(), encoding="utf-8")
        return path

    def bundle(self, path: str | Path, **extra: Any) -> BundleManifest:
        return create_bundle(self, path, **extra)


@dataclass(frozen=True)
class BundleManifest:
    producer_version: str
    report_method: str
    artifact_set_sha256: str
    artifacts: tuple[dict, ...]
    format: str = "panelwright-bundle"
    bundle_version: str = "1"
    report_schema_version: str = SCHEMA_VERSION
    reproducibility_level: str = "identifiable"

    @classmethod
    def from_json(cls, text: str) -> BundleManifest:
        value = strict_json(text)
        try:
            out = cls(**{**value, "artifacts": tuple(value["artifacts"])})
        except (KeyError, TypeError) as error:
            raise ReportError(f"malformed manifest: {error}") from error
        if out.format != "panelwright-bundle" or out.bundle_version != "1":
            raise ReportError("not a bundle of this version")
        return out


_ADDRESS = re.compile(r"(?P<scheme>\b(?:ftps?|gs|https?|s3)://)(?:[^/?#\s@]*@)?(?P<place>[^?#\s]*)(?:[?#]\S*)?", re.IGNORECASE)


def redacted(value: Any) -> Any:
    """Credentials and local paths taken out."""
    if isinstance(value, Mapping):
        return {k: "[redacted]" if _SECRET.search(str(k)) else redacted(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redacted(v) for v in value]
    return _LOCAL.sub("[path]", _without_credentials(value)) if isinstance(value, str) else value


def _without_credentials(text: str) -> str:
    """Addresses without what may carry credentials: user, query and fragment."""
    return _ADDRESS.sub(lambda m: m["scheme"] + m["place"], text)


def _set_digest(artifacts: list[dict]) -> str:
    return hashlib.sha256(json.dumps(artifacts, sort_keys=True).encode()).hexdigest()


def create_bundle(report: AuditReport, path: str | Path, *, configuration: Mapping[str, Any] | None = None, evidence: Mapping[str, Evidence] | None = None, provenance: Mapping[str, Any] | None = None, invocation: Mapping[str, Any] | None = None, overwrite: bool = False) -> BundleManifest:
    """A ZIP that is byte for byte the same for the same content: stored, sorted, fixed times, digests in a manifest."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise ReportError(f"{path} exists")
    dump = lambda v: json.dumps(redacted(plain(v)), sort_keys=True, indent=2).encode()
    files = {"report.json": report.to_json().encode(), "report.md": report.to_markdown().encode(), "report.html": report.to_html().encode()}
    for name, value in (("configuration", configuration), ("provenance", provenance), ("invocation", invocation)):
        if value is not None:
            files[f"{name}.json"] = dump(value)
    for name, e in (evidence or {}).items():
        files[f"evidence/{re.sub(r'[^A-Za-z0-9._-]', '_', name)}.json"] = e.to_json().encode()
    if len(files) + 1 > MAX_MEMBERS or sum(map(len, files.values())) > MAX_BYTES:
        raise ReportError("the bundle exceeds its limits")
    artifacts = [{"path": k, "sha256": hashlib.sha256(v).hexdigest(), "size": len(v)} for k, v in sorted(files.items())]
    manifest = BundleManifest(__version__, report.evidence.metadata.method, _set_digest(artifacts), tuple(artifacts))
    body = json.dumps({**{k: getattr(manifest, k) for k in manifest.__dataclass_fields__}, "artifacts": artifacts}, sort_keys=True, indent=2).encode()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, data in [("manifest.json", body), *sorted(files.items())]:
            z.writestr(zipfile.ZipInfo(name, _EPOCH), data)
    return manifest


def verify_bundle(path: str | Path) -> BundleManifest:
    """Names, sizes, digests and the report's identity agree with the manifest."""
    try:
        with zipfile.ZipFile(path) as z:
            infos = z.infolist()
            names = [i.filename for i in infos]
            if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_BYTES or len(set(names)) < len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names):
                raise ReportError("the archive breaks its limits")
            manifest = BundleManifest.from_json(z.read("manifest.json").decode())
            if sorted(names) != sorted(["manifest.json", *(a["path"] for a in manifest.artifacts)]):
                raise ReportError("members and manifest differ")
            for a in manifest.artifacts:
                data = z.read(a["path"])
                if len(data) != a["size"] or hashlib.sha256(data).hexdigest() != a["sha256"]:
                    raise ReportError(f"{a['path']} was changed")
            if _set_digest(list(manifest.artifacts)) != manifest.artifact_set_sha256:
                raise ReportError("the artifact set was changed")
            if Evidence.from_json(z.read("report.json").decode()).metadata.method != manifest.report_method:
                raise ReportError("the report is another one")
    except (zipfile.BadZipFile, KeyError, OSError) as error:
        raise ReportError(f"not a bundle: {error}") from error
    return manifest
