"""Command line: doctor, signal, audit, bench and bundle verify.

Exit code 3: a finding is in a state that ``--fail-on`` names; 1: a contract is
broken.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from panelwright import audit as audits
from panelwright.config import diagnose_installation
from panelwright.errors import PanelwrightError
from panelwright.operators.study import SignalStudy
from panelwright.report import AuditReport, verify_bundle
from panelwright.result import Evidence
from panelwright.sources.io import read


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelwright", description="Validate quantitative research with Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="versions of the installation")
    for name in ("signal", "audit"):
        c = sub.add_parser(name)
        c.add_argument("--signal", help="table of time, instrument, signal")
        c.add_argument("--prices", help="table of time, instrument, close")
        c.add_argument("--horizons", default="1,5", help="observations, comma-separated")
        c.add_argument("--evidence", action="append", default=[], metavar="NAME=PATH", help="evidence document to audit")
        c.add_argument("--scope", default="strategy", choices=[s.value for s in audits.Scope])
        c.add_argument("--output", help=".json, .md or .html")
        c.add_argument("--overwrite", action="store_true")
        c.add_argument("--fail-on", default="", help="states, comma-separated")
    b = sub.add_parser("bundle").add_subparsers(dest="action", required=True).add_parser("verify")
    b.add_argument("path")
    bench = sub.add_parser("bench", help="time queries of the catalog")
    bench.add_argument("directory")
    bench.add_argument("queries", nargs="*")
    return p


def _evidence(args: argparse.Namespace) -> Evidence:
    given = {}
    for item in args.evidence:
        name, _, path = item.partition("=")
        given[name] = Evidence.from_json(Path(path).read_text(encoding="utf-8"))
    if not args.signal:
        return audits.standard_audit(results=given, scope=args.scope)
    spark = SparkSession.builder.getOrCreate()
    study = SignalStudy(read(spark, args.signal), read(spark, args.prices))
    horizons = [int(h) for h in args.horizons.split(",")]
    study.labels(horizons=horizons)
    return study.ic() if args.command == "signal" else study.audit(horizon=f"{horizons[0]}D")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "bundle":
            print(verify_bundle(args.path).artifact_set_sha256)
            return 0
        if args.command == "doctor":
            print(AuditReport(diagnose_installation()).to_markdown())
            return 0
        if args.command == "bench":
            import time

            from panelwright.plans.catalog import QUERIES

            spark = SparkSession.builder.getOrCreate()
            for name in args.queries or QUERIES:
                began = time.perf_counter()
                QUERIES[name](spark, args.directory).write.format("noop").mode("overwrite").save()
                print(f"{name}\t{time.perf_counter() - began:.3f}")
            return 0
        found = _evidence(args)
        report = AuditReport(found)
        if args.output:
            report.write(args.output, overwrite=args.overwrite)
        else:
            report.show()
        states = {s.strip().upper() for s in args.fail_on.split(",") if s.strip()}
        return 3 if any(f.state in states for f in found.findings) else 0
    except (PanelwrightError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
