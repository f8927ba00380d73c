"""Command line: scan, compare, diff, quality, check, info, config."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from echofold import __version__
from echofold.config import DedupConfig


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("echofold").getOrCreate()


def _blocks(spark, root: str, config: DedupConfig, since: str | None = None):
    from echofold.operators.blocks import extract
    from echofold.sources.files import changed_files, read_files

    return extract(read_files(spark, root, config, changed_files(root, since) if since else None), config.functions_only, config.min_lines)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="echofold")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="find duplicates below a folder")
    scan.add_argument("root")
    scan.add_argument("--format", default="toon")
    scan.add_argument("--out", default="")
    scan.add_argument("--since", default=None, help="only files changed since this git revision")
    scan.add_argument("--fuzzy", action="store_true")
    scan.add_argument("--windows", action="store_true", help="line windows besides functions")
    check = sub.add_parser("check", help="scan and fail if the budget is exceeded")
    check.add_argument("root")
    check.add_argument("--max-groups", type=int, default=10)
    check.add_argument("--max-lines", type=int, default=100)
    comp = sub.add_parser("compare", help="what two folders share")
    comp.add_argument("a")
    comp.add_argument("b")
    diff = sub.add_parser("diff", help="which groups of folder a are resolved, new or unchanged in b")
    diff.add_argument("a")
    diff.add_argument("b")
    quality = sub.add_parser("quality", help="rollups of a folder as JSON")
    quality.add_argument("root")
    sub.add_parser("info")
    sub.add_parser("config")
    args = p.parse_args(argv)
    config = DedupConfig.layered()
    if args.command == "info":
        print(f"echofold {__version__}")
        return 0
    if args.command == "config":
        print(json.dumps(asdict(config), indent=1))
        return 0
    from dataclasses import replace

    from echofold.plans.analysis import analyze, compare_corpora
    from echofold.sinks.report import rendered, write_reports

    spark = _session()
    if args.command == "compare":
        _, summary, decided = compare_corpora(_blocks(spark, args.a, config), _blocks(spark, args.b, config), config)
        print(json.dumps({"decision": decided.first().asDict(), "communities": [r.asDict() for r in summary.limit(20).collect()]}, indent=1))
        return 0
    if args.command == "diff":
        from echofold.operators.compare import diff_statistics, scan_diff
        from echofold.sinks.report import diff_text, snapshot

        print(diff_text(diff_statistics(scan_diff(*(snapshot(analyze(_blocks(spark, r, config), config)) for r in (args.a, args.b))))), end="")
        return 0
    if args.command == "quality":
        from echofold.sinks.report import enhanced

        print(json.dumps(enhanced(analyze(_blocks(spark, args.root, config), config)), indent=1, default=str))
        return 0
    if args.command == "check":
        gate = analyze(_blocks(spark, args.root, config), config).gate(replace(config, gate_groups=args.max_groups, gate_lines=args.max_lines)).first()
        print(json.dumps(gate.asDict()))
        return 0 if gate["passed"] else 1
    config = replace(config, fuzzy=args.fuzzy, functions_only=not args.windows)
    found = analyze(_blocks(spark, args.root, config, args.since), config)
    if args.out:
        print("\n".join(write_reports(found, args.out, tuple(args.format.split(",")))))
    else:
        print(rendered(found, args.format))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
