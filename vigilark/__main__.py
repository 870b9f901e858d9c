"""Command line: ``python -m vigilark detect --events DIR --rules DIR --out DIR``.

Reads detection rules from a folder (recursively), scans an event table and writes the
matches (Parquet, partitioned by rule severity), the match report (CSV) and a severity
summary (CSV) under ``--out``. ``--events`` is either a folder holding the raw ``events``
Parquet table (``--raw``) or a normalised ECS table written earlier.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vigilark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("detect", help="scan events with rule files and write matches + reports")
    d.add_argument("--events", required=True)
    d.add_argument("--rules", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--raw", action="store_true", help="--events is a folder with the raw events table")
    d.add_argument("--method", default="compiled", choices=("compiled", "table"))
    d.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from vigilark.operators.scan import match_report, match_severity_summary
    from vigilark.operators.table_scan import detect
    from vigilark.sources.events import read_ecs, security_events
    from vigilark.sources.rules import load_rules, read_rule_files, validate_rules
    from vigilark.sources.sinks import write_csv

    b = SparkSession.builder.appName("vigilark-detect").config("spark.ui.enabled", "false")
    if args.master:
        b = b.master(args.master)
    spark = b.getOrCreate()
    events = security_events(spark, args.events) if args.raw else read_ecs(spark, args.events)
    rules, rejects = load_rules(read_rule_files(spark, args.rules))
    checked = validate_rules(rules)
    invalid = checked.filter(~checked["valid"]).select("path", "entry_index", "name", "errors")
    matches = detect(events, checked.filter(checked["valid"]), method=args.method)
    out = args.out.rstrip("/")
    matches.drop("udm").write.mode("overwrite").partitionBy("rule_severity").parquet(f"{out}/matches")
    table = spark.read.parquet(f"{out}/matches")
    write_csv(match_report(table), f"{out}/report")
    write_csv(match_severity_summary(table), f"{out}/severity_summary")
    rejects.write.mode("overwrite").json(f"{out}/rejected_files")
    invalid.write.mode("overwrite").json(f"{out}/invalid_rules")
    print(json.dumps({"matches": table.count(), "out": out}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
