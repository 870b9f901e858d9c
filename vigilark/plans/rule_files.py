"""Registered queries that run detection from rule *files*: load, validate, export, merge.

The rule files are written with Spark into the shared checkpoint folder (works on any
file system), read back with the recursive whole-text reader, and the surviving rules
scan the whole ``events`` table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import scan as SC
from vigilark.operators.rules import PRIVILEGED_PROCESS_RULE, sample_rules
from vigilark.plans.queries import events, query
from vigilark.session import shared_dir
from vigilark.sources.rules import (collect_rules, load_rules, merge_rules, read_rule_files, rules_frame,
                                    validate_rules, write_rules)

PART_GLOB = "part-*"


def write_rule_files(spark: SparkSession, files: dict[str, str]) -> str:
    """One Spark write per rule file (sub-folder per file), so any file system works."""
    root = shared_dir(spark, "rule-repo")
    for rel, text in files.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{rel}")
    return root


def _valid_rules(spark: SparkSession, root: str) -> DataFrame:
    rules, _rejects = load_rules(read_rule_files(spark, root, glob=PART_GLOB))
    return validate_rules(rules).filter(F.col("valid"))


def _scan_out(spark, sf, rules) -> DataFrame:
    return SC.scan(events(spark, sf), rules).select("event_id", "rule_name", "rule_severity")


@query("rules_from_files")
def q_rules_from_files(spark, sf):
    s = sample_rules()
    files = {
        "core/all": json.dumps(s[:3], indent=2),
        "team/auth/failed": json.dumps(s[3]),
        "team/files/access": json.dumps([s[4], PRIVILEGED_PROCESS_RULE]),
        # rejected or invalid: not JSON, a non-object entry, bad severity, missing name
        "broken/notjson": "{oops",
        "broken/mixed": json.dumps([7, {"name": "bad_sev", "severity": "urgent",
                                        "conditions": {"event.severity": "low"}},
                                    {"conditions": {"event.severity": "medium"}}]),
    }
    root = write_rule_files(spark, files)
    return _scan_out(spark, sf, collect_rules(_valid_rules(spark, root)))


@query("rules_export_roundtrip")
def q_rules_export_roundtrip(spark, sf):
    path = write_rules(rules_frame(spark, sample_rules()), shared_dir(spark, "rules-export"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rules, _ = load_rules(lines)
    return _scan_out(spark, sf, collect_rules(rules))


@query("rules_merge")
def q_rules_merge(spark, sf):
    s = sample_rules()
    existing = rules_frame(spark, s[:3], path="a-existing")
    clash = {"name": "Critical_Event_Alert", "severity": "critical", "conditions": {"event.severity": "low"}}
    incoming = rules_frame(spark, s + [PRIVILEGED_PROCESS_RULE, clash], path="b-incoming")
    return _scan_out(spark, sf, collect_rules(merge_rules(existing, incoming)))


@query("rules_validate")
def q_rules_validate(spark, sf):
    """One rule for each source, action, severity and port that the events hold, as a security team
    would generate a watch list; validated with messages. Some come out invalid: port scans are
    unnamed, failed logins have a severity that does not exist, ports are missing or misplaced."""
    kinds = events(spark, sf, udm=False).select("source_ip", "event_action", "event_severity", "destination_port").distinct()
    action, port = F.col("event_action"), F.col("destination_port")
    text = F.concat_ws(", ", *[F.concat(F.lit(f'"{key}": '), value) for key, value in {
        "name": F.when(action == "port_scan", F.lit('""')).otherwise(F.concat(F.lit('"'), "source_ip", F.lit(' '), action, F.lit('"'))),
        "severity": F.concat(F.lit('"'), F.when(action == "failed_login", "urgent").otherwise(F.col("event_severity")), F.lit('"')),
        "conditions": F.when(port.isNull(), "{}").when(port == 80, '{"": 80}')
                       .when(port == 443, F.concat(F.lit('{"event.action": {"eq": "'), action, F.lit('", "ne": "x"}}')))
                       .otherwise(F.concat(F.lit('{"destination.port": '), port.cast("string"), F.lit("}"))),
    }.items()])
    files = kinds.select(F.concat_ws("/", "source_ip", "event_action", "event_severity", "destination_port").alias("path"),
                         F.concat(F.lit("{"), text, F.lit("}")).alias("content"))
    rules, _ = load_rules(files)
    return validate_rules(rules).select("path", "name", "severity", "valid", F.array_join("errors", "; ").alias("errors"),
                                        F.array_join("warnings", "; ").alias("warnings"))
