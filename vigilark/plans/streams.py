"""Registered streaming queries: each runs to completion and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilark.operators.alerts import alerts_frame
from vigilark.plans import catalog as C
from vigilark.plans.queries import query
from vigilark.streaming import streams as S


@query("stream_rule_scan")
def q_stream_rule_scan(spark, sf):
    ev = S.read_event_stream(spark, sf)
    matches = S.stream_scan(ev, C.flagship_rules()).select(
        "event_id", "rule_id", "rule_name", "rule_severity", "rule_description", "event_action", "source_ip")
    out = S.run_to_parquet(matches, "rule-scan", mode="append")
    return spark.read.parquet(out)


@query("stream_timeline")
def q_stream_timeline(spark, sf):
    ev = S.read_event_stream(spark, sf, udm=False)
    out = S.run_to_parquet(S.stream_timeline(ev), "timeline", mode="complete", state_partitions=16)
    return spark.read.parquet(out)


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    ev = S.read_event_stream(spark, sf, udm=False)
    alerts = alerts_frame(spark, C.STREAM_ALERT_RULES)
    counts = S.stream_alert_counts(ev, [a["event_type"] for a in C.STREAM_ALERT_RULES])
    out = S.run_to_parquet(counts, "alerts", mode="complete", state_partitions=16,
                           transform=lambda b: S.alert_windows(b, alerts, len(C.STREAM_ALERT_RULES)))
    return spark.read.parquet(out).select("window_start", "name", "event_type", "threshold", "n",
                                          F.col("triggered"))
