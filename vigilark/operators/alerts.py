"""Count-threshold alerts.

An alert rule watches one action and fires when the number of events with exactly that
action (case-sensitive) reaches its threshold. Severity and enabled are stored but do not
gate the alert unless asked (``enforce_severity`` / ``honor_enabled`` are extensions).

Plan: the events are first restricted to the watched actions (an ``IN`` list, pushed to
the scan when it can be), counted per action with a partial aggregation, then joined to
the alert rules. The alert table is small and its row count is checked before it is
broadcast; above the limit the join falls back to a shuffle join.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.schema import ALERT_SCHEMA, SEVERITIES

BROADCAST_ALERT_LIMIT = 100_000


def alerts_frame(spark: SparkSession, alerts: list[dict[str, Any]]) -> DataFrame:
    rows = [(a.get("name"), a.get("event_type"), a.get("severity"), int(a.get("threshold", 1)),
             a.get("description", ""), a.get("created_at") or datetime(2024, 1, 1), bool(a.get("enabled", True)))
            for a in alerts]
    return spark.createDataFrame(rows, ALERT_SCHEMA)


def _severity_rank(c):
    out = F.when(c == F.lit(SEVERITIES[0]), F.lit(0))
    for i, s in enumerate(SEVERITIES[1:], start=1):
        out = out.when(c == F.lit(s), F.lit(i))
    return out


def alert_status(events: DataFrame, alerts: DataFrame, *, watched: list[str] | None = None,
                 n_alerts: int | None = None, enforce_severity: bool = False,
                 honor_enabled: bool = False) -> DataFrame:
    """Per alert rule: matching events ``n`` and ``triggered = n >= threshold``."""
    ev = events
    if watched is not None:
        ev = ev.filter(F.col("event_action").isin(sorted({w for w in watched if w is not None})))
    n = F.count(F.lit(1))
    if enforce_severity:        # by least severity: one count a level, so a row an action here too
        rank = _severity_rank(F.col("event_severity"))
        n = F.array(*[F.count_if(rank >= i) for i in range(len(SEVERITIES))])
    counts = ev.groupBy(F.col("event_action").alias("_action")).agg(n.alias("_n"))
    if watched is not None and n_alerts is not None and n_alerts <= BROADCAST_ALERT_LIMIT:
        # counts has at most one row per watched action (<= n_alerts): broadcast it
        counts = F.broadcast(counts)
    found = F.get("_n", _severity_rank(F.col("severity"))) if enforce_severity else F.col("_n")
    counted = (alerts.join(counts, alerts["event_type"] == counts["_action"], "left")
               .select(*[alerts[c] for c in alerts.columns], F.coalesce(found, F.lit(0)).alias("n")))
    triggered = F.col("n") >= F.col("threshold")
    if honor_enabled:
        triggered = triggered & F.col("enabled")
    return counted.select("name", "event_type", "severity", "threshold", "n", triggered.alias("triggered"))


def alert_status_for(events: DataFrame, spark: SparkSession, alerts: list[dict[str, Any]], **kw) -> DataFrame:
    """Alert rules given as a list: the watched actions are known, so the scan is pruned."""
    return alert_status(events, alerts_frame(spark, alerts), watched=[a.get("event_type") for a in alerts],
                        n_alerts=len(alerts), **kw)


def alerts_triggered(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("total_rules"), F.count_if("triggered").alias("triggered"))
