"""ECS normalisation (action lookup + constants) and the derived hour column.

The lookups are tiny fixed tables, so they are written as CASE expressions: no join,
no broadcast, no map allocation per row; they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.pytext import py_isoformat
from vigilark.schema import (ACTION_LOOKUP, AGENT_TYPE, AGENT_VERSION, DEFAULT_ACTION_META, DESTINATION_IP,
                             EVENT_DATASET, EVENT_MODULE, HOST_NAME)


def lookup(c: Column, table: dict, default) -> Column:
    """CASE c WHEN k1 THEN v1 ... ELSE default (case-sensitive, null -> default)."""
    out = None
    for k, v in table.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v)))
    default_col = default if isinstance(default, Column) else F.lit(default)
    return default_col if out is None else out.otherwise(default_col)


def action_category(action: Column) -> Column:
    return lookup(action, {a: m[0] for a, m in ACTION_LOOKUP.items()}, DEFAULT_ACTION_META[0])


def action_type(action: Column) -> Column:
    return lookup(action, {a: m[1] for a, m in ACTION_LOOKUP.items()}, DEFAULT_ACTION_META[1])


def action_kind(action: Column) -> Column:
    return lookup(action, {a: m[2] for a, m in ACTION_LOOKUP.items()}, DEFAULT_ACTION_META[2])


def action_outcome(action: Column, own_outcome: Column) -> Column:
    """The action's fixed outcome wins; otherwise the event's own outcome."""
    fixed = {a: m[3] for a, m in ACTION_LOOKUP.items() if m[3] is not None}
    return lookup(action, fixed, own_outcome)


def ecs_normalize(raw: DataFrame, *, action: str = "action", outcome: str = "outcome",
                  timestamp: str = "timestamp", severity: str = "severity", source_ip: str = "source_ip",
                  destination_port: str = "destination_port", user_name: str = "user_name",
                  keep: tuple[str, ...] = ("event_id",), destination_ip: str = DESTINATION_IP,
                  dataset: str = EVENT_DATASET, module: str = EVENT_MODULE, host_name: str = HOST_NAME,
                  agent_type: str = AGENT_TYPE, agent_version: str = AGENT_VERSION,
                  message_prefix: str = "Security event detected: ") -> DataFrame:
    """Raw security records -> the flat ECS event table (underscore column names)."""
    a = F.col(action)
    ts = F.col(timestamp)
    src = F.col(source_ip)
    return raw.select(
        *[F.col(k) for k in keep],
        py_isoformat(ts).alias("at_timestamp"),
        ts.alias("timestamp"),
        action_kind(a).alias("event_kind"),
        action_category(a).alias("event_category"),
        action_type(a).alias("event_type"),
        a.alias("event_action"),
        action_outcome(a, F.col(outcome)).alias("event_outcome"),
        F.col(severity).alias("event_severity"),
        F.lit(dataset).alias("event_dataset"),
        F.lit(module).alias("event_module"),
        src.alias("source_ip"),
        src.alias("source_address"),
        F.lit(destination_ip).alias("destination_ip"),
        F.lit(destination_ip).alias("destination_address"),
        F.col(destination_port).cast("int").alias("destination_port"),
        F.col(user_name).alias("user_name"),
        F.concat(F.lit(message_prefix), a).alias("message"),
        F.lit(host_name).alias("host_name"),
        F.lit(agent_type).alias("agent_type"),
        F.lit(agent_version).alias("agent_version"),
    )


def with_hour(events: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Hour of day (0-23) of the event timestamp; rules can match on it."""
    return events.withColumn("hour", F.hour(F.col(timestamp)))
