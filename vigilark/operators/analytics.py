"""Dashboard aggregates, filters, sorts and set operations over the ECS event table.

Every aggregate is a hash aggregation with a map-side partial stage, so a hot key (one
action or IP holding a third of all events) is collapsed inside each input partition
before the shuffle; the shuffle carries at most one row per key per partition.
Distinct counts go through Spark's two-level distinct aggregation, which likewise
de-duplicates map-side. Top-k uses ``orderBy().limit()`` -> TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.fields import quoted


def overview(events: DataFrame, *, approx: bool = False) -> DataFrame:
    """Total events, critical events, distinct source IPs (nulls excluded), failed events.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) for the IP count: an
    extension for very large tables, not the default.
    """
    distinct_ips = (F.approx_count_distinct("source_ip") if approx else F.countDistinct("source_ip"))
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_severity") == F.lit("critical")).alias("critical_events"),
        distinct_ips.alias("unique_source_ips"),
        F.count_if(F.col("event_outcome") == F.lit("failure")).alias("failed_events"),
    )


def hour_bucket(ts: Column) -> Column:
    """Start of the 1-hour bucket of a TIMESTAMP_NTZ, as TIMESTAMP_NTZ.

    Built from the wall-clock fields, so it does not depend on the session time zone
    (``date_trunc`` on NTZ returns a zoned TIMESTAMP and can shift across DST changes).
    """
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def timeline(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Event count per (1-hour bucket, severity); observed pairs only."""
    return (events.filter(F.col(ts).isNotNull() & F.col("event_severity").isNotNull())
            .groupBy(hour_bucket(F.col(ts)).alias("hour_start"), F.col("event_severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_counts(events: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Count per non-null value, most frequent first (ties: value ascending)."""
    key = name or column
    return (events.filter(quoted(column).isNotNull())
            .groupBy(quoted(column).alias(key)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)))


def top_values(events: DataFrame, column: str, k: int, name: str | None = None) -> DataFrame:
    """The ``k`` most frequent values (top-k is the feature: TakeOrderedAndProject)."""
    return value_counts(events, column, name).limit(k)


def action_counts(events: DataFrame) -> DataFrame:
    return value_counts(events, "event_action")


def severity_counts(events: DataFrame) -> DataFrame:
    return value_counts(events, "event_severity")


def outcome_counts(events: DataFrame) -> DataFrame:
    return value_counts(events, "event_outcome")


def top_source_ips(events: DataFrame, k: int = 10) -> DataFrame:
    return top_values(events, "source_ip", k)


def top_users(events: DataFrame, k: int = 5) -> DataFrame:
    return top_values(events, "user_name", k)


def events_by_hour(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events per hour of day (0-23), observed hours only, ascending."""
    return (events.filter(F.col(ts).isNotNull())
            .groupBy(F.hour(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("hour"))


OPTION_FIELDS = (("severity", "event_severity"), ("action", "event_action"), ("outcome", "event_outcome"))


def distinct_options(events: DataFrame, fields=OPTION_FIELDS) -> DataFrame:
    """Distinct values (null kept) of each filter field, from one pass and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(label).alias("field"), quoted(col).alias("value")) for label, col in fields])
    return events.select(F.explode(pairs).alias("_p")).select("_p.field", "_p.value").distinct()


def selected(c: Column, values: Iterable[Any] | None) -> Column:
    """Multi-select membership; ``None`` = default selection (everything); [] = nothing.

    A selected null matches null values, as a pandas ``isin`` does.
    """
    if values is None:
        return F.lit(True)
    vals = list(values)
    non_null = [v for v in vals if v is not None]
    test = c.isin(non_null) if non_null else F.lit(False)
    if len(non_null) != len(vals):
        test = test | c.isNull()
    return F.coalesce(test, F.lit(False))


def multi_filter_predicate(severities=None, actions=None, outcomes=None) -> Column:
    return (selected(F.col("event_severity"), severities) & selected(F.col("event_action"), actions)
            & selected(F.col("event_outcome"), outcomes))


def filter_multi(events: DataFrame, severities=None, actions=None, outcomes=None) -> DataFrame:
    return events.filter(multi_filter_predicate(severities, actions, outcomes))


def filter_counts(events: DataFrame, severities=None, actions=None, outcomes=None) -> DataFrame:
    """"Showing n of N": one aggregation pass."""
    return events.agg(F.count_if(multi_filter_predicate(severities, actions, outcomes)).alias("shown"),
                      F.count(F.lit(1)).alias("total"))


def events_latest(events: DataFrame, ts: str = "timestamp", key: str = "event_id") -> DataFrame:
    """Newest first (nulls last); the key breaks ties so range partitions stay balanced."""
    return events.orderBy(F.col(ts).desc_nulls_last(), F.col(key).asc())


def append(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; duplicates kept, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
