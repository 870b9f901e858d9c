"""Registered sink round-trips: write with the sink, read back with a fixed schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.operators import analytics as AN
from vigilark.operators import scan as SC
from vigilark.operators.udm import udm_flat
from vigilark.plans import catalog as C
from vigilark.plans.queries import events, flagship_matches, query
from vigilark.schema import ECS_SCHEMA, UDM_SCHEMA
from vigilark.session import shared_dir
from vigilark.sources import sinks

CSV_EVENT_SCHEMA = T.StructType(list(ECS_SCHEMA.fields) + [T.StructField("hour", T.IntegerType())])
REPORT_SCHEMA = T.StructType([T.StructField(n, T.StringType())
                              for n in ("Rule", "Severity", "Description", "Event Type", "Source IP")])


@query("export_events_csv")
def q_export_events_csv(spark, sf):
    filtered = AN.filter_multi(events(spark, sf, udm=False), **C.MULTI_FILTER)
    path = sinks.write_events_csv(filtered, shared_dir(spark, "events-csv"))
    back = sinks.read_csv(spark, path, CSV_EVENT_SCHEMA)
    return back.select("event_id", "timestamp", "event_severity", "event_action", "event_outcome",
                       "destination_port", "user_name", "message")


@query("export_udm_json")
def q_export_udm_json(spark, sf):
    path = sinks.write_udm_json(events(spark, sf), shared_dir(spark, "udm-json"))
    back = spark.read.schema(UDM_SCHEMA).json(path)
    return back.select(*udm_flat(F.struct(*[F.col(c) for c in back.columns])))


@query("export_matches_csv")
def q_export_matches_csv(spark, sf):
    path = sinks.write_matches_csv(flagship_matches(spark, sf), shared_dir(spark, "matches-csv"))
    return sinks.read_csv(spark, path, REPORT_SCHEMA)


@query("export_matches_json")
def q_export_matches_json(spark, sf):
    m = flagship_matches(spark, sf).select("event_id", "event_action", "source_ip", *SC.MATCH_FIELDS)
    path = sinks.write_matches_json(m, shared_dir(spark, "matches-json"),
                                    event_columns=["event_id", "event_action", "source_ip"])
    back = spark.read.json(path)
    return back.select(F.col("event.event_id").alias("event_id"), "rule_name", F.col("severity").alias(
        "rule_severity"), F.col("description").alias("rule_description"), F.col("event.event_action").alias(
        "event_action"), F.col("event.source_ip").alias("source_ip"), F.size("reasons").alias("n_reasons"))
