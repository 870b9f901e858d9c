"""Sinks: CSV flattens nested columns to JSON text; match JSON keeps reasons and the event."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigilark.operators import scan as SC
from vigilark.operators.rules import sample_rules
from vigilark.schema import UDM_SCHEMA
from vigilark.session import shared_dir
from vigilark.sources import sinks
from vigilark.sources.events import security_events


def test_csv_flattens_udm_to_json(spark):
    ev = security_events(spark, SF_SMALL).filter(F.col("event_id") < 20)
    path = sinks.write_events_csv(ev, shared_dir(spark, "csv-udm"))
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    row = back.filter(F.col("event_id") == "3").first()
    udm = json.loads(row.udm)
    assert udm["metadata"]["product_event_type"] == row.event_action
    assert back.count() == 20


def test_match_json_keeps_reasons_and_event(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    m = SC.scan(ev, sample_rules()).select("event_id", "event_action", *SC.MATCH_FIELDS)
    path = sinks.write_matches_json(m, shared_dir(spark, "match-json"), event_columns=["event_id", "event_action"])
    back = spark.read.json(path)
    r = back.filter(F.col("rule_name") == "Port_Scan_Activity").first()
    assert r.reasons == ["Matched condition on field 'event.action': {'in': ['port_scan', 'nmap_scan']}",
                         "Matched condition on field 'event.category': network"]
    assert r.event.event_action in ("port_scan", "nmap_scan")
    assert back.count() == m.count()


def test_udm_json_lines_read_back_with_schema(spark):
    ev = security_events(spark, SF_SMALL)
    path = sinks.write_udm_json(ev, shared_dir(spark, "udm-lines"))
    back = spark.read.schema(UDM_SCHEMA).json(path)
    assert back.count() == ev.count()
    assert back.filter(F.col("network.direction") != "OUTBOUND").count() == 0
