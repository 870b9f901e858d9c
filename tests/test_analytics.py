"""Alerts (incl. extensions), duplicate rule names, report timestamp, ECS reader, skewed keys."""

from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigilark.operators import alerts as AL
from vigilark.operators import analytics as AN
from vigilark.operators import scan as SC
from vigilark.operators.rules import sample_rules
from vigilark.operators.table_scan import scan_table
from vigilark.plans import catalog as C
from vigilark.schema import SEVERITIES
from vigilark.session import shared_dir
from vigilark.sources.events import read_ecs, security_events


def _rows(spark):
    return security_events(spark, SF_SMALL, udm=False).select(
        "event_action", "event_severity", "source_ip").collect()


def test_alert_status_brute_force(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rows = _rows(spark)
    by_action = Counter(r.event_action for r in rows)
    got = {r.name: (r.n, r.triggered) for r in AL.alert_status_for(ev, spark, C.ALERT_RULES).collect()}
    for a in C.ALERT_RULES:
        n = by_action.get(a["event_type"], 0)
        assert got[a["name"]] == (n, n >= a["threshold"])


def test_alert_extensions(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rows = _rows(spark)
    rank = {s: i for i, s in enumerate(SEVERITIES)}
    got = {r.name: (r.n, r.triggered)
           for r in AL.alert_status_for(ev, spark, C.ALERT_RULES, enforce_severity=True,
                                        honor_enabled=True).collect()}
    for a in C.ALERT_RULES:
        n = sum(1 for r in rows if r.event_action == a["event_type"]
                and rank.get(r.event_severity, -1) >= rank[a["severity"]])
        assert got[a["name"]] == (n, n >= a["threshold"] and a["enabled"])


def test_identical_alert_rules_are_counted_apart(spark):
    ev = spark.createDataFrame([("x", s) for s in ("low", "high", "critical", "medium", None)], "event_action string, event_severity string")
    rule = {"name": "r", "event_type": "x", "severity": "medium", "threshold": 3}
    rules = [rule, dict(rule), dict(rule, severity="critical"), dict(rule, severity="odd"), dict(rule, event_type="none")]
    got = sorted((r.event_type, r.severity, r.n, r.triggered) for r in AL.alert_status_for(ev, spark, rules, enforce_severity=True).collect())
    assert got == [("none", "medium", 0, False), ("x", "critical", 1, False), ("x", "medium", 3, True), ("x", "medium", 3, True),
                   ("x", "odd", 0, False)]


def test_duplicate_rule_names_each_match(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    r = sample_rules()
    dup = [r[2], dict(r[2]), r[4]]
    m = SC.scan(ev, dup)
    counts = Counter((x.rule_id, x.rule_name) for x in m.select("rule_id", "rule_name").collect())
    assert counts[(0, "Critical_Event_Alert")] == counts[(1, "Critical_Event_Alert")] > 0
    t = scan_table(ev, dup)
    assert sorted(m.select("event_id", "rule_id").collect()) == sorted(t.select("event_id", "rule_id").collect())


def test_report_carries_scan_time(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rep = SC.match_report(SC.scan(ev, sample_rules(), scanned_at=F.current_timestamp()))
    assert rep.columns == ["Timestamp", "Rule", "Severity", "Description", "Event Type", "Source IP"]
    assert rep.filter(F.col("Timestamp").isNull()).count() == 0


def test_read_ecs_round_trip(spark):
    ev = security_events(spark, SF_SMALL, udm=False, hour=False)
    path = shared_dir(spark, "ecs-table")
    ev.write.parquet(path)
    back = read_ecs(spark, path)
    assert sorted(back.collect()) == sorted(ev.collect())


def test_skewed_key_results_stay_whole(spark):
    """A third of the rows on one source IP: counts, distinct counts and scans stay exact."""
    ev = security_events(spark, SF_SMALL, udm=False)
    hot = ev.withColumn("source_ip", F.when(F.col("event_id") % 3 == 0, F.lit("10.9.9.9"))
                        .otherwise(F.col("source_ip")))
    rows = hot.select("event_id", "source_ip", "event_action").collect()
    want = Counter(r.source_ip for r in rows)
    got = {r.source_ip: r.n for r in AN.value_counts(hot, "source_ip").collect()}
    assert got == dict(want)
    assert AN.overview(hot).first().unique_source_ips == len(want)
    rules = [{"name": "hot", "conditions": {"source.ip": "10.9.9.9", "event.action": {"in": ["port_scan",
                                                                                             "nmap_scan"]}}}]
    brute = sorted(r.event_id for r in rows if r.source_ip == "10.9.9.9"
                   and r.event_action in ("port_scan", "nmap_scan"))
    for df in (SC.scan(hot, rules), scan_table(hot, rules, broadcast_limit=0, hot_rows=10)):
        assert sorted(r.event_id for r in df.select("event_id").collect()) == brute


def test_partitioned_ecs_table_prunes_days(spark):
    import datetime as dt
    from vigilark.sources.sinks import write_ecs
    ev = security_events(spark, SF_SMALL, udm=False)
    path = shared_dir(spark, "ecs-by-day")
    write_ecs(ev, path)
    back = read_ecs(spark, path)
    day = back.filter(F.col("event_date") == F.lit(dt.date(2024, 1, 3)))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    want = ev.filter(F.to_date("timestamp") == F.lit(dt.date(2024, 1, 3))).count()
    assert day.count() == want > 0
    assert sorted(back.drop("event_date").collect()) == sorted(ev.collect())


def test_multiselect_null_semantics(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    with_nulls = ev.withColumn("event_severity", F.when(F.col("event_id") % 7 == 0, F.lit(None))
                               .otherwise(F.col("event_severity")))
    rows = with_nulls.select("event_severity").collect()
    picked = AN.filter_multi(with_nulls, severities=[None, "high"]).count()
    assert picked == sum(1 for r in rows if r.event_severity in (None, "high"))
    assert AN.filter_multi(with_nulls, severities=[]).count() == 0
    assert AN.filter_multi(with_nulls).count() == len(rows)
    opts = {r.value for r in AN.distinct_options(with_nulls).filter(F.col("field") == "severity").collect()}
    assert None in opts and "high" in opts
    counts = {r.event_severity for r in AN.severity_counts(with_nulls).collect()}
    assert None not in counts


def test_overview_approx_distinct_within_bound(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    exact = AN.overview(ev).first()
    approx = AN.overview(ev, approx=True).first()
    assert approx.total_events == exact.total_events
    assert abs(approx.unique_source_ips - exact.unique_source_ips) <= 0.05 * exact.unique_source_ips + 1
