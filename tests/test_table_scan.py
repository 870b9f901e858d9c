"""The table-driven scan: rules as a table, doubles by value, rare anchors, hot keys, patterns."""

import json
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import rule_matches
from conftest import SF_SMALL
from vigilark.operators import scan as SC
from vigilark.operators import table_scan as TS
from vigilark.operators.rules import RuleError, sample_rules
from vigilark.plans.bench_rules import generated_rules
from vigilark.sources.events import security_events
from vigilark.sources.rules import load_rules, rule_texts_frame, rules_frame


def pairs(df, key="event_id"):
    return sorted((r[key], r["rule_id"]) for r in df.select(key, "rule_id").collect())


def test_rules_table_equals_rule_list(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = sample_rules() + generated_rules(60, seed=9)
    want = SC.scan(ev, rules)
    got = TS.scan_table(ev, rules_frame(spark, rules))
    fields = ("event_id", "rule_id", "rule_name", "rule_description", "rule_severity", "reasons")
    assert sorted(map(str, got.select(*fields).collect())) == sorted(map(str, want.select(*fields).collect()))
    assert pairs(TS.scan_table(ev, rules_frame(spark, rules), broadcast_limit=0, hot_rows=30)) == pairs(want)


def test_rule_numbers_follow_path_and_entry(spark):
    a, b = sample_rules()[:2], sample_rules()[2:]
    files = [("z", json.dumps(b)), ("a", json.dumps(a))]
    rules, _ = load_rules(rule_texts_frame(spark, files).repartition(2))
    got = {r["rule_id"]: json.loads(r["rule_json"])["name"] for r in TS.numbered(rules.repartition(5)).collect()}
    assert got == {i: r["name"] for i, r in enumerate(a + b)}
    assert TS.numbered(rules.filter("false")).collect() == []


def double(bits):
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


FINITE = st.floats(allow_nan=True) | st.integers(0, 2 ** 64 - 1).map(double) | st.sampled_from(
    [1e23, 2e23, 8.827e18, 5e-324, 1.5, 2.0 ** 70, 0.0, -0.0, 1e16, 1e-5])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(FINITE, min_size=1, max_size=25), op=st.sampled_from(["plain", "eq", "ne", "in", "contains"]))
def test_all_doubles_in_both_forms(spark, xs, op):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, d double")

    def cond(x):
        text = repr(x)
        return {"plain": x, "eq": {"eq": text}, "ne": {"ne": x}, "in": {"in": [text, "7"]}, "contains": {"contains": text[-4:]}}[op]
    rules = [{"name": f"r{i}", "conditions": {"d": cond(x)}} for i, x in enumerate(xs)]
    want = sorted((i, k) for i, x in enumerate(xs) for k, r in enumerate(rules) if rule_matches({"d": x}, r))
    assert pairs(SC.scan(df, rules), "id") == want
    assert pairs(TS.scan_table(df, rules), "id") == want


def test_anchor_is_the_rarest_condition(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = [{"name": "a", "conditions": {"event.outcome": "failure", "source.ip": "10.0.0.3"}},
             {"name": "b", "conditions": {"event.outcome": {"in": ["failure"]}, "user.name": {"in": ["root", "nobody"]},
                                          "event.severity": "critical"}}]
    table = TS.RuleTable(ev, rules)
    candidates = table.anchors()
    chosen = TS._choose(candidates, TS._key_counts(ev, table, candidates, TS.BROADCAST_BYTES)).collect()
    values = {r["rule_id"]: r["a_key"].split("|", 2)[2] for r in chosen}
    assert values == {0: "10.0.0.3", 1: "critical"}
    assert pairs(TS.scan_table(ev, rules)) == pairs(SC.scan(ev, rules))


def test_long_member_list_is_not_copied(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    members = [f"10.0.{i % 256}.{i // 256}" for i in range(20_000)]
    rules = [{"name": "ioc", "conditions": {"source.ip": {"in": members}}}]
    table = TS.RuleTable(ev, rules)
    size = table.anchors().agg(F.sum(F.octet_length("a_key") + 16)).first()[0]
    assert table.anchors().columns == ["rule_id", "no", "a_key"] and size < 1_000_000
    assert pairs(TS.scan_table(ev, rules)) == pairs(SC.scan(ev, rules))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_form_joins_by_exchange_and_splits_hot_keys(spark):
    ev = security_events(spark, SF_SMALL, udm=False).withColumn(
        "source_ip", F.when(F.col("event_id") % 3 == 0, "10.9.9.9").otherwise(F.col("source_ip")))
    rules = [{"name": "hot", "conditions": {"source.ip": "10.9.9.9"}}, {"name": "cool", "conditions": {"source.ip": "10.0.0.3"}}]
    got = TS.scan_table(ev, rules, broadcast_limit=0, hot_rows=20)
    plan = plan_of(got)
    assert "SortMergeJoin [a_key" in plan and "Exchange hashpartitioning(a_key" in plan
    assert pairs(got) == pairs(SC.scan(ev, rules))


def test_join_tasks_follow_the_events(spark, monkeypatch):
    monkeypatch.setattr(TS, "TASK_ROWS", 500, raising=False)
    ev = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("x").alias("d"))
    got = TS.scan_table(ev, [{"name": "r", "conditions": {"d": "x"}}], broadcast_limit=0, hot_rows=100)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2000


def test_frequent_values_of_no_anchor_are_not_shuffled(spark):
    # "a" and "b" hold most events, but no rule asks for "a", and the other rule is anchored elsewhere
    rows = [(i, "a" if i % 2 else "b" if i % 8 else f"v{i}", f"u{i % 50}") for i in range(2000)] + [(2000, None, "u7")]
    ev = spark.createDataFrame(rows, "event_id long, kind string, user string")
    rules = [{"name": "one", "conditions": {"kind": "v8"}}, {"name": "two", "conditions": {"kind": "b", "user": "u2"}}]
    table = TS.RuleTable(ev, rules)
    candidates = table.anchors()
    for limit in (0, TS.BROADCAST_BYTES):
        counts = TS._key_counts(ev, table, candidates, limit, 100)
        anchors = TS._choose(candidates, counts)
        keys = TS._with_values(ev, table, full=True).select("*", F.explode(TS._keys(TS._kinds(anchors))).alias("a_key"))
        dealt, hot, tasks = TS._dealt(keys, F.xxhash64("event_id"), anchors, counts, limit, 100)
        held = {r["a_key"].split("|", 2)[2] for r in dealt.select("a_key").distinct().collect()}
        assert {"v8", "u2"} <= held and not held & {"a", "b"} and tasks == 1
        assert (held == {"v8", "u2"}) == (limit > 0)
        got = TS.scan_table(ev, rules, broadcast_limit=limit, hot_rows=100)
        assert pairs(got) == pairs(SC.scan(ev, rules)) and got.count() > 10


def test_patterns_are_literals(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = [{"name": "rx", "conditions": {"event.outcome": "failure", "source.ip": {"regex": r"\.1\d?$"}, "message": {"regex": "SCAN"}}}]
    got = TS.scan_table(ev, rules)
    for line in plan_of(got).split("RLIKE ")[1:]:
        assert line.startswith("(?iu)"), line[:60]
    assert pairs(got) == pairs(SC.scan(ev, rules)) and got.count() > 0


def test_malformed_rules_in_a_table_are_refused(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    for cond in ({"in": 5}, {"regex": 5}, {"regex": "(a)?(?(1)b|c)"}):
        with pytest.raises(RuleError):
            TS.scan_table(ev, rules_frame(spark, [{"name": "x", "conditions": {"message": cond}}]))


def test_tables_without_live_rules(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    none = rules_frame(spark, [{"name": "off", "enabled": False, "conditions": {"message": "x"}},
                               {"name": "nofield", "conditions": {"file.path": "x"}}])
    assert TS.scan_table(ev, none).count() == 0 and TS.scan_table(ev, []).count() == 0
    loose = rules_frame(spark, [{"name": "hour", "conditions": {"hour": {"gt": 11}}}])
    assert TS.scan_table(ev, loose).count() == ev.filter("hour > 11").count()


def test_matches_carry_the_scan_time(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    for method in ("compiled", "table"):
        m = TS.detect(ev, sample_rules(), method=method)
        assert SC.match_report(m).columns[0] == "Timestamp" and m.filter("scanned_at is null").count() == 0
    assert "scanned_at" not in TS.detect(ev, sample_rules(), scanned_at=None).columns
