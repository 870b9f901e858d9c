"""Scan forms agree with each other and with a brute-force evaluator; plan shape checks."""

import random

from pyspark.sql import functions as F

from brute import rule_matches
from conftest import SF_SMALL
from vigilark.operators import scan as SC
from vigilark.operators.rules import as_rules, sample_rules
from vigilark.operators.table_scan import scan_table
from vigilark.plans.bench_rules import generated_rules
from vigilark.schema import ECS_FIELDS, ecs_column
from vigilark.sources.events import security_events


def _dotted(row):
    d = row.asDict()
    out = {}
    for f in ECS_FIELDS:
        out[f] = d.get(ecs_column(f))
    out["hour"] = d.get("hour")
    return out


def _pairs(df):
    return sorted((r.event_id, r.rule_id) for r in df.select("event_id", "rule_id").collect())


def test_compiled_equals_table_equals_brute(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = sample_rules() + generated_rules(40, seed=7)
    compiled = _pairs(SC.scan(ev, rules))
    table = _pairs(scan_table(ev, rules))
    salted = _pairs(scan_table(ev, rules, broadcast_limit=0, hot_rows=40))
    rows = [(r.event_id, _dotted(r)) for r in ev.collect()]
    brute = sorted((eid, i) for eid, e in rows for i, rule in enumerate(rules) if rule_matches(e, rule))
    assert compiled == brute
    assert table == brute
    assert salted == brute
    assert len(brute) > 0


def test_prefilter_on_off_same(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = generated_rules(60, seed=3)
    assert _pairs(SC.scan(ev, rules, prefilter=True)) == _pairs(SC.scan(ev, rules, prefilter=False))


def test_scan_plan_has_no_exchange_or_python(spark):
    ev = security_events(spark, SF_SMALL, spread=False)
    plan = SC.scan(ev, sample_rules()).select("event_id", "rule_name")._jdf.queryExecution().executedPlan().toString()
    shuffles = [ln for ln in plan.split("\n") if "Exchange" in ln and "BroadcastExchange" not in ln]
    assert shuffles == []                       # only the rule table is broadcast
    assert "Python" not in plan
    assert "Generate" in plan


def test_scan_prunes_columns(spark):
    ev = security_events(spark, SF_SMALL, spread=False)
    rules = [{"name": "crit", "conditions": {"event.severity": "critical"}}]
    plan = SC.scan(ev, rules).select("event_id", "rule_name")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_typed_filter_pushed_to_parquet(spark):
    from vigilark.sources.events import read_table
    li = read_table(spark, SF_SMALL, "lineitem")          # spread: the filter still reaches the scan
    plan = SC.scan(li, [{"name": "q", "conditions": {"l_quantity": {"gt": 45}}}], prefilter=True)._jdf \
        .queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan


def test_reasons_and_explain(spark):
    ev = security_events(spark, SF_SMALL)
    m = SC.scan(ev, sample_rules())
    r = SC.scan_reasons(m).filter(F.col("rule_name") == "Critical_Event_Alert").first()
    assert r.reason == "Matched condition on field 'event.severity': critical"
    ex = SC.rule_explain(ev, {"name": "x", "conditions": {"event.severity": "critical", "file.path": "/etc"}})
    got = ex.filter(F.col("event_id") == 0).orderBy("condition_index").collect()
    assert [g.field for g in got] == ["event.severity", "file.path"]
    assert got[1].found == "None" and got[1].matched is False


def test_first_matches_limits_per_rule(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    m = SC.scan(ev, sample_rules())
    sample = SC.first_matches(m, 5)
    counts = {r.rule_id: r["count"] for r in sample.groupBy("rule_id").count().collect()}
    assert all(v <= 5 for v in counts.values())
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_random_rules_with_all_operators(spark):
    ev = security_events(spark, SF_SMALL, udm=False)
    rng = random.Random(11)
    rules = generated_rules(60, seed=rng.randint(0, 10 ** 6))
    assert _pairs(SC.scan(ev, rules)) == _pairs(scan_table(ev, rules))


def test_detect_picks_plan(spark):
    from vigilark.operators.table_scan import detect
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = generated_rules(30, seed=5)
    assert _pairs(detect(ev, rules)) == _pairs(detect(ev, rules, method="table")) == _pairs(SC.scan(ev, rules))


def test_java_invalid_regex_fails_at_compile_time(spark):
    import pytest
    from vigilark.operators.rules import RuleError
    ev = security_events(spark, SF_SMALL, udm=False)
    # valid for Python's re, rejected by java.util.regex (conditional group)
    rules = [{"name": "x", "conditions": {"message": {"regex": r"(a)?(?(1)b|c)"}}}]
    with pytest.raises(RuleError):
        SC.scan(ev, rules)
    # invalid for Python: the condition is simply false, no error
    assert SC.scan(ev, [{"name": "y", "conditions": {"message": {"regex": "("}}}]).count() == 0


SET = sample_rules() + generated_rules(40, seed=21)


def keyed(rule):
    """The rule has an equality or ``in`` condition (the others are compiled, not joined)."""
    return any(not isinstance(c, dict) or "eq" in c or "in" in c for c in rule["conditions"].values())


def test_division_form_agrees(spark):
    from division import scan_division
    ev = security_events(spark, SF_SMALL, udm=False)
    rules = [r for r, d in zip(as_rules(SET), SET) if keyed(d)]
    assert _pairs(scan_division(ev, rules)) == _pairs(SC.scan(ev, rules))
