"""Plan checks over every registered batch query: no Python evaluation, no cross joins,
and shuffles only where an aggregation, a sort or a join needs one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from plan_report import SIDE_EFFECT, summary  # noqa: E402

BATCH = sorted(n for n in E.queries() if not n.startswith(SIDE_EFFECT))
SCANS = [n for n in BATCH if n.startswith(("rule_scan", "pred_", "rule_and", "rules_enabled", "nested_path",
                                           "match_report", "match_head", "udm_"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cross_join(spark, name):
    s = summary(E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())
    assert not s["python"]
    assert not s["cartesian"]


@pytest.mark.parametrize("name", SCANS)
def test_scans_never_shuffle_events_by_key(spark, name):
    s = summary(E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())
    if name == "rule_scan_table_salted":      # the form for tables too large to broadcast
        assert "SortMergeJoin" in s["joins"] and "hashpartitioning" in s["shuffle_kinds"]
        return
    # only the small-input round-robin spread may appear; rule tables are broadcast
    assert set(s["shuffle_kinds"]) <= {"RoundRobinPartitioning"}


LIMIT_IS_THE_FEATURE = {"top_source_ips", "top_users", "match_head"}


def test_limits_only_where_they_are_the_feature(spark):
    sql = E.oracle_sql()
    assert {n for n, q in sql.items() if " LIMIT " in q.upper()} == LIMIT_IS_THE_FEATURE
    limited = set()
    for name in BATCH:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if any(k in plan for k in ("TakeOrderedAndProject", "GlobalLimit", "CollectLimit", "LocalLimit")):
            limited.add(name)
    assert limited == LIMIT_IS_THE_FEATURE
