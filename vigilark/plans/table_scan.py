"""Registered queries for the table-driven scan."""

from __future__ import annotations

from vigilark.operators.table_scan import scan_table
from vigilark.plans import catalog as C
from vigilark.plans.queries import events, query
from vigilark.sources.rules import rules_frame


COLUMNS = ("event_id", "rule_id", "rule_name", "rule_severity", "rule_description", "event_action", "source_ip")


@query("rule_scan_table")
def q_rule_scan_table(spark, sf):
    # rules as a table: read, typed and anchored by Spark, none of them collected
    return scan_table(events(spark, sf), rules_frame(spark, C.flagship_rules())).select(*COLUMNS)


@query("rule_scan_table_salted")
def q_rule_scan_table_salted(spark, sf):
    # the shuffle join (tables above the broadcast limit), hot anchor values spread over tasks
    return scan_table(events(spark, sf), rules_frame(spark, C.flagship_rules()), broadcast_limit=0,
                      hot_rows=1000).select(*COLUMNS)
