"""Relational division, a cross-check of the scan: unpivot events to one row a field, join every
condition on it, keep those that hold, and group by event and rule having all conditions."""

from pyspark.sql import functions as F

from vigilark.functions.fields import quoted
from vigilark.operators.table_scan import RuleTable, _holds, _with_values


def scan_division(events, rules, key=("event_id",)):
    table = RuleTable(events, rules)
    keys = [quoted(k) for k in key]
    conds = table.conditions().select("rule_id", F.size("rest").alias("n"), F.explode("rest").alias("c"))
    long = _with_values(events, table, full=True).select(*keys, "_texts", "_lowers", "_nums", "_patterns",
                                                         F.posexplode("_texts").alias("slot", "_t"))
    held = long.join(conds, F.col("slot") == F.col("c.slot")).filter(_holds(F.col("c")))
    return held.groupBy(*keys, "rule_id", "n").count().filter("count = n").select(*keys, "rule_id")
