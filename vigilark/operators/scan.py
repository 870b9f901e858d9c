"""Rule scans over event tables.

Compiled scan (``scan``): every enabled rule becomes one boolean SQL expression. Each
distinct condition of the rule set is evaluated once per row into a boolean column; each
row then emits the ids of the rules whose conditions all hold via
``explode(filter(array(CASE WHEN c_a AND c_b THEN i END ...)))`` and the
rule's id / name / severity / reasons are read from literal arrays indexed by the rule's
position (sized by the rule count). One pass over the data: no join, no exchange.

Test / explain / reports are built the same way: per-rule counts are ``count_if``
aggregates in one pass (partial aggregation, one tiny final stage) and the first-k
samples use a ranked window that Spark limits per partition before the shuffle.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.fields import quoted, resolve
from vigilark.functions.pytext import py_str, text_of
from vigilark.functions.sqltext import sql_str
from vigilark.operators.compiler import (CompiledRule, any_of, check_patterns, compile_rules, condition_column,
                                         strict)
from vigilark.operators.rules import Rule, as_rules
from vigilark.schema import NOT_AVAILABLE, SEVERITIES, UNKNOWN_SEVERITY

MATCH_FIELDS = ("rule_id", "rule_name", "rule_description", "rule_severity", "reasons")


def _s(v: Any) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else py_str(v)


def _rule_arrays(compiled: list[CompiledRule]) -> dict[str, Column]:
    """Rule id / name / description / severity / reasons as literal arrays indexed by the
    rule's position (size = rule count; folded into the plan, no join, no exchange)."""
    def arr(items: list[str]) -> Column:
        return F.expr("array(" + ", ".join(items) + ")")
    return {
        "rule_id": arr([str(int(c.rule.rule_id)) for c in compiled]),
        "rule_name": arr([sql_str(_s(c.rule.name)) for c in compiled]),
        "rule_description": arr([sql_str(_s(c.rule.description)) for c in compiled]),
        "rule_severity": arr([sql_str(_s(c.rule.severity)) for c in compiled]),
        "reasons": arr(["CAST(array(" + ", ".join(sql_str(x) for x in c.reasons) + ") AS ARRAY<STRING>)"
                        for c in compiled]),
    }


def _shared_conditions(compiled: list[CompiledRule]) -> dict[str, str]:
    """Distinct condition texts across the rule set -> column alias (``__cond0__``, ...).

    Rules reuse conditions (``event.category = authentication`` in many rules); each
    distinct condition is evaluated once per row into a boolean column and the rules AND
    those columns, instead of re-evaluating the same test inside every rule."""
    conds: dict[str, str] = {}
    for c in compiled:
        for p in c.part_sqls or ():
            conds.setdefault(p, f"__cond{len(conds)}__")
    return conds


def _hit(c: CompiledRule, pos: int, conds: dict[str, str]) -> Column:
    """CASE WHEN <rule holds> THEN <rule position> END: one JVM call for an all-SQL rule."""
    if c.part_sqls is not None:
        return F.expr(f"CASE WHEN {' AND '.join(conds[p] for p in c.part_sqls)} THEN {pos} END")
    return F.when(c.predicate, F.lit(pos))


def _any_rule(compiled: list[CompiledRule]) -> Column:
    if all(c.predicate_sql is not None for c in compiled):
        return F.expr(" OR ".join(f"({c.predicate_sql})" for c in compiled))
    return any_of([c.predicate for c in compiled])


def live_rules(events: DataFrame, rules: Any, regex_ok=None) -> list[CompiledRule]:
    """Compiled rules that can match at least one row of this schema.

    Regex patterns are checked against the JVM engine first (one constant query), so a
    pattern Python accepts but Java rejects fails here, not on an executor."""
    rs = as_rules(rules)
    if regex_ok is None:
        check_patterns(events.sparkSession, rs)
    return [c for c in compile_rules(events.schema, rs, regex_ok) if c.live]


def _empty_matches(events: DataFrame) -> DataFrame:
    return events.filter(F.lit(False)).select(
        "*", F.lit(None).cast("int").alias("rule_id"), F.lit(None).cast("string").alias("rule_name"),
        F.lit(None).cast("string").alias("rule_description"), F.lit(None).cast("string").alias("rule_severity"),
        F.lit(None).cast("array<string>").alias("reasons"))


def scan(events: DataFrame, rules: Any, *, prefilter: bool = False, scanned_at: Column | None = None,
         regex_ok=None) -> DataFrame:
    """One row per (event, matching enabled rule): event columns + rule columns + reasons.

    ``prefilter=True`` first filters on the OR of all rule predicates. Use it when the
    rules test *stored* columns of a Parquet table: typed comparisons then reach the
    reader as pushed filters (row groups skipped by min/max statistics). On derived
    columns (e.g. the ECS projection) Catalyst would push the OR below the projection and
    inline every derived expression, so it only costs; rows whose hit array is empty
    already produce nothing in the explode.
    """
    compiled = live_rules(events, rules, regex_ok)
    if not compiled:
        out = _empty_matches(events)
    else:
        base = events.filter(_any_rule(compiled)) if prefilter else events
        conds = _shared_conditions(compiled)
        evaluated = base.select("*", *[F.expr(sql).alias(alias) for sql, alias in conds.items()])
        hits = F.array(*[_hit(c, i, conds) for i, c in enumerate(compiled)])
        pos = evaluated.select(*[quoted(n) for n in events.columns],
                               F.explode(F.filter(hits, lambda m: m.isNotNull())).alias("_pos"))
        meta = _rule_arrays(compiled)
        out = pos.select(*[quoted(n) for n in events.columns],
                         *[F.element_at(meta[f], F.col("_pos") + 1).alias(f) for f in MATCH_FIELDS])
    if scanned_at is not None:
        out = out.withColumn("scanned_at", scanned_at)
    return out


def scan_reasons(matches: DataFrame, key: str = "event_id") -> DataFrame:
    """Matches with one row per reason (reason_index from 0, in condition order)."""
    return matches.select(quoted(key), "rule_id", "rule_name",
                          F.posexplode("reasons").alias("reason_index", "reason"))


# ---------------------------------------------------------------------------
# rule test / explain
# ---------------------------------------------------------------------------

def rule_test_summary(events: DataFrame, rules: Any, regex_ok=None) -> DataFrame:
    """Per enabled rule: matched events and total events, from one grouped count.

    Each event gives the positions of the rules that hold, and position -1 for the total; they are
    counted map-side, so at most one row a rule and task is shuffled, whatever the rule count."""
    rs = [r for r in as_rules(rules) if r.enabled]
    if regex_ok is None:
        check_patterns(events.sparkSession, rs)
    compiled = compile_rules(events.schema, rs, regex_ok)
    if not compiled:
        return events.sparkSession.createDataFrame([], "rule_id int, rule_name string, matched bigint, total bigint")
    live = [(i, c) for i, c in enumerate(compiled) if c.live]
    conds = _shared_conditions([c for _, c in live])
    evaluated = events.select("*", *[F.expr(sql).alias(a) for sql, a in conds.items()])
    hits = F.filter(F.array(F.lit(-1), *[_hit(c, i, conds) for i, c in live]), lambda m: m.isNotNull())
    counts = evaluated.select(F.explode(hits).alias("_pos")).groupBy("_pos").agg(F.count(F.lit(1)).alias("_n"))
    # one row: a map with an entry a rule
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_n"))).alias("_found"))
    names = F.expr("array(" + ", ".join(sql_str(_s(c.rule.name)) for c in compiled) + ")")
    ids = F.expr("array(" + ", ".join(str(int(c.rule.rule_id)) for c in compiled) + ")")

    def count(pos: Column) -> Column:
        return F.coalesce(F.try_element_at("_found", pos), F.lit(0).cast("bigint"))

    return (found.select("_found", F.posexplode(F.arrays_zip(ids.alias("i"), names.alias("n"))).alias("_pos", "_r"))
            .select(F.col("_r.i").alias("rule_id"), F.col("_r.n").alias("rule_name"), count(F.col("_pos")).alias("matched"),
                    count(F.lit(-1)).alias("total")))


def first_matches(matches: DataFrame, k: int, order: tuple[str, ...] = ("event_id",),
                  by: str = "rule_id") -> DataFrame:
    """First ``k`` matches per rule in ``order`` (rank column ``sample_rank`` from 1)."""
    w = Window.partitionBy(by).orderBy(*[F.col(o) for o in order])
    return matches.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)


def match_head(matches: DataFrame, k: int = 10, order: tuple[str, ...] = ("event_id", "rule_id")) -> DataFrame:
    """First ``k`` matches overall (top-k, no full sort)."""
    return matches.orderBy(*order).limit(k)


def rule_explain(events: DataFrame, rule: Any, key: str = "event_id", regex_ok=None) -> DataFrame:
    """Per event and condition of one rule: field, expected, found value, whether it holds.

    ``found`` is Python's text of the value (``None`` when missing); conditions are
    evaluated independently, without the AND.
    """
    r = rule if isinstance(rule, Rule) else as_rules([rule])[0]
    rows = []
    for i, (field, cond) in enumerate(r.conditions):
        hit = resolve(events.schema, field)
        found = F.lit("None") if hit is None else F.coalesce(text_of(*hit), F.lit("None"))
        ok = condition_column(events.schema, field, cond, regex_ok)
        rows.append(F.struct(F.lit(i).alias("condition_index"), F.lit(field).alias("field"),
                             F.lit(py_str(cond)).alias("expected"), found.alias("found"),
                             strict(ok).alias("matched")))
    if not rows:
        return events.filter(F.lit(False)).select(
            quoted(key), F.lit(0).alias("condition_index"), F.lit("").alias("field"),
            F.lit("").alias("expected"), F.lit("").alias("found"), F.lit(False).alias("matched"))
    return (events.select(quoted(key), F.explode(F.array(*rows)).alias("_c"))
            .select(quoted(key), "_c.*"))


# ---------------------------------------------------------------------------
# reports over matches
# ---------------------------------------------------------------------------

def match_report(matches: DataFrame) -> DataFrame:
    ev = lambda n: F.coalesce(quoted(n), F.lit(NOT_AVAILABLE)) if n in matches.columns else F.lit(NOT_AVAILABLE)
    cols = []
    if "scanned_at" in matches.columns:
        cols.append(F.col("scanned_at").alias("Timestamp"))
    return matches.select(
        *cols,
        F.coalesce(F.col("rule_name"), F.lit(NOT_AVAILABLE)).alias("Rule"),
        F.coalesce(F.col("rule_severity"), F.lit(NOT_AVAILABLE)).alias("Severity"),
        F.coalesce(F.col("rule_description"), F.lit(NOT_AVAILABLE)).alias("Description"),
        ev("event_action").alias("Event Type"),
        ev("source_ip").alias("Source IP"),
    )


def match_severity_summary(matches: DataFrame) -> DataFrame:
    return (matches.groupBy(F.coalesce(F.col("rule_severity"), F.lit(UNKNOWN_SEVERITY)).alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def match_severity_buckets(matches: DataFrame) -> DataFrame:
    """The four fixed buckets (0 when absent), one row, one aggregation pass."""
    return matches.agg(*[F.count_if(F.col("rule_severity") == F.lit(s)).alias(s) for s in reversed(SEVERITIES)])


def rule_stats(rules: Any, matches: DataFrame) -> DataFrame:
    """Total rules, enabled rules, total matches."""
    rs = as_rules(rules)
    return matches.agg(F.lit(len(rs)).alias("total_rules"),
                       F.lit(sum(1 for r in rs if r.enabled)).alias("enabled_rules"),
                       F.count(F.lit(1)).alias("total_matches"))


__all__ = ["scan", "scan_reasons", "rule_test_summary", "first_matches", "match_head", "rule_explain",
           "match_report", "match_severity_summary", "match_severity_buckets", "rule_stats", "live_rules",
           ]
