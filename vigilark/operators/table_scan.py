"""Table-driven rule scan: rules as rows, matched by an equi-join on an anchor condition.

When a rule set is large (thousands of rules), one giant compiled expression is slow to plan
and leaves whole-stage codegen. Here rules stay rows. ``rules`` is a rules table (as
``sources.rules.load_rules`` gives it, or any table with ``rule_json``), or a list on the driver.

* Every rule is read once into typed conditions, in tasks (``mapInArrow`` over the *rules*; Python
  decides what its own ``str``, ``float`` and ``re`` make of an operand; events never see Python).
* A rule's *anchor* is the equality or ``in`` condition whose values are rarest in these events:
  one aggregation counts the values that rules name. Doubles are compared by value (the text that
  Spark gives a double is unique to it), other types by Python's text.
* An event emits one key per field and kind of anchor, and joins the anchor rows ``(key, rule)``.
  The rule's other conditions are then tested on the pair by one data-driven ``forall``.
* Patterns are literals: each event gets the set of patterns it matches, before it is multiplied.

Anchor rows hold a key and a rule number; what a rule says (names, reasons, conditions) is joined
once by rule, not copied to each of its ``in`` members. Both tables are broadcast while their bytes
are under ``broadcast_limit``. Beyond it the join shuffles: a key that more than ``hot_rows`` events
hold is spread over as many tasks as it needs, its rule rows repeated for each, and an event's task
follows from a hash of all its columns, so a retry lands it in the same place. Frequent keys that
no anchor has are dropped before (all such keys, if the anchors' keys can be broadcast), and the
join has a task for about every ``TASK_ROWS`` keys, so a task does not grow with the events.

To the driver go the names of the fields that rules use, the patterns, and the rules without an
equality or ``in`` condition (these have to be tested on every event, and are compiled).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.fields import quoted, resolve, resolve_sql
from vigilark.functions.pytext import canonical_float, float_of, py_str, python_float, text_of
from vigilark.operators.compiler import accept_patterns, first_operator, java_pattern, reasons_of, scalar_like
from vigilark.operators.rules import Rule, RuleError, as_rules
from vigilark.operators.scan import MATCH_FIELDS, _s, scan
from vigilark.session import materialize

#: bytes of the anchor and rule tables up to which they are broadcast
BROADCAST_BYTES = 64 << 20
#: events of one anchor value that one task joins
HOT_ROWS = 1_000_000
#: keys of events that one task of the shuffle join takes, on average
TASK_ROWS = 250_000

COND = ("struct<no:int,field:string,kind:string,op:string,value:string,num:double,members:array<string>,"
        "nums:array<double>,bound:double>")
RULE_ROWS = ("rule_id int, rule_name string, rule_description string, rule_severity string, reasons array<string>, "
             f"conds array<{COND}>, rule_json string, error string")
ARROW_COND = pa.struct([("no", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("op", pa.string()),
                        ("value", pa.string()), ("num", pa.float64()), ("members", pa.list_(pa.string())),
                        ("nums", pa.list_(pa.float64())), ("bound", pa.float64())])
ARROW_RULE = pa.schema([("rule_id", pa.int32()), ("rule_name", pa.string()), ("rule_description", pa.string()),
                        ("rule_severity", pa.string()), ("reasons", pa.list_(pa.string())),
                        ("conds", pa.list_(ARROW_COND)), ("rule_json", pa.string()), ("error", pa.string())])


# ---------------------------------------------------------------------------
# rules -> typed conditions
# ---------------------------------------------------------------------------

def condition_row(no: int, field: str, dtype: T.DataType, cond: Any) -> dict | None:
    """One condition; None if it can never hold. ``kind`` d: a double compared by value, t: text."""
    row = {"no": no, "field": field, "kind": "t", "op": None, "value": None, "num": None, "members": None, "nums": None,
           "bound": None}
    double = isinstance(dtype, T.DoubleType)
    if scalar_like(cond):
        op, v = "eq", cond
    elif isinstance(cond, dict) and (op := first_operator(cond)) is not None:
        v = cond[op]
    else:
        return None
    if op in ("eq", "ne"):
        text = py_str(v).lower()
        if not double:
            return row | {"op": op, "value": text}
        num = canonical_float(text)
        if num is None:
            return None if op == "eq" else row | {"op": "present"}
        return row | {"kind": "d", "op": "is" if op == "eq" else "isnt", "num": num}
    if op == "contains":
        return row | {"op": op, "value": py_str(v).lower()}
    if op == "regex":
        if not isinstance(v, str):
            raise RuleError("regex operand is not a string")
        pattern = java_pattern(v)
        return None if pattern is None else row | {"op": op, "value": pattern}
    if op == "in":
        if isinstance(v, (int, float, bool)) or v is None:
            raise RuleError("'in' operand is not iterable")
        members = sorted({py_str(m) for m in v})
        if double:
            nums = [d for d in map(canonical_float, members) if d is not None]
            return row | {"kind": "d", "op": "in", "nums": nums} if nums else None
        return row | {"op": "in", "members": members} if members else None
    bound = python_float(v)
    if bound is None or bound != bound:
        return None
    return row | {"op": op, "bound": bound}


def rule_row(schema: T.StructType, rule: Rule, rule_json: str | None) -> dict | None:
    """One rule with its conditions; None if it can match no row of this schema."""
    if not rule.enabled or not rule.conditions:
        return None
    conds = []
    for no, (field, cond) in enumerate(rule.conditions):
        hit = resolve_sql(schema, field)
        row = None if hit is None else condition_row(no, field, hit[1], cond)
        if row is None:
            return None
        conds.append(row)
    return {"rule_id": int(rule.rule_id), "rule_name": _s(rule.name), "rule_description": _s(rule.description),
            "rule_severity": _s(rule.severity), "reasons": list(reasons_of(rule)), "conds": conds, "rule_json": rule_json,
            "error": None}


def _read_rules(schema_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = T.StructType.fromJson(json.loads(schema_json))
        for b in batches:
            rows = []
            for rule_id, text in zip(b["rule_id"].to_pylist(), b["rule_json"].to_pylist()):
                try:
                    row = rule_row(schema, Rule.from_dict(json.loads(text), rule_id), text)
                except RuleError as e:
                    row = dict.fromkeys(ARROW_RULE.names) | {"rule_id": rule_id, "error": f"{e} ({text[:200]})"}
                rows += [row] if row is not None else []
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_RULE)
    return run


def numbered(rules: DataFrame) -> DataFrame:
    """``rules`` with ``rule_id`` 0, 1, .. in the order of path, entry and text (kept if it is there)."""
    if "rule_id" in rules.columns:
        return rules.select(F.col("rule_id").cast("int").alias("rule_id"), "rule_json")
    order = [c for c in ("path", "entry_index", "rule_json") if c in rules.columns]
    part = materialize(rules.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "rule-order")
    first = part.groupBy("p").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    offset, total = {}, 0
    for r in first:         # a row a partition
        offset[r["p"]], total = total - r["first"], total + r["n"]
    if not offset:
        return part.select(F.lit(0).alias("rule_id"), "rule_json")
    shift = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    return part.select((F.col("at") + shift[F.col("p")]).cast("int").alias("rule_id"), "rule_json")


class RuleTable:
    """Rules as rows for one event schema, with the few facts about them that a plan needs."""

    def __init__(self, events: DataFrame, rules: Any):
        spark, self.schema, self.local = events.sparkSession, events.schema, None
        if isinstance(rules, DataFrame):
            self.rows = materialize(numbered(rules).mapInArrow(_read_rules(self.schema.json()), RULE_ROWS), "rules")
            bad = self.rows.filter(F.col("error").isNotNull()).select("error").first()
            if bad is not None:
                raise RuleError(bad["error"])
            self.rows = self.rows.drop("error")
            conds = self.rows.select("rule_id", F.inline("conds"))
            self.slots = sorted((r["kind"], r["field"]) for r in conds.select("kind", "field").distinct().collect())
            self.patterns = sorted((r["field"], r["value"]) for r in
                                   conds.filter(F.col("op") == "regex").select("field", "value").distinct().collect())
            self.numeric = {r["field"] for r in conds.filter(F.col("op").isin("gt", "lt")).select("field").distinct().collect()}
            loose = self.rows.filter(~anchored()).select("rule_id", "rule_json").collect()
            self.loose = [Rule.from_dict(json.loads(r["rule_json"]), r["rule_id"]) for r in loose]
            self.rows = self.rows.filter(anchored()).drop("rule_json")
            self.empty = self.rows.isEmpty()
        else:
            both = [(r, rule_row(self.schema, r, None)) for r in as_rules(rules)]
            rows = [row for _, row in both if row is not None]
            conds = [c for row in rows for c in row["conds"]]
            self.slots = sorted({(c["kind"], c["field"]) for c in conds})
            self.patterns = sorted({(c["field"], c["value"]) for c in conds if c["op"] == "regex"})
            self.numeric = {c["field"] for c in conds if c["op"] in ("gt", "lt")}
            keyed = [any(c["op"] in ANCHORS for c in row["conds"]) for row in rows]
            self.loose = [r for (r, _), k in zip([b for b in both if b[1] is not None], keyed) if not k]
            kept = [tuple(row.values()) for row, k in zip(rows, keyed) if k]
            self.empty = not kept
            self.rows = spark.createDataFrame([] if self.empty else [_as_tuples(r) for r in kept], RULE_ROWS).drop("error", "rule_json")
            self.local = None if self.empty else _local_anchors(spark, kept, self.slots)
        accept_patterns(spark, {p for _, p in self.patterns})

    def slot(self, kind: Column, field: Column) -> Column:
        at = {f"{k}:{f}": i for i, (k, f) in enumerate(self.slots)}
        return F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[F.concat_ws(":", kind, field)]

    def conditions(self) -> DataFrame:
        """Rules with ``rest``: their conditions, fields as slots and patterns as their hashes."""
        return self.rows.withColumn("rest", F.transform("conds", lambda c: F.struct(
            c["no"].alias("no"), self.slot(c["kind"], c["field"]).alias("slot"), c["op"].alias("op"),
            F.coalesce(c["num"].cast("string"), c["value"]).alias("value"),
            F.coalesce(c["members"], c["nums"].cast("array<string>")).alias("members"), c["bound"].alias("bound"),
            F.when(c["op"] == "regex", pattern_hash(c["field"], c["value"])).alias("pattern")))).drop("conds")

    def anchors(self) -> DataFrame:
        """(rule_id, no, a_key): every value of every equality and ``in`` condition."""
        c = self.conditions().select("rule_id", F.explode("rest").alias("c")).filter(F.col("c.op").isin(*ANCHORS))
        values = F.when(F.col("c.op") == "in", F.col("c.members")).otherwise(F.array("c.value"))
        return c.select("rule_id", F.col("c.no").alias("no"),
                        F.explode(F.transform(F.array_distinct(values), lambda v: F.concat_ws(
                            "|", F.col("c.slot").cast("string"), mode(F.col("c.op")), v))).alias("a_key"))


ANCHORS = ("eq", "is", "in")


def _local_anchors(spark: SparkSession, rows: list[tuple], slots: list[tuple]) -> list[tuple]:
    """(rule_id, no, a_key) of a rule list, as ``anchors`` has them. Only the text that Spark gives
    a double is asked of Spark."""
    conds = [(row[0], c) for row in rows for c in row[5] if c["op"] in ANCHORS]
    nums = [d for _, c in conds for d in (c["nums"] or []) + [c["num"]] if d is not None]
    said = {}
    if nums:
        shown = spark.createDataFrame([(i, d) for i, d in enumerate(nums)], "i int, d double").select("i", F.col("d").cast("string")).collect()
        said = {repr(nums[i]): t for i, t in shown}
    out = set()
    for rule_id, c in conds:
        values = c["members"] or [c["value"]]
        if c["kind"] == "d":
            values = [said[repr(d)] for d in c["nums"] or [c["num"]]]
        at = slots.index((c["kind"], c["field"]))
        out |= {(rule_id, c["no"], f"{at}|{'ci' if c['op'] == 'eq' else 'cs'}|{v}") for v in values}
    return sorted(out)


def _local_choice(events: DataFrame, table: "RuleTable") -> DataFrame:
    """The chosen anchors of a rule list: (a_key, rule_id). One count of the values it names, if any
    rule has a choice."""
    spark, counts = events.sparkSession, {}
    by: dict[int, dict[int, list[str]]] = {}
    for rule_id, no, key in table.local:
        by.setdefault(rule_id, {}).setdefault(no, []).append(key)
    if not events.isStreaming and any(len(c) > 1 for c in by.values()):
        keys = sorted({k for _, _, k in table.local})
        kinds = sorted({(int(k.split("|", 2)[0]), k.split("|", 2)[1]) for k in keys})
        named = spark.createDataFrame([(k,) for k in keys], "a_key string")
        held = _with_values(events, table, full=False).select(F.explode(_keys(kinds)).alias("a_key"))
        counts = dict(held.join(F.broadcast(named), "a_key", "left_semi").groupBy("a_key").count().collect())
    chosen = []
    for rule_id, conds in by.items():
        no = min(conds, key=lambda n: (sum(counts.get(k, 0) for k in conds[n]), len(conds[n]), n))
        chosen += [(k, rule_id) for k in conds[no]]
    return spark.createDataFrame(chosen, "a_key string, rule_id int")


def _as_tuples(row: tuple) -> tuple:
    return (*row[:5], [tuple(c.values()) for c in row[5]], *row[6:])


def anchored() -> Column:
    return F.exists("conds", lambda c: c["op"].isin(*ANCHORS))


def mode(op: Column) -> Column:
    return F.when(op == "eq", F.lit("ci")).otherwise(F.lit("cs"))


def pattern_hash(field: Column, pattern: Column) -> Column:
    return F.xxhash64(field, pattern)


# ---------------------------------------------------------------------------
# events -> keys
# ---------------------------------------------------------------------------

def _values(events: DataFrame, table: RuleTable) -> list[Column]:
    """The text of each slot (a double by value: as Spark prints it, which no other double shares)."""
    out = []
    for kind, field in table.slots:
        c, t = resolve(events.schema, field)
        out.append(c.cast("string") if kind == "d" else text_of(c, t).cast("string"))
    return out


def _with_values(events: DataFrame, table: RuleTable, full: bool) -> DataFrame:
    """Events with ``_texts`` and ``_lowers`` by slot; ``full``: also ``_nums`` and the set of patterns."""
    cols = [quoted(n) for n in events.columns]
    texts = F.array(*_values(events, table))
    if not full:
        return events.select(texts.alias("_texts")).select("_texts", F.transform("_texts", F.lower).alias("_lowers"))
    nums = []
    for kind, field in table.slots:
        c, t = resolve(events.schema, field)
        v = float_of(c, t) if kind == "t" and field in table.numeric else None
        nums.append((F.lit(None) if v is None else v).cast("double"))
    found = []
    for field, pattern in table.patterns:
        c, t = resolve(events.schema, field)
        found.append(F.when(text_of(c, t).rlike(pattern), pattern_hash(F.lit(field), F.lit(pattern))))
    patterns = F.filter(F.array(*found), lambda p: p.isNotNull()) if found else F.array().cast("array<bigint>")
    return (events.select(*cols, texts.alias("_texts"), F.array(*nums).alias("_nums"), patterns.alias("_patterns"))
            .select(*cols, "_texts", F.transform("_texts", F.lower).alias("_lowers"), "_nums", "_patterns"))


def _keys(kinds: list[tuple[int, str]]) -> Column:
    """The event's anchor keys, one a slot and mode in use."""
    return F.filter(F.array(*[
        F.concat(F.lit(f"{slot}|{m}|"), F.element_at("_lowers" if m == "ci" else "_texts", slot + 1)) for slot, m in kinds]),
        lambda k: k.isNotNull())


def _kinds(anchors: DataFrame) -> list[tuple[int, str]]:
    parts = F.split("a_key", r"\|", 3)
    rows = anchors.select(parts[0].cast("int").alias("slot"), parts[1].alias("mode")).distinct().collect()
    return sorted((r["slot"], r["mode"]) for r in rows)


def _small(df: DataFrame, size: Column, limit: int) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def _key_counts(events: DataFrame, table: RuleTable, candidates: DataFrame, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a_key, n): how many events hold each value that rules name. If these can't be broadcast,
    also each other value of more than ``hot_rows`` events, and under a null key the rest's total."""
    keys = (_with_values(events, table, full=False)
            .select(F.explode(_keys(_kinds(candidates))).alias("a_key")))
    named = candidates.select("a_key").distinct()
    if _small(named, F.octet_length("a_key") + 16, limit):
        return keys.join(F.broadcast(named), "a_key", "left_semi").groupBy("a_key").agg(F.count(F.lit(1)).alias("n"))
    every = keys.groupBy("a_key").agg(F.count(F.lit(1)).alias("n")).join(named.withColumn("_named", F.lit(True)), "a_key", "left")
    kept = F.when(F.col("_named") | (F.col("n") > hot_rows), F.col("a_key"))
    return every.groupBy(kept.alias("a_key")).agg(F.sum("n").alias("n"))


def _choose(candidates: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(a_key, rule_id) of each rule's rarest condition; without counts the one with fewest values."""
    cost = F.lit(0)
    if counts is not None:
        candidates, cost = candidates.join(counts, "a_key", "left"), F.sum(F.coalesce("n", F.lit(0)))
    per = candidates.groupBy("rule_id", "no").agg(cost.alias("cost"), F.count(F.lit(1)).alias("values"))
    best = per.groupBy("rule_id").agg(F.min_by("no", F.struct("cost", "values", "no")).alias("no"))
    return candidates.join(best, ["rule_id", "no"], "left_semi").select("a_key", "rule_id")


def _holds(c: Column) -> Column:
    t = F.element_at("_texts", c["slot"] + 1)
    low = F.element_at("_lowers", c["slot"] + 1)
    n = F.element_at("_nums", c["slot"] + 1)
    test = (F.when(c["op"] == "eq", low == c["value"])
            .when(c["op"] == "is", t == c["value"])
            .when(c["op"] == "ne", low != c["value"])
            .when(c["op"] == "isnt", t != c["value"])
            .when(c["op"] == "contains", low.contains(c["value"]))
            .when(c["op"] == "regex", F.array_contains("_patterns", c["pattern"]))
            .when(c["op"] == "in", F.array_contains(c["members"], t))
            .when(c["op"] == "gt", (n > c["bound"]) & ~F.isnan(n))
            .when(c["op"] == "lt", (n < c["bound"]) & ~F.isnan(n))
            .otherwise(c["op"] == "present"))
    return F.coalesce(t.isNotNull() & test, F.lit(False))


def _row_hash(schema: T.StructType) -> Column:
    """A hash of all that can be hashed of a row: the same in every attempt of a task."""
    def plain(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        return not isinstance(t, (T.MapType, T.VariantType))
    cols = [quoted(f.name) for f in schema.fields if plain(f.dataType)]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("bigint")


def _dealt(ev: DataFrame, row: Column, anchors: DataFrame, counts: DataFrame, limit: int,
           hot_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """``ev`` with ``_salt`` and without the keys that no anchor needs, (a_key, _tasks) of the keys
    of more than ``hot_rows`` events, and how many tasks the join needs. ``row``: a hash of a row."""
    used = anchors.select("a_key").distinct()
    few = _small(used, F.octet_length("a_key") + 16, limit)
    tasks = F.when(F.col("_used"), F.ceil(F.col("n") / hot_rows)).otherwise(0).cast("int")
    # at most one hot key for every hot_rows keys of events
    hot = materialize(counts.filter((F.col("n") > hot_rows) & F.col("a_key").isNotNull())
                      .join(used.withColumn("_used", F.lit(True)), "a_key", "left")
                      .select("a_key", "n", tasks.alias("_tasks")), "hot-keys")
    held = counts.join(F.broadcast(used), "a_key", "left_semi") if few else counts.join(
        F.broadcast(hot.filter("_tasks = 0")), "a_key", "left_anti")
    rows = held.agg(F.sum("n")).first()[0] or 0
    if few:
        ev = ev.join(F.broadcast(used), "a_key", "left_semi")
    hot = hot.drop("n")
    ev = (ev.withColumn("_row", row).join(F.broadcast(hot), "a_key", "left")
          .withColumn("_tasks", F.coalesce("_tasks", F.lit(1))).filter("_tasks > 0")
          .withColumn("_salt", F.pmod("_row", F.col("_tasks")).cast("int")).drop("_row", "_tasks"))
    return ev, hot, -(-rows // TASK_ROWS)


def scan_table(events: DataFrame, rules: Any, *, spark: SparkSession | None = None,
               broadcast_limit: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Same result as ``scan`` (one row per event x matching rule), planned as a join."""
    table = RuleTable(events, rules)
    cols = [quoted(n) for n in events.columns]
    parts = []
    if not table.empty:
        said = table.conditions()
        text = F.octet_length(F.to_json(F.struct(*[c for c in said.columns if c != "rule_id"]))) + 16
        fits = events.isStreaming or _small(said, text, broadcast_limit)
        if table.local is not None and (fits := fits and sum(len(k) + 16 for _, _, k in table.local) <= broadcast_limit):
            anchors = _local_choice(events, table)
            kinds = sorted({(int(k.split("|", 2)[0]), k.split("|", 2)[1]) for _, _, k in table.local})
        else:
            candidates, counts = materialize(table.anchors(), "rule-anchors"), None
            fits = fits and _small(candidates, F.octet_length("a_key") + 16, broadcast_limit)
            if not events.isStreaming:      # a stream can't be counted before it is read
                counts = materialize(_key_counts(events, table, candidates, broadcast_limit, hot_rows), "anchor-counts")
            anchors = materialize(_choose(candidates, counts), "anchors")
            kinds = _kinds(anchors)
        ev = (_with_values(events, table, full=True)
              .select(*cols, "_texts", "_lowers", "_nums", "_patterns", F.explode(_keys(kinds)).alias("a_key")))
        if fits:
            joined = ev.join(F.broadcast(anchors), "a_key").join(F.broadcast(said), "rule_id")
        else:
            ev, hot, tasks = _dealt(ev, _row_hash(events.schema), anchors, counts, broadcast_limit, hot_rows)
            fat = anchors.join(hot, "a_key", "left").join(said, "rule_id")
            fat = fat.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
            if tasks > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
                ev, fat = ev.repartition(tasks, "a_key", "_salt"), fat.repartition(tasks, "a_key", "_salt")
            joined = ev.join(fat.hint("merge"), ["a_key", "_salt"])
        hit = joined.filter(F.forall("rest", _holds))
        parts.append(hit.select(*cols, *[F.col(f) for f in MATCH_FIELDS]))
    if table.loose:
        parts.append(scan(events, table.loose).select(*cols, *[F.col(f) for f in MATCH_FIELDS]))
    if not parts:
        return scan(events, [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect(events: DataFrame, rules: Any, *, method: str = "compiled", scanned_at: Column | None | bool = True,
           **kw) -> DataFrame:
    """Scan by the form the caller names; the size of the rule set never chooses it.

    ``compiled`` builds one expression per rule; ``table`` joins on anchor conditions (rule
    sets in the thousands) and takes a rules table as it is. Matches carry the time of the scan
    in ``scanned_at`` (a column given here instead; None or False leaves it out).
    """
    if method not in ("compiled", "table"):
        raise ValueError(f"unknown method {method!r}")
    if method == "table":
        out = scan_table(events, rules, **kw)
    else:
        from vigilark.sources.rules import collect_rules
        out = scan(events, collect_rules(rules) if isinstance(rules, DataFrame) else as_rules(rules), **kw)
    if scanned_at is None or scanned_at is False:
        return out
    return out.withColumn("scanned_at", F.current_timestamp() if scanned_at is True else scanned_at)
