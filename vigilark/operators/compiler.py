"""Rule compiler: a rule's conditions -> one boolean ``Column`` (built-in expressions only).

Condition law (per field):
  * a missing / null value fails every operator, ``ne`` included;
  * a scalar (str, int, float, bool) is case-insensitive equality of Python text;
  * an object is decided by the first operator present in the order
    contains, regex, in, eq, ne, gt, lt; others are ignored;
  * anything else (list, null, object without a known operator) fails.
A rule matches when it is enabled, has at least one condition and all hold.

Typed columns are compared by folding the literal on the driver (``22`` vs a double
column can never match since Python prints ``22.0``) so that plain comparisons reach the
Parquet scan as pushed filters; only string work needs ``lower``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.fields import resolve, resolve_sql
from vigilark.functions.pytext import (_DEC, _SPECIAL, canonical_float, canonical_int, double_equals, float_of,
                                       py_str, python_float, text_of)
from vigilark.functions.pyregex import UnsupportedPattern, to_java_regex
from vigilark.functions.sqltext import sql_double, sql_str
from vigilark.operators.rules import Rule, RuleError, as_rules
from vigilark.schema import OPERATOR_ORDER, REASON_TEMPLATE

FALSE = None  # a condition that can never hold is represented by None

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INT_RANGE = {T.ByteType: 2 ** 7, T.ShortType: 2 ** 15, T.IntegerType: 2 ** 31, T.LongType: 2 ** 63}


def _int_fits(dtype: T.DataType, v: int) -> bool:
    lim = _INT_RANGE[type(dtype)]
    return -lim <= v < lim


def uncased(s: str) -> bool:
    """No text but ``s`` itself has ``s`` as its lower case, so equality needs no ``lower`` and
    reaches the Parquet reader (ASCII without letters: addresses, numbers, dates)."""
    return s.isascii() and not any(ch.isalpha() for ch in s)


def java_pattern(pattern: str) -> str | None:
    """``to_java_regex``; a pattern that Java has no form for is a rule error."""
    try:
        return to_java_regex(pattern)
    except UnsupportedPattern as e:
        raise RuleError(f"regex not supported by the JVM engine: {pattern!r}: {e}") from None


def scalar_like(v: Any) -> bool:
    return isinstance(v, (str, int, float, bool))


def first_operator(cond: dict) -> str | None:
    for op in OPERATOR_ORDER:
        if op in cond:
            return op
    return None


# ---------------------------------------------------------------------------
# per-operator builders; each returns a Column (null where the value is null) or None
# ---------------------------------------------------------------------------

def equals_text(c: Column, dtype: T.DataType, s: str) -> Column | None:
    """``str(value).lower() == s`` where ``s`` is already lower-case."""
    if isinstance(dtype, T.StringType):
        return (c if uncased(s) else F.lower(c)) == F.lit(s)
    if isinstance(dtype, _INTEGRAL):
        v = canonical_int(s)
        return (c == F.lit(v)) if v is not None and _int_fits(dtype, v) else None
    if isinstance(dtype, T.BooleanType):
        if s == "true":
            return c
        if s == "false":
            return ~c
        return None
    if isinstance(dtype, T.DoubleType):
        d = canonical_float(s)
        return double_equals(c, d) if d is not None else None
    return F.lower(text_of(c, dtype)) == F.lit(s)


def member_of(c: Column, dtype: T.DataType, members: list[str]) -> Column | None:
    """``str(value) in members`` (case-sensitive)."""
    if not members:
        return None
    if isinstance(dtype, T.StringType):
        return c.isin(sorted(set(members)))
    if isinstance(dtype, _INTEGRAL):
        vals = sorted({v for v in map(canonical_int, members) if v is not None and _int_fits(dtype, v)})
        return c.isin(vals) if vals else None
    if isinstance(dtype, T.BooleanType):
        vals = sorted({m == "True" for m in members if m in ("True", "False")})
        return c.isin(vals) if vals else None
    if isinstance(dtype, T.DoubleType):
        ds = [d for d in map(canonical_float, members) if d is not None]
        plain = sorted({d for d in ds if d == d and d != 0.0})
        parts = [c.isin(plain)] if plain else []
        parts += [double_equals(c, d) for d in ds if d != d or d == 0.0]
        return any_of(parts) if parts else None
    return text_of(c, dtype).isin(sorted(set(members)))


def compare_number(c: Column, dtype: T.DataType, operand: Any, op: str) -> Column | None:
    bound = python_float(operand)
    if bound is None or bound != bound:
        return None
    v = float_of(c, dtype)
    if v is None:
        return None
    test = (v > F.lit(bound)) if op == "gt" else (v < F.lit(bound))
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.StringType)):
        test = test & ~F.isnan(v)
    return test


# ---------------------------------------------------------------------------
# SQL-text builders (one JVM call per rule); None = "no SQL form, use the Column builder"
# ---------------------------------------------------------------------------

_NEVER = "__never__"


def _double_eq_sql(r: str, d: float) -> str:
    if d != d:
        return f"isnan({r})"
    if d == 0.0:
        zero_text = "-0.0" if str(d).startswith("-") else "0.0"
        return f"({r} = 0.0D AND CAST({r} AS STRING) = '{zero_text}')"
    return f"{r} = {sql_double(d)}"


def _eq_sql(r: str, dtype: T.DataType, s: str) -> str | None:
    if isinstance(dtype, T.StringType):
        return f"{r} = {sql_str(s)}" if uncased(s) else f"lower({r}) = {sql_str(s)}"
    if isinstance(dtype, _INTEGRAL):
        v = canonical_int(s)
        return f"{r} = {v}" if v is not None and _int_fits(dtype, v) else _NEVER
    if isinstance(dtype, T.BooleanType):
        return r if s == "true" else f"NOT {r}" if s == "false" else _NEVER
    if isinstance(dtype, T.DoubleType):
        d = canonical_float(s)
        return _double_eq_sql(r, d) if d is not None else _NEVER
    return None


def _in_sql(r: str, dtype: T.DataType, members: list[str]) -> str | None:
    if not members:
        return _NEVER
    if isinstance(dtype, T.StringType):
        return f"{r} IN ({', '.join(sql_str(m) for m in sorted(set(members)))})"
    if isinstance(dtype, _INTEGRAL):
        vals = sorted({v for v in map(canonical_int, members) if v is not None and _int_fits(dtype, v)})
        return f"{r} IN ({', '.join(map(str, vals))})" if vals else _NEVER
    if isinstance(dtype, T.BooleanType):
        vals = sorted({m == "True" for m in members if m in ("True", "False")})
        return f"{r} IN ({', '.join(str(v).lower() for v in vals)})" if vals else _NEVER
    if isinstance(dtype, T.DoubleType):
        ds = [d for d in map(canonical_float, members) if d is not None]
        if not ds:
            return _NEVER
        return "(" + " OR ".join(_double_eq_sql(r, d) for d in ds) + ")"
    return None


def _float_sql(r: str, dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.StringType):
        t = f"trim(regexp_replace({r}, {sql_str(r'^\s+|\s+$')}, ''))"
        return (f"(CASE WHEN {t} RLIKE {sql_str(_DEC)} THEN try_cast(replace({t}, '_', '') AS DOUBLE) "
                f"WHEN {t} RLIKE {sql_str(_SPECIAL)} THEN (CASE WHEN lower({t}) LIKE '%nan%' "
                f"THEN CAST('NaN' AS DOUBLE) WHEN {t} LIKE '-%' THEN CAST('-Infinity' AS DOUBLE) "
                f"ELSE CAST('Infinity' AS DOUBLE) END) END)")
    if isinstance(dtype, (T.BooleanType, T.NumericType)):
        return f"CAST({r} AS DOUBLE)"
    return _NEVER


def _condition_sql(r: str, dtype: T.DataType, cond: Any, regex_ok) -> str | None:
    if scalar_like(cond):
        return _eq_sql(r, dtype, py_str(cond).lower())
    if not isinstance(cond, dict):
        return _NEVER
    op = first_operator(cond)
    if op is None:
        return _NEVER
    operand = cond[op]
    if op == "contains":
        if not isinstance(dtype, T.StringType):
            return None
        return f"contains(lower({r}), {sql_str(py_str(operand).lower())})"
    if op == "regex":
        if not isinstance(operand, str):
            raise RuleError("regex operand is not a string")
        jp = java_pattern(operand)
        if jp is None or (regex_ok is not None and not regex_ok(jp)):
            return _NEVER
        return f"{r} RLIKE {sql_str(jp)}" if isinstance(dtype, T.StringType) else None
    if op == "in":
        if isinstance(operand, (int, float, bool)) or operand is None:
            raise RuleError("'in' operand is not iterable")
        return _in_sql(r, dtype, [py_str(m) for m in operand])
    if op in ("eq", "ne"):
        eq = _eq_sql(r, dtype, py_str(operand).lower())
        if eq is None or op == "eq":
            return eq
        return f"{r} IS NOT NULL" if eq == _NEVER else f"({r} IS NOT NULL AND NOT ({eq}))"
    bound = python_float(operand)
    if bound is None or bound != bound:
        return _NEVER
    v = _float_sql(r, dtype)
    if v == _NEVER:
        return _NEVER
    cmp = ">" if op == "gt" else "<"
    test = f"{v} {cmp} {sql_double(bound)}"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.StringType)):
        test = f"({test} AND NOT isnan({v}))"
    return test


class Pred:
    """A compiled condition / rule predicate: SQL text when available, else a Column."""

    __slots__ = ("sql", "_col")

    def __init__(self, sql: str | None = None, col: Column | None = None):
        self.sql, self._col = sql, col

    @property
    def column(self) -> Column:
        if self._col is None:
            self._col = F.expr(self.sql)
        return self._col


def condition_pred(schema: T.StructType, field: str, cond: Any, regex_ok=None) -> Pred | None:
    """Compile one condition; None means it can never hold."""
    hit = resolve_sql(schema, field)
    if hit is None:
        return None
    text = _condition_sql(hit[0], hit[1], cond, regex_ok)
    if text == _NEVER:
        return None
    if text is not None:
        return Pred(sql=text)
    col = _condition_column(schema, field, cond, regex_ok)
    return None if col is None else Pred(col=col)


def condition_column(schema: T.StructType, field: str, cond: Any, regex_ok=None) -> Column | None:
    """Compile one condition to a (nullable) boolean Column; None means it never holds.

    Left nullable on purpose: filters, CASE WHEN and count_if treat null as false, and a
    bare comparison (no coalesce around it) is what Parquet filter pushdown recognises.
    """
    p = condition_pred(schema, field, cond, regex_ok)
    return None if p is None else p.column


def _condition_column(schema: T.StructType, field: str, cond: Any, regex_ok=None) -> Column | None:
    """Column-builder form, used for the typed cases that have no SQL-text form."""
    hit = resolve(schema, field)
    if hit is None:
        return FALSE
    c, dtype = hit
    if scalar_like(cond):
        expr = equals_text(c, dtype, py_str(cond).lower())
    elif isinstance(cond, dict):
        op = first_operator(cond)
        if op is None:
            return FALSE
        operand = cond[op]
        if op == "contains":
            expr = F.lower(text_of(c, dtype)).contains(F.lit(py_str(operand).lower()))
        elif op == "regex":
            jp = java_pattern(operand)
            if jp is None or (regex_ok is not None and not regex_ok(jp)):
                return FALSE
            expr = text_of(c, dtype).rlike(jp)
        elif op == "in":
            expr = member_of(c, dtype, [py_str(m) for m in operand])
        elif op == "eq":
            expr = equals_text(c, dtype, py_str(operand).lower())
        elif op == "ne":
            eq = equals_text(c, dtype, py_str(operand).lower())
            expr = c.isNotNull() if eq is None else (c.isNotNull() & ~eq)
        else:
            expr = compare_number(c, dtype, operand, op)
    else:
        return FALSE
    return expr


def strict(c: Column | None) -> Column:
    """A non-null boolean (for display); None (never holds) -> false."""
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def all_of(cols: list[Column]) -> Column:
    return _balanced(cols, lambda a, b: a & b)


def any_of(cols: list[Column]) -> Column:
    return _balanced(cols, lambda a, b: a | b)


def _balanced(cols: list[Column], op) -> Column:
    """Balanced expression tree: a left-deep chain of hundreds of ORs breaks the planner."""
    if not cols:
        raise ValueError("empty")
    while len(cols) > 1:
        nxt = [op(cols[i], cols[i + 1]) for i in range(0, len(cols) - 1, 2)]
        if len(cols) % 2:
            nxt.append(cols[-1])
        cols = nxt
    return cols[0]


class CompiledRule:
    """A rule plus its predicate (SQL text when every condition has one) and reasons."""

    def __init__(self, rule: Rule, parts: list[Pred] | None, reasons: tuple[str, ...]):
        self.rule, self.reasons = rule, reasons
        self.predicate_sql: str | None = None
        self.part_sqls: list[str] | None = None
        self._col: Column | None = None
        self.live = parts is not None
        if parts is not None:
            if all(p.sql is not None for p in parts):
                self.part_sqls = [p.sql for p in parts]
                self.predicate_sql = " AND ".join(f"({p.sql})" for p in parts)
            else:
                self._col = all_of([p.column for p in parts])

    @property
    def predicate(self) -> Column | None:
        """Boolean Column (nullable), or None when the rule can never match."""
        if not self.live:
            return None
        if self._col is None:
            self._col = F.expr(self.predicate_sql)
        return self._col


def reasons_of(rule: Rule) -> tuple[str, ...]:
    return tuple(REASON_TEMPLATE.format(field=f, condition=c) for f, c in rule.conditions)


def compile_rule(schema: T.StructType, rule: Rule, regex_ok=None) -> CompiledRule:
    if not rule.enabled or not rule.conditions:
        return CompiledRule(rule, None, ())
    parts = []
    for f, cond in rule.conditions:
        p = condition_pred(schema, f, cond, regex_ok)
        if p is None:
            return CompiledRule(rule, None, reasons_of(rule))
        parts.append(p)
    return CompiledRule(rule, parts, reasons_of(rule))


def compile_rules(schema: T.StructType, rules: Any, regex_ok=None) -> list[CompiledRule]:
    return [compile_rule(schema, r, regex_ok) for r in as_rules(rules)]


def java_regex_checker(spark):
    """Return a memoised check that Java accepts a translated pattern.

    Python-valid patterns that Java rejects must fail loudly at compile time rather than
    at run time on an executor; the check runs a one-row constant query per new pattern.
    """
    cache: dict[str, bool] = {}

    def ok(pattern: str) -> bool:
        if pattern not in cache:
            try:
                spark.range(1).select(F.lit("").rlike(pattern)).collect()
                cache[pattern] = True
            except Exception as e:  # noqa: BLE001 - surfaced as a rule error
                raise RuleError(f"regex not supported by the JVM engine: {pattern!r}: {e}") from None
        return cache[pattern]

    return ok


def rule_patterns(rules: Any) -> set[str]:
    """Translated patterns of every regex condition of the enabled rules."""
    out = set()
    for r in as_rules(rules):
        if not r.enabled:
            continue
        for _f, cond in r.conditions:
            if isinstance(cond, dict) and first_operator(cond) == "regex" and isinstance(cond["regex"], str):
                jp = java_pattern(cond["regex"])
                if jp is not None:
                    out.add(jp)
    return out


_ACCEPTED: set[tuple[str, str]] = set()      # (application id, pattern) already accepted by the JVM


def check_patterns(spark, rules: Any) -> None:
    """Validate all regex patterns of a rule set in one constant query (bisect on failure)."""
    accept_patterns(spark, rule_patterns(rules))


def accept_patterns(spark, patterns: set[str]) -> None:
    """Raise unless the JVM accepts these translated patterns. Those already accepted in this
    application are not checked again."""
    app = spark.sparkContext.applicationId
    pats = sorted(p for p in patterns if (app, p) not in _ACCEPTED)
    if not pats:
        return
    try:
        spark.range(1).select(*[F.lit("").rlike(p).alias(f"p{i}") for i, p in enumerate(pats)]).collect()
    except Exception:  # noqa: BLE001 - find the offending pattern(s)
        ok = java_regex_checker(spark)
        for p in pats:
            ok(p)
    _ACCEPTED.update((app, p) for p in pats)
