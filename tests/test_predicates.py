"""Golden truth table for single conditions (FIXTURES section 4) and Python-text parity."""

import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.pyregex import to_java_regex
from vigilark.functions.udm import udm_session_id
from vigilark.functions.pytext import py_float_of_string, py_float_text, py_isoformat, text_of
from vigilark.operators.compiler import compile_rule, condition_column, strict
from vigilark.operators.rules import Rule, RuleError, as_rules


def one(spark, dtype, value, field="f", cond=None):
    schema = T.StructType([T.StructField(field, dtype)])
    df = spark.createDataFrame([(value,)], schema)
    col = strict(condition_column(df.schema, field, cond))
    return df.select(col.alias("ok")).first().ok


GOLDEN = [
    (T.StringType(), "FAILURE", "failure", True),
    (T.StringType(), "ROOT", {"in": ["root"]}, False),
    (T.IntegerType(), 22, 22, True),
    (T.IntegerType(), 22, "22", True),
    (T.DoubleType(), 22.0, 22, False),
    (T.DoubleType(), 22.0, "22.0", True),
    (T.BooleanType(), True, "TRUE", True),
    (T.BooleanType(), True, {"in": ["true"]}, False),
    (T.BooleanType(), True, {"in": ["True"]}, True),
    (T.StringType(), None, {"ne": "x"}, False),
    (T.IntegerType(), 15, {"gt": 10, "lt": 12}, True),
    (T.StringType(), "a", {"eq": "a", "contains": "z"}, False),
    (T.StringType(), "abc", {"startswith": "a"}, False),
    (T.StringType(), "a", ["a"], False),
    (T.StringType(), "a", None, False),
    (T.StringType(), "a", {"in": "abc"}, True),
    (T.StringType(), "x10.1", {"regex": r"10\."}, True),
    (T.StringType(), "abc", {"regex": "("}, False),
    (T.StringType(), "5", {"gt": "4.5"}, True),
    (T.StringType(), "5d", {"gt": 1}, False),
    (T.StringType(), "1_000", {"gt": 999}, True),
    (T.StringType(), " 7 ", {"lt": 8}, True),
    (T.StringType(), "abc", {"gt": 1}, False),
    (T.DoubleType(), float("nan"), {"gt": 5}, False),
    (T.DoubleType(), float("nan"), "nan", True),
    (T.DoubleType(), -0.0, "0.0", False),
    (T.DoubleType(), -0.0, "-0.0", True),
    (T.DoubleType(), 1e16, {"contains": "e+16"}, True),
    (T.TimestampNTZType(), datetime(2024, 1, 1), {"gt": 0}, False),
    (T.TimestampNTZType(), datetime(2024, 1, 1, 5, 6, 7, 120000), "2024-01-01 05:06:07.120000", True),
    (T.TimestampNTZType(), datetime(2024, 1, 1, 5, 6, 7), "2024-01-01 05:06:07", True),
    (T.StringType(), "Hello", {"ne": "HELLO"}, False),
    (T.StringType(), "Hello", {"ne": "bye"}, True),
    (T.IntegerType(), 5, {"ne": "5.0"}, True),
    (T.BooleanType(), False, {"gt": -1}, True),
    (T.StringType(), "ÉCOLE", {"regex": "^école$"}, True),
    (T.StringType(), "x\r", {"regex": "x.$"}, True),
]


@pytest.mark.parametrize("dtype,value,cond,expect", GOLDEN)
def test_golden(spark, dtype, value, cond, expect):
    assert one(spark, dtype, value, cond=cond) is expect


def test_nested_walk_and_flat_first(spark):
    schema = T.StructType([
        T.StructField("user.email", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("email", T.StringType())])),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ])
    df = spark.createDataFrame([(None, ("e",), {"k": "v"}, ["a"])], schema)
    flat_null = strict(condition_column(df.schema, "user.email", "e"))
    assert df.select(flat_null).first()[0] is False
    only_struct = df.drop("user.email")
    assert only_struct.select(condition_column(only_struct.schema, "user.email", "E")).first()[0] is True
    assert df.select(condition_column(df.schema, "props.k", "V")).first()[0] is True
    assert condition_column(df.schema, "tags.0", "a") is None          # lists are not walked
    assert condition_column(df.schema, "missing.field", "a") is None


def test_ecs_alias_resolution(spark):
    df = spark.createDataFrame([("ssh_login",)], "event_action string")
    assert df.select(condition_column(df.schema, "event.action", "SSH_LOGIN")).first()[0] is True


def test_rule_and_enabled(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    assert compile_rule(df.schema, as_rules([{"conditions": {}}])[0]).predicate is None
    assert compile_rule(df.schema, as_rules([{"enabled": False, "conditions": {"x": "a"}}])[0]).predicate is None
    r = as_rules([{"enabled": "false", "conditions": {"x": "A", "y": {"lt": 2}}}])[0]
    assert df.select(compile_rule(df.schema, r).predicate).first()[0] is True
    r = as_rules([{"conditions": {"x": "A", "y": {"gt": 2}}}])[0]
    assert df.select(strict(compile_rule(df.schema, r).predicate)).first()[0] is False


def test_reasons_use_python_repr():
    r = as_rules([{"name": "n", "conditions": {"a.b": {"in": ["x", 1, True]}, "c": 2.5}}])[0]
    from vigilark.operators.compiler import reasons_of
    assert reasons_of(r) == ("Matched condition on field 'a.b': {'in': ['x', 1, True]}",
                             "Matched condition on field 'c': 2.5")


def test_malformed_rules_rejected():
    with pytest.raises(RuleError):
        Rule.from_dict({"conditions": ["x"]})
    with pytest.raises(RuleError):
        Rule.from_dict("not an object")
    sch = T.StructType([T.StructField("x", T.StringType())])
    with pytest.raises(RuleError):
        condition_column(sch, "x", {"in": 5})
    with pytest.raises(RuleError):
        condition_column(sch, "x", {"regex": 5})


DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 1e16, 1e-5, 1e-4, 12345678.0, 123.456, 1.5e-7, 9999999999999998.0,
           1e22, 2.5e-300, 1.7976931348623157e308, 0.001, 1234567.0, 100.0, 3.14159, float("inf"),
           float("-inf"), float("nan")]


def test_float_text_parity(spark):
    df = spark.createDataFrame([(d,) for d in DOUBLES], "d double")
    got = [r.t for r in df.select(py_float_text(F.col("d")).alias("t")).collect()]
    assert got == [repr(d) for d in DOUBLES]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_float_text_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "d double")
    got = [r.t for r in df.select(py_float_text(F.col("d")).alias("t")).collect()]
    assert got == [repr(x) for x in xs]


STRINGS = ["5", " 5 ", "5d", "5f", "1_000", "1__000", "_1", "1_", "1e5", "1E-2", ".5", "5.", "-.5e1", "inf", "-Infinity",
           "nan", "NaN", "+inf", "0x10", "", " ", "abc", "1,5", "1.2.3", "12e", "+7", "--7"]


def test_float_parse_parity(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    got = [r.v for r in df.select(py_float_of_string(F.col("s")).alias("v")).collect()]
    for s, g in zip(STRINGS, got):
        try:
            want = float(s)
        except ValueError:
            want = None
        if want is None:
            assert g is None, s
        elif math.isnan(want):
            assert g is not None and math.isnan(g), s
        else:
            assert g == want, s


def test_isoformat_and_str(spark):
    rows = [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 600),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    out = df.select(py_isoformat(F.col("t")).alias("iso"), text_of(F.col("t"), T.TimestampNTZType()).alias("s"))
    got = [(r.iso, r.s) for r in out.collect()]
    assert got == [(d.isoformat(), str(d)) for (d,) in rows]


def test_text_timestamps_pass_through(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "soon", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(py_isoformat(F.col("t")).alias("iso"), udm_session_id(F.lit("a"), F.lit("b"), F.col("t")).alias("s")).collect()
    assert [r.iso for r in got] == texts
    assert [r.s for r in got] == [f"a_b_{t or ''}" for t in texts]


def test_uncased_text_is_compared_as_it_is(spark):
    sch = T.StructType([T.StructField("source_ip", T.StringType())])
    rule = as_rules([{"name": "n", "conditions": {"source.ip": "10.0.0.3"}}])[0]
    assert compile_rule(sch, rule).predicate_sql == "(`source_ip` = '10.0.0.3')"
    cased = as_rules([{"name": "n", "conditions": {"source.ip": "fe80::1"}}])[0]
    assert "lower(" in compile_rule(sch, cased).predicate_sql


def test_regex_translation():
    assert to_java_regex("(") is None
    assert to_java_regex(r"(?P<x>a)(?P=x)\Z") == r"(?iu)(a)(?:\1)\z"
    assert to_java_regex("a{,3}") == "(?iu)(?:a){0,3}"
