"""Property test: compiled and table-driven condition evaluation agree with plain Python
str()/float()/re semantics on typed columns, for every operator form."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from brute import holds
from vigilark.operators import scan as SC
from vigilark.operators.compiler import condition_column, strict
from vigilark.operators.table_scan import scan_table

INTS = st.integers(-30, 30) | st.sampled_from([22, 1000, -1])
DOUBLES = st.sampled_from([22.0, 0.1, 1e16, -0.0, 0.0, 1e-5, 5.0, 4.5, float("nan"), 1000.0, -2.5, 12345678.0])
STRS = st.sampled_from(["5", "5.0", " 7 ", "1_000", "abc", "ABC", "True", "nan", "22", "x10.1", "Ab5", "", "1e16"])
BOOLS = st.booleans()

OPERANDS = st.sampled_from(["5", 5, 5.0, "5.0", True, "true", "abc", "22", 22, "22.0", "nan", "1e16", "1e+16",
                            "-0.0", "0.0", 1000, "1_000", "a", "b5", "AB", 4.5, "4.5", "inf", "x"])
MEMBERS = st.lists(OPERANDS, min_size=0, max_size=4)
REGEXES = st.sampled_from([r"^\d+$", r"a.c", r"5", r"^-?\d+\.\d+$", r"e\+16", r"(", r"TRUE", r"^$"])
CONDS = (OPERANDS
         | st.builds(lambda v: {"eq": v}, OPERANDS)
         | st.builds(lambda v: {"ne": v}, OPERANDS)
         | st.builds(lambda v: {"contains": v}, OPERANDS)
         | st.builds(lambda v: {"in": v}, MEMBERS)
         | st.builds(lambda v: {"gt": v}, OPERANDS)
         | st.builds(lambda v: {"lt": v}, OPERANDS)
         | st.builds(lambda v: {"regex": v}, REGEXES)
         | st.builds(lambda a, b: {"lt": a, "gt": b}, OPERANDS, OPERANDS))

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("i", T.IntegerType()),
                       T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()),
                       T.StructField("b", T.BooleanType())])


@settings(max_examples=int(os.environ.get("PROP_EXAMPLES", "25")), deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(INTS | st.none(), DOUBLES | st.none(), STRS | st.none(), BOOLS | st.none()),
                     min_size=1, max_size=8),
       field=st.sampled_from(["i", "d", "s", "b"]), cond=CONDS)
def test_condition_matches_python(spark, rows, field, cond):
    data = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    want = [holds(dict(zip(["id", "i", "d", "s", "b"], r))[field], cond) for r in data]
    col = strict(condition_column(df.schema, field, cond))
    got = [x.ok for x in df.orderBy("id").select(col.alias("ok")).collect()]
    assert got == want, (field, cond, data)
    rule = [{"name": "r", "conditions": {field: cond}}]
    ids_c = sorted(r.id for r in SC.scan(df, rule).select("id").collect())
    ids_t = sorted(r.id for r in scan_table(df, rule).select("id").collect())
    ids_w = [k for k, ok in enumerate(want) if ok]
    assert ids_c == ids_w and ids_t == ids_w, (field, cond, data)
