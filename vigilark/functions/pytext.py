"""Column builders that reproduce Python's ``str()`` / ``float()`` semantics
(patterns: ``pyregex``).

Detection rules compare ``str(value).lower()`` and ``float(value)`` the way Python
prints and parses them. Spark prints doubles, booleans and timestamps differently,
so every typed column gets a rendering here, built only from built-in functions
(JVM-side, whole-stage codegen; no Python UDF).
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_str(v: Any) -> str:
    """Python's own ``str()`` of a JSON-decoded value (driver side, exact)."""
    return str(v)


# ---------------------------------------------------------------------------
# value -> Python text
# ---------------------------------------------------------------------------

def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def py_float_text(c: Column) -> Column:
    """``repr(float)`` of a double column.

    Python prints the fewest digits that read back as the same double; the JVM sometimes prints
    more, or others. So the digits of the value (exact ones where a long holds it, else the JVM's)
    are cut to 1, 2, .. digits, rounded to the nearer side first and then the other, and the first
    text that reads back is taken. It is laid out the Python way: positional when the decimal
    exponent is in [-4, 16), else scientific.
    """
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(c), F.lit("nan"))
            .when(c == F.lit(float("inf")), F.lit("inf"))
            .when(c == F.lit(float("-inf")), F.lit("-inf"))
            .when(c == 0, F.when(c.cast("string").startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .otherwise(F.concat(sign, once(_shortest(F.abs(c)), _python_layout))))


def _shortest(c: Column) -> Column:
    """The fewest digits (``sig``, no zero at the end) and the decimal exponent ``x`` of a positive double."""
    s = c.cast("string")
    mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    point = F.length(F.regexp_extract(mantissa, r"^([0-9]+)", 1))
    digits = F.regexp_replace(mantissa, r"\.", "")
    lead = F.length(digits) - F.length(F.regexp_replace(digits, "^0+", ""))
    exact = (c >= 2.0 ** 53) & (c < 2.0 ** 63)
    whole = F.when(exact, c.try_cast("bigint").cast("string")).otherwise(
        F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", ""))
    size = F.when(exact, F.length(whole) - 1).otherwise(point + exponent - lead - 1)

    def search(v: Column) -> Column:
        def cut(k: Column) -> Column:
            unit = F.rpad(F.lit("1"), F.length(v["d"]) - k + 1, "0").cast("bigint")

            def sides(u: Column) -> Column:
                low, rest = F.call_function("div", v["d"].cast("bigint"), u), v["d"].cast("bigint") % u
                near = (2 * rest > u).cast("bigint")
                return F.array(low + near, low + 1 - near)
            return F.transform(once(unit, sides), lambda t: F.concat(t.cast("string"), F.lit("e"), (v["x"] - k + 1).cast("string")))

        tries = F.flatten(F.transform(F.sequence(F.lit(1), F.length(v["d"])), cut))
        hit = F.filter(tries, lambda t: t.try_cast("double") == v["c"])[0]
        number = F.split(hit, "e")[0]
        return F.struct(F.regexp_replace(number, "0+$", "").alias("sig"),
                        (F.split(hit, "e")[1].cast("int") + F.length(number) - 1).alias("x"))

    return once(F.struct(whole.alias("d"), size.alias("x"), c.alias("c")), search)


def _python_layout(v: Column) -> Column:
    sig, x = v["sig"], v["x"]
    n, size = F.length(sig), F.abs(x).cast("string")
    positional = (
        F.when(x < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), sig))
        .when(x + 1 >= n, F.concat(sig, F.repeat(F.lit("0"), x + 1 - n), F.lit(".0")))
        .otherwise(F.concat(sig.substr(F.lit(1), x + 1), F.lit("."), sig.substr(x + 2, n))))
    scientific = F.concat(
        sig.substr(F.lit(1), F.lit(1)),
        F.when(n > 1, F.concat(F.lit("."), sig.substr(F.lit(2), n))).otherwise(F.lit("")),
        F.lit("e"), F.when(x < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
    return F.when((x >= -4) & (x < 16), positional).otherwise(scientific)


def _frac(c: Column) -> Column:
    return F.date_format(c, "SSSSSS")


def py_datetime_text(c: Column, with_offset: bool = False) -> Column:
    """``str(datetime)``: ``YYYY-MM-DD HH:MM:SS`` plus ``.ffffff`` only when micros != 0."""
    base = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = F.concat(base, F.when(_frac(c) != "000000", F.concat(F.lit("."), _frac(c))).otherwise(F.lit("")))
    if with_offset:
        out = F.concat(out, F.date_format(c, "xxx"))
    return out


def _time_or_text(c: Column, pattern: str) -> Column:
    """Python's text of a datetime; a value that is text already is passed through as it is."""
    t = c.try_cast("timestamp_ntz")
    out = F.concat(F.date_format(t, pattern), F.when(_frac(t) != "000000", F.concat(F.lit("."), _frac(t))).otherwise(F.lit("")))
    return F.when(F.typeof(c) == "string", c.cast("string")).otherwise(out)


def py_isoformat(c: Column) -> Column:
    """``datetime.isoformat()``: like ``str()`` but with a ``T`` separator; text passes through."""
    return _time_or_text(c, "yyyy-MM-dd'T'HH:mm:ss")


def py_str_of_time(c: Column) -> Column:
    """``str()`` of a datetime; text passes through."""
    return _time_or_text(c, "yyyy-MM-dd HH:mm:ss")


def text_of(c: Column, dtype: T.DataType) -> Column:
    """Python ``str(value)`` of a column value (null stays null)."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return py_float_text(c.cast("double"))
    if isinstance(dtype, T.TimestampNTZType):
        return py_datetime_text(c)
    if isinstance(dtype, T.TimestampType):
        return py_datetime_text(c, with_offset=True)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        # documented difference: JSON text, not Python's dict/list repr
        return F.to_json(c)
    return c.cast("string")


# ---------------------------------------------------------------------------
# Python float() parity
# ---------------------------------------------------------------------------

# A string Python's float() accepts (after strip): decimal with optional
# single underscores between digits and an exponent, or inf/infinity/nan.
_DEC = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def py_float_of_string(s: Column) -> Column:
    t = F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))
    neg = t.startswith("-")
    special = (F.when(F.lower(t).contains("nan"), F.lit(float("nan")))
               .when(neg, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return (F.when(t.rlike(_DEC), F.regexp_replace(t, "_", "").try_cast("double"))
            .when(t.rlike(_SPECIAL), special))


def float_of(c: Column, dtype: T.DataType) -> Column | None:
    """``float(value)`` as a double column; None when Python would raise TypeError."""
    if isinstance(dtype, T.StringType):
        return py_float_of_string(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return None


def python_float(v: Any) -> float | None:
    """Driver-side ``float(v)``; None when Python raises."""
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def canonical_float(s: str) -> float | None:
    """The double whose Python ``str()`` is exactly ``s`` (else None)."""
    try:
        d = float(s)
    except (TypeError, ValueError):
        return None
    return d if repr(d) == s else None


_INT_TEXT = re.compile(r"-?(0|[1-9][0-9]*)\Z")


def canonical_int(s: str) -> int | None:
    """The int whose Python ``str()`` is exactly ``s`` (else None)."""
    if _INT_TEXT.match(s) and s != "-0":
        return int(s)
    return None


def double_equals(c: Column, d: float) -> Column:
    """``c`` holds exactly the double ``d`` with the same Python text (NaN and -0.0 aware)."""
    if math.isnan(d):
        return F.isnan(c)
    if d == 0.0:
        zero_text = "-0.0" if math.copysign(1.0, d) < 0 else "0.0"
        return (c == F.lit(0.0)) & (c.cast("string") == F.lit(zero_text))
    return c == F.lit(d)
