"""SQL-text helpers: literals and identifiers for expressions passed to ``F.expr``.

Building a large rule set through the Column API costs one JVM round trip per node;
rendering each rule as one SQL expression costs one. The text is parsed by Spark's own
SQL parser, so the resulting plan is identical.
"""

from __future__ import annotations

import math


def sql_str(v: str | None) -> str:
    """A Spark SQL string literal or NULL.

    Plain text is quoted as is. Text holding a quote, a backslash or a dollar sign is written
    as ``decode(unhex(...), 'UTF-8')``: it means the same whatever the session's
    ``spark.sql.parser.escapedStringLiterals`` setting, and Spark's variable substitution
    (``${env:..}``) finds nothing to replace. Catalyst folds it to a literal.
    """
    if v is None:
        return "CAST(NULL AS STRING)"
    if not set("'\\$") & set(v):
        return "'" + v + "'"
    return f"decode(unhex('{v.encode('utf-8').hex()}'), 'UTF-8')"


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(d: float) -> str:
    if math.isnan(d):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(d):
        return "CAST('Infinity' AS DOUBLE)" if d > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"CAST('{repr(d)}' AS DOUBLE)"
