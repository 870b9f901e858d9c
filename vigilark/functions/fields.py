"""Field-path resolution against a DataFrame schema (driver side, no data touched).

A rule names a field as ``event.action`` or ``udm.metadata.event_type``. Lookup order:
  1. a top-level column with exactly that name (case-sensitive, dots allowed);
  2. the flat ECS storage name (``event_action``; ``@timestamp`` -> ``at_timestamp``);
  3. a walk through nested structs / string-keyed maps, one dot-separated key at a time.
A flat hit never falls through to the walk (even when its value is null), and lists
are never walked. An unresolved field yields None: the condition is False for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.sqltext import sql_ident, sql_str
from vigilark.schema import ecs_column


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _top(schema: T.StructType, name: str) -> T.StructField | None:
    for f in schema.fields:
        if f.name == name:
            return f
    return None


def resolve(schema: T.StructType, field: str) -> tuple[Column, T.DataType] | None:
    hit = _top(schema, field)
    if hit is not None:
        return quoted(hit.name), hit.dataType
    alias = ecs_column(field)
    if alias != field:
        hit = _top(schema, alias)
        if hit is not None:
            return quoted(hit.name), hit.dataType
    parts = field.split(".")
    if len(parts) < 2:
        return None
    root = _top(schema, parts[0])
    if root is None:
        return None
    col, dtype = quoted(root.name), root.dataType
    for key in parts[1:]:
        if isinstance(dtype, T.StructType):
            sub = _top(dtype, key)
            if sub is None:
                return None
            col, dtype = col.getField(sub.name), sub.dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            col, dtype = F.try_element_at(col, F.lit(key)), dtype.valueType
        else:
            return None
    return col, dtype


def resolve_sql(schema: T.StructType, field: str) -> tuple[str, T.DataType] | None:
    """Same lookup as ``resolve``, as SQL text (for one-call ``F.expr`` predicates)."""
    hit = _top(schema, field)
    if hit is not None:
        return sql_ident(hit.name), hit.dataType
    alias = ecs_column(field)
    if alias != field:
        hit = _top(schema, alias)
        if hit is not None:
            return sql_ident(hit.name), hit.dataType
    parts = field.split(".")
    if len(parts) < 2:
        return None
    root = _top(schema, parts[0])
    if root is None:
        return None
    ref, dtype = sql_ident(root.name), root.dataType
    for key in parts[1:]:
        if isinstance(dtype, T.StructType):
            sub = _top(dtype, key)
            if sub is None:
                return None
            ref, dtype = f"{ref}.{sql_ident(sub.name)}", sub.dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            ref, dtype = f"try_element_at({ref}, {sql_str(key)})", dtype.valueType
        else:
            return None
    return ref, dtype
