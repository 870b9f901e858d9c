"""Sinks: event CSV, UDM JSON, match CSV / JSON.

Writers are distributed (one file per partition); CSV cannot hold nested values, so
struct / array / map columns are written as JSON text. JSON output is JSON Lines (one
record per line) rather than one indented array, so that it can be written in parallel
and read back with ``spark.read.json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.fields import quoted
from vigilark.operators.scan import match_report
from vigilark.operators.udm import udm_or_convert


def flat_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# microsecond timestamps, space-separated like a pandas CSV export
# (Spark's CSV default keeps only milliseconds)
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
               "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
               # quotes inside a quoted cell are doubled, as every CSV reader expects
               "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# reading: cells may hold line breaks; a blank unquoted cell is null, "" is an empty text
CSV_READ_OPTIONS = CSV_OPTIONS | {"multiLine": "true", "nullValue": "\x00", "emptyValue": ""}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    flat_for_csv(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ_OPTIONS).csv(path)


def write_events_csv(events: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Filtered events as CSV with a header, in table order (no sort: the export is unsorted)."""
    return write_csv(events, path, mode)


def write_udm_json(events: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One UDM record per line (the row's own ``udm`` when present, else converted)."""
    events.select(udm_or_convert(events).alias("udm")).select("udm.*").write.mode(mode).json(path)
    return path


def write_matches_csv(matches: DataFrame, path: str, mode: str = "overwrite") -> str:
    return write_csv(match_report(matches), path, mode)


def write_matches_json(matches: DataFrame, path: str, event_columns: list[str] | None = None,
                       mode: str = "overwrite") -> str:
    """Full matches: rule fields, reasons and the matched event as a nested record."""
    rule_cols = [c for c in ("rule_id", "rule_name", "rule_description", "rule_severity", "reasons", "scanned_at")
                 if c in matches.columns]
    ev_cols = event_columns or [c for c in matches.columns if c not in rule_cols]
    out = matches.select(
        F.col("rule_name"), F.col("rule_description").alias("description"),
        F.col("rule_severity").alias("severity"), F.col("reasons"),
        F.struct(*[quoted(c) for c in ev_cols]).alias("event"),
        *([F.col("scanned_at").alias("timestamp")] if "scanned_at" in matches.columns else []))
    out.write.mode(mode).json(path)
    return path


def write_ecs(events: DataFrame, path: str, mode: str = "overwrite", by_day: bool = True) -> str:
    """Store normalised events as Parquet, one partition per event day (``event_date``), so
    time-bounded queries read only the days they need (partition pruning). The nested
    ``udm`` record is derived, so it is not stored (rebuild with ``with_udm``)."""
    out = events.drop("udm") if "udm" in events.columns else events
    if by_day:
        out = out.withColumn("event_date", F.to_date(F.col("timestamp")))
        out.write.mode(mode).partitionBy("event_date").parquet(path)
    else:
        out.write.mode(mode).parquet(path)
    return path
