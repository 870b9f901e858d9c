"""Event sources.

``read_table`` reads one of the given Parquet tables with its declared schema (no
inference, so Parquet column pruning and filter pushdown apply). ``raw_security_records``
is the adapter from the driver ``events`` table to raw security records (action,
severity, own outcome, source IP, port, user); ``security_events`` then runs the ECS
normalisation, the hour column and (optionally) the nested UDM record.
All steps are narrow projections: no shuffle anywhere on this path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators.normalize import ecs_normalize, lookup, with_hour
from vigilark.schema import DRIVER_EVENTS_SCHEMA, ECS_SCHEMA, PORTS, USER_NAMES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread_small_input(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions than task slots (one small file,
    one row group) so CPU-heavy rule evaluation uses every core. Opt-in
    (``spread=True``): it shuffles whole rows and does not keep table order."""
    if df.isStreaming:
        return df
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()          # plans the file splits; runs no job
    except Exception:  # noqa: BLE001 - e.g. no RDD API (Spark Connect): leave the scan as is
        return df
    return df.repartition(slots) if parts < slots else df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    if name == "events":
        df = spark.read.schema(DRIVER_EVENTS_SCHEMA).parquet(table_path(sf_dir, name))
    else:
        df = spark.read.parquet(table_path(sf_dir, name))
    return spread_small_input(df) if spread else df


def read_ecs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already-normalised ECS events (e.g. written by an ingest job) with a fixed schema.

    A table written by ``sinks.write_ecs`` keeps its ``event_date`` partition column (and
    the ``hour`` column when it was stored), so date filters prune partitions."""
    df = spark.read.format(fmt).load(path)
    extra = [c for c in ("hour", "event_date") if c in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType) for f in ECS_SCHEMA.fields], *extra)


# ---------------------------------------------------------------------------
# driver ``events`` -> raw security records
# ---------------------------------------------------------------------------

# Fixed values of the test projection: driver event_type -> security action.
EVENT_TYPE_ACTION = {"click": "file_access", "error": "failed_login", "purchase": "process_creation",
                     "signup": "ssh_login"}
VIEW_SPLIT = 50                      # view: k < 50 -> nmap_scan, else port_scan
SEVERITY_BOUNDS = ((35.0, "low"), (115.0, "medium"), (225.0, "high"))   # else critical


def _pick(index: Column, values: tuple) -> Column:
    return lookup(index, dict(enumerate(values)), F.lit(None))


def raw_security_records(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    et = F.col("event_type")
    action = (F.when(et == "view", F.when(k < VIEW_SPLIT, "nmap_scan").otherwise("port_scan"))
              .otherwise(lookup(et, EVENT_TYPE_ACTION, et)))
    v = F.col("value")
    sev = F.when(v.isNull(), F.lit(None).cast("string"))
    for bound, name in SEVERITY_BOUNDS:
        sev = sev.when(v < bound, name)
    sev = sev.otherwise("critical")
    return events.select(
        F.col("event_id"),
        *[F.col(c) for c in carry],
        F.col("ts").alias("timestamp"),
        action.alias("action"),
        F.when(F.col("event_id") % 2 == 0, "success").otherwise("failure").alias("outcome"),
        sev.alias("severity"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("source_ip"),
        _pick(k % len(PORTS), PORTS).alias("destination_port"),
        _pick(F.col("user_id") % len(USER_NAMES), USER_NAMES).alias("user_name"),
    )


def security_events(spark: SparkSession, sf_dir: str, *, udm: bool = True, hour: bool = True,
                    carry: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """The flat ECS event table derived from ``events`` (+ ``hour`` and nested ``udm``).

    ``carry`` passes raw columns (e.g. ``props``) through next to ``event_id``.
    """
    ecs = ecs_normalize(raw_security_records(read_table(spark, sf_dir, "events", spread), carry),
                        keep=("event_id",) + tuple(carry))
    if hour:
        ecs = with_hour(ecs)
    if udm:
        from vigilark.operators.udm import with_udm
        ecs = with_udm(ecs)
    return ecs
