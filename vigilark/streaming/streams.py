"""Structured Streaming versions of the scan, the timeline and the threshold alerts.

The event source is the same projection chain as in batch (ECS normalisation, hour,
UDM) applied to a streaming read, so every stateless operator is shared.

* ``stream_scan``: the compiled rule scan is stateless -> append mode to any file sink.
* ``stream_timeline`` / ``stream_alert_counts``: event-time tumbling windows with a
  watermark. ``append`` emits a window once the watermark passes its end (late rows
  beyond the watermark are dropped, state is purged); ``complete`` re-emits the whole
  (small: windows x severities) table every trigger.
* Sinks write through ``foreachBatch`` to Parquet so no result passes through the driver;
  checkpoints (offsets + state store) live under the shared checkpoint folder, so a
  restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators.normalize import ecs_normalize, with_hour
from vigilark.operators.scan import scan
from vigilark.operators.udm import with_udm
from vigilark.schema import DRIVER_EVENTS_SCHEMA
from vigilark.session import shared_dir
from vigilark.sources.events import raw_security_records, table_path


def read_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                      udm: bool = True) -> DataFrame:
    """Streaming ECS events from the ``events`` Parquet table of a folder: a directory of part
    files, or one file. Only that table is read, as in batch."""
    reader = spark.readStream.schema(DRIVER_EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # as a glob (of one name): a plain path would be taken for a partition root, which a file is not
    raw = reader.parquet(table_path(sf_dir, "event[s]"))
    ev = with_hour(ecs_normalize(raw_security_records(raw)))
    return with_udm(ev) if udm else ev


def event_time(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ). The NTZ wall clock is read as UTC:
    ``run_to_parquet`` starts every query with the session time zone pinned to UTC (the
    running query keeps its own copy of the session settings)."""
    return events.withColumn("_event_time", F.col(ts).cast("timestamp"))


def stream_scan(events: DataFrame, rules: Any) -> DataFrame:
    return scan(events, rules)


def stream_timeline(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    ev = event_time(events).withWatermark("_event_time", watermark)
    return (ev.filter(F.col("event_severity").isNotNull())
            .groupBy(F.window("_event_time", window).alias("w"), F.col("event_severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "severity", "n"))


def stream_alert_counts(events: DataFrame, actions: list[str], watermark: str = "1 hour",
                        window: str = "1 hour") -> DataFrame:
    """Events per (tumbling window, watched action). Spark evaluates the action filter
    below the watermark, so the watermark follows the latest *watched* event."""
    ev = event_time(events).withWatermark("_event_time", watermark)
    return (ev.filter(F.col("event_action").isin(sorted(set(actions))))
            .groupBy(F.window("_event_time", window).alias("w"), F.col("event_action"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_action", "n"))


BROADCAST_ALERTS = 100_000


def alert_windows(counts: DataFrame, alerts: DataFrame, n_alerts: int | None = None) -> DataFrame:
    """Per (window, alert rule): events of the watched action and whether it fired.

    The alert table is broadcast only when its row count is known to be small."""
    small = F.broadcast(alerts) if n_alerts is not None and n_alerts <= BROADCAST_ALERTS else alerts
    j = counts.join(small, counts["event_action"] == alerts["event_type"])
    return j.select("window_start", "name", "event_type", "threshold", "n",
                    (F.col("n") >= F.col("threshold")).alias("triggered"))


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append", transform=None,
                   path: str | None = None, checkpoint: str | None = None,
                   state_partitions: int | None = None) -> str:
    """Run a streaming query over all available input (``availableNow``) into Parquet.

    * ``append`` without ``transform``: Spark's file sink, exactly-once through its
      ``_spark_metadata`` log (readers see only committed files).
    * ``complete``: every trigger overwrites the table with the full result (idempotent).
    * ``append`` with ``transform`` (batch DataFrame -> DataFrame, e.g. a join with a static
      table): each micro-batch overwrites its own ``epoch=<id>`` folder, so a replayed batch
      replaces its earlier output instead of duplicating it.

    ``state_partitions`` fixes the number of state-store partitions of a stateful query
    when it is first started (it cannot change for the life of the checkpoint). Windowed
    counts keep tiny state (windows x keys, independent of data volume; partial
    aggregation runs before the shuffle), so a small number suits them at any scale.
    """
    spark = stream.sparkSession
    out = path or shared_dir(spark, f"stream-{name}")
    ckpt = checkpoint or shared_dir(spark, f"stream-{name}-ckpt")

    def sink(batch: DataFrame, epoch: int) -> None:
        df = transform(batch) if transform else batch
        if mode == "complete":
            df.write.mode("overwrite").parquet(out)
        else:
            df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append" and transform is None:
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(sink)
    pinned = {"spark.sql.session.timeZone": "UTC"}
    if state_partitions:
        pinned["spark.sql.shuffle.partitions"] = str(state_partitions)
    previous = {k: spark.conf.get(k) for k in pinned}
    for k, v in pinned.items():
        spark.conf.set(k, v)
    try:
        q = writer.start()
    finally:
        for k, v in previous.items():
            spark.conf.set(k, v)
    q.awaitTermination()
    return out
