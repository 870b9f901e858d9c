"""Session helpers.

The library never sets cluster-wide knobs on an existing session; ``build_session``
is for tests, the bench and local use. Lineage cuts and sink round-trips go to the
shared folder named by ``spark.checkpoint.dir`` (read from the session). Only when
that setting is absent *and* the master is local do we create one under /tmp.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "vigilark", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/DBFS)")
    root = tempfile.mkdtemp(prefix="vigilark-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one written table / sink."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, partition_by: tuple[str, ...] = ()):
    """Write ``df`` as Parquet to a fresh folder under the shared checkpoint root and read it
    back: cuts lineage, survives executor loss, and lets several reports reuse one scan.
    ``partition_by`` lays the table out for partition pruning (e.g. by rule severity)."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
