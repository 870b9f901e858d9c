"""Streaming: append-mode windows with a watermark, and exactly-once resume from a checkpoint."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigilark.operators import analytics as AN
from vigilark.operators import scan as SC
from vigilark.operators.rules import sample_rules
from vigilark.session import shared_dir
from vigilark.sources.events import read_table, security_events
from vigilark.streaming import streams as S


def _halves(spark):
    """Two event sets derived from the given table: first and second half by event_id."""
    ev = read_table(spark, SF_SMALL, "events", spread=False)
    mid = ev.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    return ev.filter(F.col("event_id") <= mid), ev.filter(F.col("event_id") > mid)


def test_append_timeline_emits_closed_windows(spark):
    ev_stream = S.read_event_stream(spark, SF_SMALL, udm=False)
    out = S.run_to_parquet(S.stream_timeline(ev_stream, watermark="1 hour"), "t-append", mode="append")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("hour_start", "severity", "n").collect())
    batch = AN.timeline(security_events(spark, SF_SMALL, udm=False))
    max_ts = security_events(spark, SF_SMALL, udm=False).agg(F.max("timestamp")).first()[0]
    import datetime as dt
    closed = max_ts - dt.timedelta(hours=1)          # watermark after the last batch
    want = sorted(tuple(r) for r in batch.collect() if r.hour_start + dt.timedelta(hours=1) <= closed)
    assert got == want and len(got) > 0


def test_stream_scan_resumes_exactly_once(spark):
    src = shared_dir(spark, "stream-src")
    first, second = _halves(spark)
    first.coalesce(1).write.parquet(f"{src}/part_a")
    out = shared_dir(spark, "stream-out")
    ckpt = shared_dir(spark, "stream-ckpt")

    def run(folder_glob):
        raw = (spark.readStream.schema(read_table(spark, SF_SMALL, "events", spread=False).schema)
               .option("recursiveFileLookup", True).parquet(folder_glob))
        from vigilark.operators.normalize import ecs_normalize, with_hour
        from vigilark.sources.events import raw_security_records
        ev = with_hour(ecs_normalize(raw_security_records(raw)))
        m = SC.scan(ev, sample_rules()).select("event_id", "rule_id")
        S.run_to_parquet(m, "resume", mode="append", path=out, checkpoint=ckpt)

    run(src)                                   # first file only
    second.coalesce(1).write.parquet(f"{src}/part_b")
    run(src)                                   # restart on the same checkpoint: only the new file
    run(src)                                   # and again: nothing new
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    ev = security_events(spark, SF_SMALL, udm=False, spread=False)
    want = sorted(tuple(r) for r in SC.scan(ev, sample_rules()).select("event_id", "rule_id").collect())
    assert got == want


def test_late_rows_beyond_watermark_are_dropped(spark):
    import datetime as dt
    from vigilark.operators.normalize import ecs_normalize, with_hour
    from vigilark.sources.events import raw_security_records
    src = shared_dir(spark, "late-src")
    raw = read_table(spark, SF_SMALL, "events", spread=False)
    cut = dt.datetime(2024, 1, 15)
    recent = raw.filter(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"))
    old = raw.filter(F.col("ts") < F.lit(cut - dt.timedelta(days=2)).cast("timestamp_ntz"))
    out, ckpt = shared_dir(spark, "late-out"), shared_dir(spark, "late-ckpt")

    def run():
        stream = spark.readStream.schema(raw.schema).option("recursiveFileLookup", True).parquet(src)
        ev = with_hour(ecs_normalize(raw_security_records(stream)))
        S.run_to_parquet(S.stream_timeline(ev, watermark="1 hour"), "late", mode="append", path=out,
                         checkpoint=ckpt)

    recent.coalesce(1).write.parquet(f"{src}/a_recent")
    run()                                               # watermark advances to max(ts) - 1 hour
    old.coalesce(1).write.parquet(f"{src}/b_old")
    run()                                               # the old rows arrive late: dropped
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("hour_start", "severity", "n").collect())
    batch_recent = AN.timeline(ecs_normalize(raw_security_records(recent)))
    max_ts = recent.agg(F.max("ts")).first()[0]
    closed = max_ts - dt.timedelta(hours=1)
    want = sorted(tuple(r) for r in batch_recent.collect() if r.hour_start + dt.timedelta(hours=1) <= closed)
    assert got == want and len(got) > 0                  # nothing from the late (old) file


def test_append_alert_windows(spark):
    import datetime as dt
    from vigilark.operators.alerts import alerts_frame
    rules = [{"name": "Hourly Nmap", "event_type": "nmap_scan", "severity": "medium", "threshold": 3}]
    ev_stream = S.read_event_stream(spark, SF_SMALL, udm=False)
    counts = S.stream_alert_counts(ev_stream, ["nmap_scan"], watermark="1 hour")
    alerts = alerts_frame(spark, rules)
    out = S.run_to_parquet(counts, "alerts-append", mode="append",
                           transform=lambda b: S.alert_windows(b, alerts, 1))
    got = sorted((r.window_start, r.n, r.triggered) for r in spark.read.parquet(out).collect())
    ev = security_events(spark, SF_SMALL, udm=False)
    # Spark pushes the action filter below the watermark node: the watermark follows the
    # latest watched event, not the latest event overall
    max_ts = ev.filter(F.col("event_action") == "nmap_scan").agg(F.max("timestamp")).first()[0]
    closed = max_ts - dt.timedelta(hours=1)
    batch = (ev.filter(F.col("event_action") == "nmap_scan")
             .groupBy(AN.hour_bucket(F.col("timestamp")).alias("w")).count().collect())
    want = sorted((r.w, r["count"], r["count"] >= 3) for r in batch if r.w + dt.timedelta(hours=1) <= closed)
    assert got == want and len(got) > 0
