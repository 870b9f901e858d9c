"""Scale probe: replicate the given events table k times (derived data, unique event ids),
write it once as many Parquet files, and time headline queries as k grows.

Usage: python tools/scale_probe.py SF_DIR OUT_DIR k1 k2 ...
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from vigilark.operators import alerts as AL  # noqa: E402
from vigilark.operators import analytics as AN  # noqa: E402
from vigilark.operators import scan as SC  # noqa: E402
from vigilark.operators.table_scan import scan_table  # noqa: E402
from vigilark.plans import catalog as C  # noqa: E402
from vigilark.plans.bench_rules import generated_rules  # noqa: E402
from vigilark.session import build_session  # noqa: E402
from vigilark.sources.events import read_table, security_events  # noqa: E402


def main():
    sf, out, ks = sys.argv[1], sys.argv[2], [int(k) for k in sys.argv[3:]]
    spark = build_session(8)
    base = read_table(spark, sf, "events", spread=False)
    r50 = generated_rules(50, seed=50)
    res = {}
    for k in ks:
        d = f"{out}/events_x{k}"
        if not os.path.exists(d):
            rep = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c"))
            rep = rep.withColumn("event_id", F.col("event_id") * k + F.col("_c")).drop("_c")
            rep.repartition(16).write.parquet(f"{d}/events.parquet")
        ev = security_events(spark, d)
        n = ev.count()
        qs = {
            "rule_scan_5": lambda: SC.scan(ev, C.flagship_rules()).select("event_id", "rule_id", "rule_name"),
            "rule_scan_50": lambda: SC.scan(ev, r50).select("event_id", "rule_id", "rule_name"),
            "rule_scan_table_50": lambda: scan_table(ev, r50).select("event_id", "rule_id", "rule_name"),
            "timeline": lambda: AN.timeline(ev),
            "overview": lambda: AN.overview(ev),
            "alert_status": lambda: AL.alert_status_for(ev, spark, C.ALERT_RULES),
        }
        row = {"events": n, "input_partitions": ev.rdd.getNumPartitions()}
        for name, q in qs.items():
            best = None
            for _ in range(2):
                t = time.perf_counter()
                q().write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t
                best = dt if best is None else min(best, dt)
            row[name] = round(best, 2)
        res[k] = row
        print(k, json.dumps(row), flush=True)


if __name__ == "__main__":
    main()
