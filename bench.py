"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; best of N, so one-off JIT / code-generation warm-up of a new plan
shape is not counted). Each query is fully executed with the ``noop``
sink (no collect to the driver). Prints one JSON line.

The given tables are one Parquet file of one row group each, so a scan of them is one task. A
large table has many files; the bench therefore writes its input once as BENCH_CPUS files each,
not timed, and reads those (``"input_files"`` in the JSON line says how many).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilark.operators import alerts as AL  # noqa: E402
from vigilark.operators import analytics as AN  # noqa: E402
from vigilark.operators import scan as SC  # noqa: E402
from vigilark.operators.table_scan import scan_table  # noqa: E402
from vigilark.plans import catalog as C  # noqa: E402
from vigilark.plans.bench_rules import generated_rules  # noqa: E402
from vigilark.plans.queries import QUERIES, events, queries  # noqa: E402
from vigilark.session import build_session  # noqa: E402


TABLES = ("events", "orders", "lineitem", "pages", "conversations")


def split_input(spark, sf_dir: str, files: int) -> str:
    """A folder with the tables that the bench reads, each written as ``files`` files."""
    out = tempfile.mkdtemp(prefix="vigilark-bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(cpus, app="vigilark-bench", shuffle_partitions=max(cpus, 8))
    queries()  # register everything
    given, sf_dir = sf_dir, split_input(spark, sf_dir, cpus)

    def ev(**kw):
        return events(spark, sf_dir, **kw)

    def agg_ev(**kw):
        return events(spark, sf_dir, udm=False, **kw)

    def hits(m):
        return m.select("event_id", "rule_id", "rule_name", "rule_severity", "rule_description",
                        "event_action", "source_ip")

    r50, r500 = generated_rules(50, seed=50), generated_rules(500, seed=500)
    bench = {
        "rule_scan_5": lambda: hits(SC.scan(ev(), C.flagship_rules())),
        "rule_scan_50": lambda: hits(SC.scan(ev(), r50)),
        "rule_scan_500": lambda: hits(SC.scan(ev(), r500)),
        "rule_scan_table_5": lambda: hits(scan_table(ev(), C.flagship_rules())),
        "rule_scan_table_50": lambda: hits(scan_table(ev(), r50)),
        "rule_scan_table_500": lambda: hits(scan_table(ev(), r500)),
        "rule_test_summary_50": lambda: SC.rule_test_summary(ev(), r50),
        "ecs_normalize": lambda: ev(udm=False),
        "udm_convert": lambda: QUERIES["udm_convert"](spark, sf_dir),
        "overview": lambda: AN.overview(agg_ev()),
        "timeline": lambda: AN.timeline(agg_ev()),
        "top_source_ips": lambda: AN.top_source_ips(agg_ev()),
        "events_by_hour": lambda: AN.events_by_hour(agg_ev()),
        "alert_status": lambda: AL.alert_status_for(agg_ev(), spark, C.ALERT_RULES),
        "match_report": lambda: SC.match_report(SC.scan(ev(), C.flagship_rules())),
        "rule_explain": lambda: QUERIES["rule_explain"](spark, sf_dir),
        "pred_regex": lambda: QUERIES["pred_regex"](spark, sf_dir),
        "pred_contains": lambda: QUERIES["pred_contains"](spark, sf_dir),
        "stream_rule_scan": lambda: QUERIES["stream_rule_scan"](spark, sf_dir),
    }
    # warm-up (JVM, codegen caches, file listing) - not timed
    SC.scan(ev(), C.flagship_rules()).write.format("noop").mode("overwrite").save()

    times = {}
    for name, build in bench.items():
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat, "input_files": cpus}))


if __name__ == "__main__":
    main()
