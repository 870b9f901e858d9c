"""vigilark: security-event detection and analytics as Spark DataFrame plans.

Layout
  sources/    event tables, rule files, sinks (CSV / JSON / rule export)
  functions/  Column builders: Python-text parity, field resolution, UDM pieces, SQL text
  operators/  normalisation, rule compiler + scans, analytics, alerts
  plans/      named queries used by ``__spark_entry__`` and the bench
  streaming/  Structured Streaming versions of the scan, timeline and alerts

Typical use::

    from vigilark import security_events, detect, match_report, timeline
    ev = security_events(spark, "/data/events_dir")
    matches = detect(ev, rules)              # rules: list of dicts / JSON text / Rule objects
    match_report(matches).write.csv(...)
"""

from vigilark.operators.alerts import alert_status, alert_status_for, alerts_frame, alerts_triggered  # noqa: F401
from vigilark.operators.analytics import (action_counts, distinct_options, events_by_hour,  # noqa: F401
                                          events_latest, filter_counts, filter_multi, outcome_counts, overview,
                                          severity_counts, timeline, top_source_ips, top_users)
from vigilark.operators.normalize import ecs_normalize, with_hour  # noqa: F401
from vigilark.operators.rules import Rule, RuleError, sample_rules  # noqa: F401
from vigilark.operators.scan import (first_matches, match_head, match_report, match_severity_summary,  # noqa: F401
                                     rule_explain, rule_test_summary, scan, scan_reasons)
from vigilark.operators.table_scan import detect, scan_table  # noqa: F401
from vigilark.operators.udm import udm_export, udm_of, with_udm  # noqa: F401
from vigilark.session import build_session, materialize, shared_dir  # noqa: F401
from vigilark.sources.events import read_ecs, read_table, security_events  # noqa: F401
from vigilark.sources.rules import (collect_rules, load_rules, merge_rules, read_rule_files,  # noqa: F401
                                    validate_rules, write_rules)
