"""Oracle SQL for the table-driven scan, sinks and streaming queries."""

from __future__ import annotations

from vigilark.plans.oracle import SQL

SQL["rule_scan_table"] = SQL["rule_scan"]
SQL["rule_scan_table_salted"] = SQL["rule_scan"]

from vigilark.plans.oracle import _MF, ECS, MATCHES, UDM_FLAT  # noqa: E402

SQL["export_events_csv"] = (f"{ECS} SELECT event_id, \"timestamp\", event_severity, event_action, event_outcome, "
                            f"destination_port, user_name, message FROM ecs WHERE {_MF}")
SQL["export_udm_json"] = f"{ECS} SELECT {UDM_FLAT} FROM ecs"
SQL["export_matches_csv"] = SQL["match_report"]
SQL["export_matches_json"] = (MATCHES + "SELECT event_id, rule_name, rule_severity, rule_description, event_action, "
                              "source_ip, CAST(CASE rule_id WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) "
                              "AS n_reasons FROM m")
SQL["stream_rule_scan"] = SQL["rule_scan"]
SQL["stream_timeline"] = SQL["timeline"]
SQL["stream_alerts"] = f"""{ECS},
alerts AS (SELECT * FROM (VALUES ('Hourly Nmap', 'nmap_scan', 3), ('Hourly Failed Logins', 'failed_login', 4))
           AS t(name, event_type, threshold)),
counts AS (SELECT date_trunc('hour', "timestamp") AS window_start, event_action, count(*) AS n FROM ecs
           WHERE event_action IN ('nmap_scan', 'failed_login') GROUP BY 1, 2)
SELECT c.window_start, a.name, a.event_type, CAST(a.threshold AS INTEGER) AS threshold, c.n,
       c.n >= a.threshold AS triggered
FROM counts c JOIN alerts a ON c.event_action = a.event_type
"""

from vigilark.plans.oracle import FLAGSHIP, PRIVILEGED, _matches  # noqa: E402

_SIX = f"{ECS}, m AS ({_matches(FLAGSHIP + [PRIVILEGED + ([],)], 'event_id')})\n"
SQL["rules_from_files"] = _SIX + "SELECT event_id, rule_name, rule_severity FROM m"
SQL["rules_merge"] = _SIX + "SELECT event_id, rule_name, rule_severity FROM m"
SQL["rules_export_roundtrip"] = MATCHES + "SELECT event_id, rule_name, rule_severity FROM m"

SQL["match_summary_from_table"] = SQL["match_severity_summary"]

SQL["rules_validate"] = f"""{ECS},
kinds AS (SELECT DISTINCT source_ip, event_action, event_severity, destination_port FROM ecs)
SELECT concat_ws('/', source_ip, event_action, event_severity, CAST(destination_port AS VARCHAR)) AS path,
       CASE WHEN event_action = 'port_scan' THEN ''
            ELSE coalesce(source_ip || ' ' || event_action, 'Unnamed Rule') END AS name,
       CASE WHEN event_action = 'failed_login' THEN 'urgent' ELSE coalesce(event_severity, 'medium') END AS severity,
       coalesce(event_action <> 'port_scan' AND source_ip IS NOT NULL AND event_action <> 'failed_login'
                AND destination_port <> 80, false) AS valid,
       concat_ws('; ',
         CASE WHEN event_action = 'port_scan' OR source_ip IS NULL OR event_action IS NULL
              THEN 'Rule must have a ''name'' field' END,
         CASE WHEN destination_port IS NULL
              THEN 'Rule must have ''conditions'' field with at least one condition' END,
         CASE WHEN event_action = 'failed_login' THEN 'Severity must be one of: low, medium, high, critical' END,
         CASE WHEN destination_port = 80 THEN 'Invalid field name: ' END) AS errors,
       CASE WHEN destination_port = 443 THEN 'Only the first operator counts: event.action' ELSE '' END AS warnings
FROM kinds
"""
