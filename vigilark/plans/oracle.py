"""Hand-written DuckDB SQL for every registered query (the correctness oracle).

The predicates are written out directly (not generated by our compiler), so a compiler
bug cannot hide in both sides. Tables are the pre-registered views of the given Parquet
files.
"""

from __future__ import annotations

ECS = """
WITH raw AS (
  SELECT event_id, ts, user_id, event_type AS et, value,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props
  FROM events
), act AS (
  SELECT *, CASE WHEN et = 'view' THEN (CASE WHEN k < 50 THEN 'nmap_scan' ELSE 'port_scan' END)
                 WHEN et = 'click' THEN 'file_access' WHEN et = 'error' THEN 'failed_login'
                 WHEN et = 'purchase' THEN 'process_creation' WHEN et = 'signup' THEN 'ssh_login'
                 ELSE et END AS action
  FROM raw
), ecs AS (
  SELECT event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END AS at_timestamp,
    ts AS "timestamp",
    'event' AS event_kind,
    CASE action WHEN 'nmap_scan' THEN 'network' WHEN 'ssh_login' THEN 'authentication'
      WHEN 'failed_login' THEN 'authentication' WHEN 'port_scan' THEN 'network' WHEN 'file_access' THEN 'file'
      WHEN 'process_creation' THEN 'process' ELSE 'network' END AS event_category,
    CASE action WHEN 'nmap_scan' THEN 'info' WHEN 'ssh_login' THEN 'start' WHEN 'failed_login' THEN 'start'
      WHEN 'port_scan' THEN 'connection' WHEN 'file_access' THEN 'access' WHEN 'process_creation' THEN 'start'
      ELSE 'info' END AS event_type,
    action AS event_action,
    CASE action WHEN 'failed_login' THEN 'failure' WHEN 'process_creation' THEN 'success'
      ELSE (CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failure' END) END AS event_outcome,
    CASE WHEN value IS NULL THEN NULL WHEN value < 35 THEN 'low' WHEN value < 115 THEN 'medium'
      WHEN value < 225 THEN 'high' ELSE 'critical' END AS event_severity,
    'vigilark.events' AS event_dataset,
    'vigilark' AS event_module,
    '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS source_ip,
    '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS source_address,
    '192.168.1.50' AS destination_ip,
    '192.168.1.50' AS destination_address,
    CAST(CASE k % 5 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3389 WHEN 4 THEN 8080 END
         AS INTEGER) AS destination_port,
    CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'user1' WHEN 2 THEN 'root'
      WHEN 3 THEN 'service_account' END AS user_name,
    'Security event detected: ' || action AS message,
    'vigilark-host' AS host_name,
    'vigilark-agent' AS agent_type,
    '1.0.0' AS agent_version,
    CAST(hour(ts) AS INTEGER) AS hour,
    k AS props_k
  FROM act
)
"""

ECS_COLUMNS = ("event_id, at_timestamp, \"timestamp\", event_kind, event_category, event_type, event_action, "
               "event_outcome, event_severity, event_dataset, event_module, source_ip, source_address, "
               "destination_ip, destination_address, destination_port, user_name, message, host_name, "
               "agent_type, agent_version")

UDM_SEV = ("CASE lower(coalesce(event_severity, 'low')) WHEN 'low' THEN 'LOW' WHEN 'medium' THEN 'MEDIUM' "
           "WHEN 'high' THEN 'HIGH' WHEN 'critical' THEN 'CRITICAL' ELSE 'INFORMATIONAL' END")
UDM_TYPE = ("CASE event_action WHEN 'nmap_scan' THEN 'SCAN_NETWORK' WHEN 'ssh_login' THEN 'USER_LOGIN' "
            "WHEN 'failed_login' THEN 'USER_LOGIN' WHEN 'port_scan' THEN 'SCAN_PORT' WHEN 'file_access' "
            "THEN 'FILE_READ' WHEN 'process_creation' THEN 'PROCESS_LAUNCH' ELSE 'GENERIC_EVENT' END")
PY_TS = ("strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(\"timestamp\") % 1000000 <> 0 "
         "THEN '.' || strftime(\"timestamp\", '%f') ELSE '' END")
AUTH = "CASE WHEN lower(coalesce(event_action, '')) LIKE '%login%' THEN 'LOGIN' ELSE 'UNKNOWN' END"
SESSION = f"coalesce(source_ip, '') || '_' || coalesce(destination_ip, '') || '_' || coalesce({PY_TS}, '')"

UDM_FLAT = f"""
  at_timestamp AS udm_event_timestamp,
  {UDM_TYPE} AS udm_event_type,
  'Vigilark Security Analytics' AS udm_product_name,
  'Vigilark' AS udm_vendor_name,
  coalesce(event_action, '') AS udm_product_event_type,
  {UDM_SEV} AS udm_severity,
  coalesce(source_ip, '') AS udm_principal_ip,
  coalesce(user_name, '') AS udm_principal_userid,
  coalesce(destination_ip, '') AS udm_target_ip,
  coalesce(destination_port, 0) AS udm_target_port,
  {SESSION} AS udm_session_id,
  'OUTBOUND' AS udm_direction,
  coalesce(event_outcome, 'UNKNOWN') AS udm_result_action,
  coalesce(message, '') AS udm_result_description,
  {UDM_SEV} AS udm_result_severity,
  {AUTH} AS udm_auth_type
"""

# The five built-in sample rules: (rule_id, name, severity, description, predicate, reasons)
FLAGSHIP = [
    (0, "SSH_Brute_Force_Detection", "high", "A privileged account fails to log in over SSH",
     "event_action IN ('ssh_login', 'failed_login') AND lower(event_outcome) = 'failure' "
     "AND user_name IN ('root', 'admin', 'administrator')",
     ["Matched condition on field 'event.action': {'in': ['ssh_login', 'failed_login']}",
      "Matched condition on field 'event.outcome': failure",
      "Matched condition on field 'user.name': {'in': ['root', 'admin', 'administrator']}"]),
    (1, "Port_Scan_Activity", "medium", "One host probes the ports of another",
     "event_action IN ('port_scan', 'nmap_scan') AND lower(event_category) = 'network'",
     ["Matched condition on field 'event.action': {'in': ['port_scan', 'nmap_scan']}",
      "Matched condition on field 'event.category': network"]),
    (2, "Critical_Event_Alert", "critical", "The sensor itself rates the event critical",
     "lower(event_severity) = 'critical'",
     ["Matched condition on field 'event.severity': critical"]),
    (3, "Failed_Authentication_Multiple_Users", "high", "A login was refused, whoever tried",
     "lower(event_category) = 'authentication' AND lower(event_outcome) = 'failure'",
     ["Matched condition on field 'event.category': authentication",
      "Matched condition on field 'event.outcome': failure"]),
    (4, "Suspicious_File_Access", "medium", "A file was opened or read",
     "lower(event_action) = 'file_access' AND lower(event_category) = 'file'",
     ["Matched condition on field 'event.action': file_access",
      "Matched condition on field 'event.category': file"]),
]
PRIVILEGED = (5, "Privileged_Process_Creation", "medium",
              "A program was started on a host",
              "lower(event_action) = 'process_creation' AND lower(event_category) = 'process' "
              "AND lower(event_type) = 'start'")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(rules=FLAGSHIP, cols="event_id, event_action, source_ip, event_type") -> str:
    parts = [f"SELECT {cols}, {rid} AS rule_id, {_q(name)} AS rule_name, {_q(sev)} AS rule_severity, "
             f"{_q(desc)} AS rule_description FROM ecs WHERE {pred}"
             for rid, name, sev, desc, pred, *_ in rules]
    return "\nUNION ALL\n".join(parts)


MATCHES = f"{ECS}, m AS ({_matches()})\n"

SQL: dict[str, str] = {}

SQL["src_events"] = "SELECT event_id, ts, user_id, event_type, value, props FROM events"

SQL["ecs_normalize"] = f"{ECS} SELECT {ECS_COLUMNS} FROM ecs"

SQL["udm_convert"] = f"{ECS} SELECT event_id, {UDM_FLAT} FROM ecs"
SQL["udm_event_type"] = f"{ECS} SELECT event_id, event_action, {UDM_TYPE} AS udm_event_type FROM ecs"
SQL["udm_severity"] = f"{ECS} SELECT event_id, event_severity, {UDM_SEV} AS udm_severity FROM ecs"
SQL["udm_session_id"] = f"{ECS} SELECT event_id, {SESSION} AS udm_session_id FROM ecs"
SQL["udm_auth_type"] = f"{ECS} SELECT event_id, event_action, {AUTH} AS udm_auth_type FROM ecs"
SQL["udm_export"] = f"{ECS} SELECT event_id, {UDM_FLAT} FROM ecs"
SQL["udm_one_event"] = f"{ECS} SELECT event_id, {UDM_FLAT} FROM ecs WHERE event_id = 42"

SQL["nested_path"] = f"""{ECS}
SELECT event_id, 'props_k_above_90' AS rule_name FROM ecs WHERE props_k > 90
UNION ALL
SELECT event_id, 'udm_user_login' AS rule_name FROM ecs WHERE event_action IN ('ssh_login', 'failed_login')
"""

SQL["pred_scalar_eq"] = ("SELECT o_orderkey, o_orderstatus, 'status_f' AS rule_name FROM orders "
                         "WHERE lower(o_orderstatus) = 'f'")
SQL["pred_contains"] = ("SELECT conv_id, turn, 'text_aie' AS rule_name FROM conversations "
                        "WHERE contains(lower(text), 'aie')")
SQL["pred_regex"] = ("SELECT page_id, url, 'url_mobile_or_blog' AS rule_name FROM pages "
                     r"WHERE regexp_matches(url, '^HTTPS://(m|blog)\.[a-z]+\.example\.(com|org)/', 'i')")
SQL["pred_in"] = ("SELECT o_orderkey, o_orderpriority, 'urgent_or_high' AS rule_name FROM orders "
                  "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '2-high')")
SQL["pred_eq"] = ("SELECT l_orderkey, l_linenumber, l_returnflag, 'returned' AS rule_name FROM lineitem "
                  "WHERE lower(l_returnflag) = 'r'")
SQL["pred_ne"] = ("SELECT o_orderkey, o_orderpriority, 'not_low' AS rule_name FROM orders "
                  "WHERE o_orderpriority IS NOT NULL AND lower(o_orderpriority) <> '5-low'")
SQL["pred_gt"] = ("SELECT l_orderkey, l_linenumber, l_quantity, 'big_quantity' AS rule_name FROM lineitem "
                  "WHERE l_quantity > 45 AND NOT isnan(l_quantity)")
SQL["pred_lt"] = ("SELECT l_orderkey, l_linenumber, l_quantity, 'small_quantity' AS rule_name FROM lineitem "
                  "WHERE l_quantity < 3.5 AND NOT isnan(l_quantity)")
SQL["rule_and"] = ("SELECT l_orderkey, l_linenumber, l_quantity, 'open_new_big' AS rule_name FROM lineitem "
                   "WHERE lower(l_returnflag) = 'n' AND lower(l_linestatus) = 'o' AND l_quantity > 40")

SQL["rules_enabled"] = f"""{ECS}
SELECT event_id, 'on_true' AS rule_name FROM ecs WHERE lower(event_action) = 'ssh_login'
UNION ALL
SELECT event_id, 'on_string_false' AS rule_name FROM ecs WHERE lower(event_severity) = 'high'
UNION ALL
SELECT event_id, 'on_default' AS rule_name FROM ecs WHERE destination_port = 22
"""

SQL["rule_scan"] = (MATCHES + "SELECT event_id, rule_id, rule_name, rule_severity, rule_description, "
                    "event_action, source_ip FROM m")

_REASONS = ", ".join(f"({rid}, {i}, {_q(r)})" for rid, _n, _s, _d, _p, reasons in FLAGSHIP
                     for i, r in enumerate(reasons))
SQL["rule_scan_reasons"] = (MATCHES + f", r AS (SELECT * FROM (VALUES {_REASONS}) AS t(rule_id, reason_index, reason))\n"
                            "SELECT m.event_id, m.rule_id, m.rule_name, r.reason_index, r.reason "
                            "FROM m JOIN r ON m.rule_id = r.rule_id")

_ALL6 = FLAGSHIP + [PRIVILEGED + ([],)]
SQL["rule_test_summary"] = ECS + "\nUNION ALL\n".join(
    f"SELECT {rid} AS rule_id, {_q(name)} AS rule_name, "
    f"CAST(sum(CASE WHEN {pred} THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS total FROM ecs"
    for rid, name, _s, _d, pred, *_ in _ALL6)

SQL["rule_test_sample"] = (f"{ECS}, m AS ({_matches(_ALL6, 'event_id')})\n"
                           "SELECT rule_name, event_id, sample_rank FROM ("
                           "SELECT rule_name, event_id, CAST(row_number() OVER (PARTITION BY rule_id "
                           "ORDER BY event_id) AS INTEGER) AS sample_rank FROM m) WHERE sample_rank <= 5")

SQL["rule_explain"] = f"""{ECS}
SELECT event_id, 0 AS condition_index, 'event.action' AS field,
       {_q("{'in': ['ssh_login', 'failed_login']}")} AS expected, coalesce(event_action, 'None') AS found,
       coalesce(event_action IN ('ssh_login', 'failed_login'), false) AS matched FROM ecs
UNION ALL
SELECT event_id, 1, 'event.outcome', 'failure', coalesce(event_outcome, 'None'),
       coalesce(lower(event_outcome) = 'failure', false) FROM ecs
UNION ALL
SELECT event_id, 2, 'user.name', {_q("{'in': ['root', 'admin', 'administrator']}")},
       coalesce(user_name, 'None'), coalesce(user_name IN ('root', 'admin', 'administrator'), false) FROM ecs
"""

SQL["match_report"] = (MATCHES + "SELECT rule_name AS \"Rule\", rule_severity AS \"Severity\", "
                       "rule_description AS \"Description\", coalesce(event_action, 'N/A') AS \"Event Type\", "
                       "coalesce(source_ip, 'N/A') AS \"Source IP\" FROM m")
SQL["match_severity_summary"] = (MATCHES + "SELECT coalesce(rule_severity, 'unknown') AS severity, count(*) AS n "
                                 "FROM m GROUP BY 1")
SQL["match_severity_buckets"] = (MATCHES + "SELECT " + ", ".join(
    f"CAST(count(*) FILTER (WHERE rule_severity = '{s}') AS BIGINT) AS {s}"
    for s in ("critical", "high", "medium", "low")) + " FROM m")

SQL["rule_stats"] = f"""{ECS}, m AS (
  {_matches(FLAGSHIP, 'event_id')}
  UNION ALL SELECT event_id, 10, 'on_true', 'low', '' FROM ecs WHERE lower(event_action) = 'ssh_login'
  UNION ALL SELECT event_id, 12, 'on_string_false', 'low', '' FROM ecs WHERE lower(event_severity) = 'high'
  UNION ALL SELECT event_id, 14, 'on_default', 'low', '' FROM ecs WHERE destination_port = 22
)
SELECT 12 AS total_rules, 10 AS enabled_rules, count(*) AS total_matches FROM m
"""

SQL["match_head"] = MATCHES + "SELECT event_id, rule_id, rule_name FROM m ORDER BY event_id, rule_id LIMIT 10"

SQL["events_append"] = (f"{ECS}, m AS ({_matches(FLAGSHIP, 'event_id')}), "
                        f"p AS ({_matches([PRIVILEGED + ([],)], 'event_id, event_type')})\n"
                        "SELECT event_id, rule_name, rule_severity, CAST(NULL AS VARCHAR) AS event_type FROM m "
                        "UNION ALL SELECT event_id, rule_name, CAST(NULL AS VARCHAR), event_type FROM p")

SQL["overview"] = f"""{ECS}
SELECT count(*) AS total_events,
       count(*) FILTER (WHERE event_severity = 'critical') AS critical_events,
       count(DISTINCT source_ip) AS unique_source_ips,
       count(*) FILTER (WHERE event_outcome = 'failure') AS failed_events
FROM ecs"""

SQL["timeline"] = (f"{ECS} SELECT date_trunc('hour', \"timestamp\") AS hour_start, event_severity AS severity, "
                   "count(*) AS n FROM ecs WHERE \"timestamp\" IS NOT NULL AND event_severity IS NOT NULL "
                   "GROUP BY 1, 2")


def _vc(col: str, name: str | None = None, k: int | None = None) -> str:
    name = name or col
    lim = f" LIMIT {k}" if k else ""
    return (f"{ECS} SELECT {col} AS {name}, count(*) AS n FROM ecs WHERE {col} IS NOT NULL "
            f"GROUP BY 1 ORDER BY n DESC, {name} ASC{lim}")


SQL["action_counts"] = _vc("event_action")
SQL["severity_counts"] = _vc("event_severity")
SQL["outcome_counts"] = _vc("event_outcome")
SQL["top_source_ips"] = _vc("source_ip", k=10)
SQL["top_users"] = _vc("user_name", k=5)
SQL["events_by_hour"] = (f"{ECS} SELECT hour, count(*) AS n FROM ecs WHERE \"timestamp\" IS NOT NULL "
                         "GROUP BY 1 ORDER BY 1")
SQL["distinct_options"] = (f"{ECS} SELECT 'severity' AS field, event_severity AS value FROM ecs "
                           "UNION SELECT 'action', event_action FROM ecs UNION SELECT 'outcome', event_outcome FROM ecs")

_MF = ("event_severity IN ('high', 'critical') AND event_action IN ('nmap_scan', 'ssh_login', 'failed_login', "
       "'file_access', 'process_creation') AND event_outcome IN ('failure')")
SQL["filter_multi"] = (f"{ECS} SELECT event_id, event_severity, event_action, event_outcome FROM ecs "
                       f"WHERE {_MF}")
SQL["filter_counts"] = (f"{ECS} SELECT count(*) FILTER (WHERE {_MF}) AS shown, count(*) AS total FROM ecs")
SQL["events_latest"] = (f"{ECS} SELECT event_id, \"timestamp\", event_action, event_severity FROM ecs "
                        "ORDER BY \"timestamp\" DESC NULLS LAST, event_id")

ALERTS = """alerts AS (SELECT * FROM (VALUES
  ('Nmap Scan Detected', 'nmap_scan', 'medium', 5),
  ('SSH Login Burst', 'ssh_login', 'high', 2000),
  ('Failed Logins', 'failed_login', 'low', 2100),
  ('File Access Storm', 'file_access', 'critical', 1),
  ('Never Seen Action', 'dns_query', 'low', 1)) AS t(name, event_type, severity, threshold))"""
ALERT_STATUS = f"""{ECS}, {ALERTS},
counts AS (SELECT event_action, count(*) AS n FROM ecs GROUP BY 1),
st AS (SELECT a.name, a.event_type, a.severity, CAST(a.threshold AS INTEGER) AS threshold,
              coalesce(c.n, 0) AS n, coalesce(c.n, 0) >= a.threshold AS triggered
       FROM alerts a LEFT JOIN counts c ON a.event_type = c.event_action)
"""
SQL["alert_status"] = ALERT_STATUS + "SELECT * FROM st"
SQL["alerts_triggered"] = (ALERT_STATUS + "SELECT count(*) AS total_rules, "
                           "count(*) FILTER (WHERE triggered) AS triggered FROM st")


def oracle_sql() -> dict[str, str]:
    from vigilark.plans import oracle_more  # noqa: F401  (registers the remaining entries)
    return dict(SQL)
