"""Fixed query parameters: the rule sets and alert rules the registered queries run.

These are control inputs (like the text of a query); every query that uses them reads
the given tables, so its work grows with the data.
"""

from __future__ import annotations

from datetime import datetime

from vigilark.operators.rules import PRIVILEGED_PROCESS_RULE, sample_rules


def flagship_rules() -> list[dict]:
    return sample_rules()


def extra_rules() -> list[dict]:
    return [dict(PRIVILEGED_PROCESS_RULE)]


def one_rule(name: str, conditions: dict, **kw) -> list[dict]:
    return [{"name": name, "description": kw.get("description", name), "severity": kw.get("severity", "medium"),
             "enabled": kw.get("enabled", True), "conditions": conditions}]


PREDICATE_RULES = {
    # table, key columns, rule set
    "pred_scalar_eq": ("orders", ("o_orderkey", "o_orderstatus"),
                       one_rule("status_f", {"o_orderstatus": "f"})),
    "pred_contains": ("conversations", ("conv_id", "turn"),
                      one_rule("text_aie", {"text": {"contains": "AIE"}})),
    "pred_regex": ("pages", ("page_id", "url"),
                   one_rule("url_mobile_or_blog", {"url": {"regex": r"^HTTPS://(m|blog)\.[a-z]+\.example\.(com|org)/"}})),
    "pred_in": ("orders", ("o_orderkey", "o_orderpriority"),
                one_rule("urgent_or_high", {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH", "2-high"]}})),
    "pred_eq": ("lineitem", ("l_orderkey", "l_linenumber", "l_returnflag"),
                one_rule("returned", {"l_returnflag": {"eq": "r"}})),
    "pred_ne": ("orders", ("o_orderkey", "o_orderpriority"),
                one_rule("not_low", {"o_orderpriority": {"ne": "5-low"}})),
    "pred_gt": ("lineitem", ("l_orderkey", "l_linenumber", "l_quantity"),
                one_rule("big_quantity", {"l_quantity": {"gt": 45, "lt": 10}})),
    "pred_lt": ("lineitem", ("l_orderkey", "l_linenumber", "l_quantity"),
                one_rule("small_quantity", {"l_quantity": {"lt": "3.5"}})),
    "rule_and": ("lineitem", ("l_orderkey", "l_linenumber", "l_quantity"),
                 one_rule("open_new_big", {"l_returnflag": "n", "l_linestatus": {"eq": "O"},
                                           "l_quantity": {"gt": "40"}})),
}

# Enabled flags follow Python truthiness: the string "false" is enabled, 0 and false are not.
ENABLED_MIX_RULES = [
    {"name": "on_true", "severity": "low", "enabled": True, "conditions": {"event.action": "ssh_login"}},
    {"name": "off_false", "severity": "low", "enabled": False, "conditions": {"event.action": "ssh_login"}},
    {"name": "on_string_false", "severity": "low", "enabled": "false", "conditions": {"event.severity": "HIGH"}},
    {"name": "off_zero", "severity": "low", "enabled": 0, "conditions": {"event.severity": "high"}},
    {"name": "on_default", "severity": "low", "conditions": {"destination.port": 22}},
    {"name": "never_empty", "severity": "low", "conditions": {}},
    {"name": "never_absent_field", "severity": "low", "conditions": {"file.path": {"regex": "^/etc/"}}},
]

NESTED_RULES = [
    {"name": "props_k_above_90", "conditions": {"props.k": {"gt": 90}}},
    {"name": "udm_user_login", "conditions": {"udm.metadata.event_type": "user_login"}},
    {"name": "udm_list_not_walked", "conditions": {"udm.principal.ip.0": {"contains": "10."}}},
]

ALERT_RULES = [
    {"name": "Nmap Scan Detected", "event_type": "nmap_scan", "severity": "medium", "threshold": 5,
     "description": "network sweep", "created_at": datetime(2024, 1, 1, 9, 30), "enabled": True},
    {"name": "SSH Login Burst", "event_type": "ssh_login", "severity": "high", "threshold": 2000,
     "description": "many ssh logins", "created_at": datetime(2024, 1, 1, 9, 31), "enabled": True},
    {"name": "Failed Logins", "event_type": "failed_login", "severity": "low", "threshold": 2100,
     "description": "failed logins", "created_at": datetime(2024, 1, 1, 9, 32), "enabled": False},
    {"name": "File Access Storm", "event_type": "file_access", "severity": "critical", "threshold": 1,
     "description": "any file access", "created_at": datetime(2024, 1, 1, 9, 33), "enabled": True},
    {"name": "Never Seen Action", "event_type": "dns_query", "severity": "low", "threshold": 1,
     "description": "absent action", "created_at": datetime(2024, 1, 1, 9, 34), "enabled": True},
]

# Per-window alert thresholds for the streaming alert query (events per action per hour).
STREAM_ALERT_RULES = [
    {"name": "Hourly Nmap", "event_type": "nmap_scan", "severity": "medium", "threshold": 3},
    {"name": "Hourly Failed Logins", "event_type": "failed_login", "severity": "high", "threshold": 4},
]

MULTI_FILTER = {"severities": ["high", "critical"],
                "actions": ["nmap_scan", "ssh_login", "failed_login", "file_access", "process_creation"],
                "outcomes": ["failure"]}

SELECTED_EVENT_ID = 42
