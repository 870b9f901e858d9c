"""Event / UDM / rule / alert schemas and the fixed lookup values.

Flat ECS fields are dotted names (``event.action``). Spark columns cannot carry dots
without back-ticks everywhere, so the event table stores each flat field under its
underscore name (``event_action``); ``@timestamp`` is stored as ``at_timestamp``.
The rule compiler maps dotted rule fields onto these columns (``ecs_column``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for right results.
# ---------------------------------------------------------------------------

# action -> (category, type, kind, fixed outcome or None)
ACTION_LOOKUP = {
    "nmap_scan": ("network", "info", "event", None),
    "ssh_login": ("authentication", "start", "event", None),
    "failed_login": ("authentication", "start", "event", "failure"),
    "port_scan": ("network", "connection", "event", None),
    "file_access": ("file", "access", "event", None),
    "process_creation": ("process", "start", "event", "success"),
}
# unmapped action -> (category, type, kind)
DEFAULT_ACTION_META = ("network", "info", "event")

# action -> UDM event type (case-sensitive); anything else -> GENERIC_EVENT
UDM_EVENT_TYPE = {
    "nmap_scan": "SCAN_NETWORK",
    "ssh_login": "USER_LOGIN",
    "failed_login": "USER_LOGIN",
    "port_scan": "SCAN_PORT",
    "file_access": "FILE_READ",
    "process_creation": "PROCESS_LAUNCH",
}
UDM_GENERIC_EVENT = "GENERIC_EVENT"

# severity (case-insensitive) -> UDM severity; anything else -> INFORMATIONAL
UDM_SEVERITY = {"low": "LOW", "medium": "MEDIUM", "high": "HIGH", "critical": "CRITICAL"}
UDM_SEVERITY_OTHER = "INFORMATIONAL"

# UDM defaults for absent fields
UDM_DEFAULT_SEVERITY = "low"
UDM_DEFAULT_OUTCOME = "UNKNOWN"
UDM_DIRECTION = "OUTBOUND"
UDM_AUTH_LOGIN = "LOGIN"
UDM_AUTH_OTHER = "UNKNOWN"

# rule model
SEVERITIES = ("low", "medium", "high", "critical")
RULE_DEFAULTS = {"name": "Unnamed Rule", "description": "", "severity": "medium", "enabled": True}
# first operator present, in this order, is the only one evaluated
OPERATOR_ORDER = ("contains", "regex", "in", "eq", "ne", "gt", "lt")
REASON_TEMPLATE = "Matched condition on field '{field}': {condition}"

# match report
NOT_AVAILABLE = "N/A"
UNKNOWN_SEVERITY = "unknown"

# value domains used by the sample generators of the reference
PORTS = (22, 80, 443, 3389, 8080)
USER_NAMES = ("admin", "user1", "root", "service_account")

# ---------------------------------------------------------------------------
# Neutral product identifiers (parameters, not reference values).
# ---------------------------------------------------------------------------
PRODUCT_NAME = "Vigilark Security Analytics"
VENDOR_NAME = "Vigilark"
EVENT_DATASET = "vigilark.events"
EVENT_MODULE = "vigilark"
HOST_NAME = "vigilark-host"
AGENT_TYPE = "vigilark-agent"
AGENT_VERSION = "1.0.0"
DESTINATION_IP = "192.168.1.50"


def ecs_column(field: str) -> str:
    """Storage name of a flat ECS field: dots -> underscores, leading @ -> at_."""
    if field.startswith("@"):
        field = "at_" + field[1:]
    return field.replace(".", "_")


# Flat ECS fields in the order the reference builds them.
ECS_FIELDS = (
    "@timestamp", "timestamp",
    "event.kind", "event.category", "event.type", "event.action", "event.outcome", "event.severity",
    "event.dataset", "event.module",
    "source.ip", "source.address",
    "destination.ip", "destination.address", "destination.port",
    "user.name", "message", "host.name", "agent.type", "agent.version",
)

UDM_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("vendor_name", T.StringType()),
        T.StructField("product_event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
    ])),
    T.StructField("principal", T.StructType([
        T.StructField("ip", T.ArrayType(T.StringType())),
        T.StructField("user", T.StructType([T.StructField("userid", T.StringType())])),
    ])),
    T.StructField("target", T.StructType([
        T.StructField("ip", T.ArrayType(T.StringType())),
        T.StructField("port", T.IntegerType()),
    ])),
    T.StructField("network", T.StructType([
        T.StructField("session_id", T.StringType()),
        T.StructField("direction", T.StringType()),
    ])),
    T.StructField("security_result", T.ArrayType(T.StructType([
        T.StructField("action", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]))),
    T.StructField("extensions", T.StructType([
        T.StructField("auth", T.StructType([T.StructField("type", T.StringType())])),
    ])),
])

ECS_SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType())]
    + [T.StructField(ecs_column(f),
                     T.TimestampNTZType() if f == "timestamp"
                     else T.IntegerType() if f == "destination.port" else T.StringType())
       for f in ECS_FIELDS]
)

# raw driver ``events`` table
DRIVER_EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("threshold", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("enabled", T.BooleanType()),
])
