"""Column builders for the unified data model (UDM) record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilark.functions.pytext import py_isoformat, py_str_of_time
from vigilark.schema import (UDM_AUTH_LOGIN, UDM_AUTH_OTHER, UDM_DEFAULT_OUTCOME, UDM_DEFAULT_SEVERITY,
                             UDM_EVENT_TYPE, UDM_GENERIC_EVENT, UDM_SEVERITY, UDM_SEVERITY_OTHER)


def _case(c: Column, table: dict, default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def udm_event_type(action: Column) -> Column:
    """Action -> UDM event type; case-sensitive; absent or unknown -> GENERIC_EVENT."""
    return _case(action, UDM_EVENT_TYPE, UDM_GENERIC_EVENT)


def udm_severity(severity: Column) -> Column:
    """Severity -> UDM severity; case-insensitive; absent counts as 'low'; unknown -> INFORMATIONAL."""
    s = F.lower(F.coalesce(severity, F.lit(UDM_DEFAULT_SEVERITY)))
    return _case(s, UDM_SEVERITY, UDM_SEVERITY_OTHER)


def udm_session_id(src_ip: Column, dst_ip: Column, ts: Column) -> Column:
    """``{src}_{dst}_{str(timestamp)}`` (space-separated timestamp text, unlike ISO)."""
    return F.concat_ws("_", F.coalesce(src_ip, F.lit("")), F.coalesce(dst_ip, F.lit("")),
                       F.coalesce(py_str_of_time(ts), F.lit("")))


def udm_auth_type(action: Column) -> Column:
    return (F.when(F.lower(F.coalesce(action, F.lit(""))).contains("login"), F.lit(UDM_AUTH_LOGIN))
            .otherwise(F.lit(UDM_AUTH_OTHER)))


def udm_record(*, timestamp: Column, action: Column, severity: Column, source_ip: Column, user_name: Column,
               destination_ip: Column, destination_port: Column, outcome: Column, message: Column,
               product_name: str, vendor_name: str) -> Column:
    sev = udm_severity(severity)
    return F.struct(
        F.struct(
            py_isoformat(timestamp).alias("event_timestamp"),
            udm_event_type(action).alias("event_type"),
            F.lit(product_name).alias("product_name"),
            F.lit(vendor_name).alias("vendor_name"),
            F.coalesce(action, F.lit("")).alias("product_event_type"),
            sev.alias("severity"),
        ).alias("metadata"),
        F.struct(
            F.array(F.coalesce(source_ip, F.lit(""))).alias("ip"),
            F.struct(F.coalesce(user_name, F.lit("")).alias("userid")).alias("user"),
        ).alias("principal"),
        F.struct(
            F.array(F.coalesce(destination_ip, F.lit(""))).alias("ip"),
            F.coalesce(destination_port.cast("int"), F.lit(0)).alias("port"),
        ).alias("target"),
        F.struct(
            udm_session_id(source_ip, destination_ip, timestamp).alias("session_id"),
            F.lit("OUTBOUND").alias("direction"),
        ).alias("network"),
        F.array(F.struct(
            F.coalesce(outcome, F.lit(UDM_DEFAULT_OUTCOME)).alias("action"),
            F.coalesce(message, F.lit("")).alias("description"),
            sev.alias("severity"),
        )).alias("security_result"),
        F.struct(F.struct(udm_auth_type(action).alias("type")).alias("auth")).alias("extensions"),
    )
