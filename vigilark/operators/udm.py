"""UDM conversion over event tables (narrow projections, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.fields import quoted
from vigilark.functions.udm import udm_record
from vigilark.schema import PRODUCT_NAME, VENDOR_NAME


def _c(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return quoted(name) if name in df.columns else F.lit(None).cast(dtype)


def udm_of(events: DataFrame, product_name: str = PRODUCT_NAME, vendor_name: str = VENDOR_NAME) -> Column:
    """The UDM record built from the flat ECS columns of ``events`` (absent columns -> defaults)."""
    return udm_record(
        timestamp=_c(events, "timestamp", "timestamp_ntz"),
        action=_c(events, "event_action"),
        severity=_c(events, "event_severity"),
        source_ip=_c(events, "source_ip"),
        user_name=_c(events, "user_name"),
        destination_ip=_c(events, "destination_ip"),
        destination_port=_c(events, "destination_port", "int"),
        outcome=_c(events, "event_outcome"),
        message=_c(events, "message"),
        product_name=product_name, vendor_name=vendor_name)


def with_udm(events: DataFrame, **kw) -> DataFrame:
    return events.withColumn("udm", udm_of(events, **kw))


def udm_or_convert(events: DataFrame, **kw) -> Column:
    """The row's own ``udm`` when present, else a fresh conversion."""
    fresh = udm_of(events, **kw)
    if "udm" in events.columns:
        return F.coalesce(F.col("udm"), fresh)
    return fresh


def udm_export(events: DataFrame, keep: tuple[str, ...] = ("event_id",), **kw) -> DataFrame:
    return events.select(*keep, udm_or_convert(events, **kw).alias("udm"))


def udm_flat(udm: Column) -> list[Column]:
    """The UDM struct as flat scalar columns (for tabular output and comparisons)."""
    m, p, t, n = udm["metadata"], udm["principal"], udm["target"], udm["network"]
    sr = udm["security_result"].getItem(0)
    return [
        m["event_timestamp"].alias("udm_event_timestamp"),
        m["event_type"].alias("udm_event_type"),
        m["product_name"].alias("udm_product_name"),
        m["vendor_name"].alias("udm_vendor_name"),
        m["product_event_type"].alias("udm_product_event_type"),
        m["severity"].alias("udm_severity"),
        p["ip"].getItem(0).alias("udm_principal_ip"),
        p["user"]["userid"].alias("udm_principal_userid"),
        t["ip"].getItem(0).alias("udm_target_ip"),
        t["port"].alias("udm_target_port"),
        n["session_id"].alias("udm_session_id"),
        n["direction"].alias("udm_direction"),
        sr["action"].alias("udm_result_action"),
        sr["description"].alias("udm_result_description"),
        sr["severity"].alias("udm_result_severity"),
        udm["extensions"]["auth"]["type"].alias("udm_auth_type"),
    ]


def udm_one_event(events: DataFrame, event_id: int, key: str = "event_id", **kw) -> DataFrame:
    """One selected event shown as UDM (selection by key; filter pushed to the scan)."""
    picked = events.filter(quoted(key) == F.lit(event_id))
    return picked.select(quoted(key), udm_or_convert(picked, **kw).alias("udm"))
