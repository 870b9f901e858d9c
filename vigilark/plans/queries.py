"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

They are the operator inventory exercised end to end on the given tables; the matching
DuckDB SQL for each lives in ``vigilark.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import alerts as AL
from vigilark.operators import analytics as AN
from vigilark.operators import scan as SC
from vigilark.operators import udm as U
from vigilark.operators.compiler import java_regex_checker
from vigilark.plans import catalog as C
from vigilark.sources.events import read_table, security_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def events(spark, sf, **kw) -> DataFrame:
    """The ECS event table of ``sf``."""
    return security_events(spark, sf, **kw)


def agg_events(spark, sf, **kw) -> DataFrame:
    """Events for aggregations, which never read the UDM record: it is not built."""
    return events(spark, sf, udm=False, **kw)


def flagship_matches(spark, sf) -> DataFrame:
    return SC.scan(events(spark, sf), C.flagship_rules())


# ---------------------------------------------------------------------------
# sources and normalisation
# ---------------------------------------------------------------------------

@query("src_events")
def q_src_events(spark, sf):
    return read_table(spark, sf, "events")


@query("ecs_normalize")
def q_ecs_normalize(spark, sf):
    return events(spark, sf, udm=False, hour=False)


# ---------------------------------------------------------------------------
# UDM
# ---------------------------------------------------------------------------

@query("udm_convert")
def q_udm_convert(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", *U.udm_flat(F.col("udm")))


@query("udm_event_type")
def q_udm_event_type(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", "event_action", F.col("udm.metadata.event_type").alias("udm_event_type"))


@query("udm_severity")
def q_udm_severity(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", "event_severity", F.col("udm.metadata.severity").alias("udm_severity"))


@query("udm_session_id")
def q_udm_session_id(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", F.col("udm.network.session_id").alias("udm_session_id"))


@query("udm_auth_type")
def q_udm_auth_type(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", "event_action", F.col("udm.extensions.auth.type").alias("udm_auth_type"))


@query("udm_export")
def q_udm_export(spark, sf):
    # half the rows carry a stored udm record, the other half are converted on the fly
    ev = events(spark, sf)
    ev = ev.withColumn("udm", F.when(F.col("event_id") % 2 == 0, F.col("udm")))
    out = U.udm_export(ev)
    return out.select("event_id", *U.udm_flat(F.col("udm")))


@query("udm_one_event")
def q_udm_one_event(spark, sf):
    out = U.udm_one_event(events(spark, sf), C.SELECTED_EVENT_ID)
    return out.select("event_id", *U.udm_flat(F.col("udm")))


@query("nested_path")
def q_nested_path(spark, sf):
    ev = events(spark, sf, carry=("props",)).withColumn("props", F.from_json("props", "k INT"))
    return SC.scan(ev, C.NESTED_RULES).select("event_id", "rule_name")


# ---------------------------------------------------------------------------
# single predicates on the other tables
# ---------------------------------------------------------------------------

def _predicate_query(name: str) -> Query:
    table, keys, rules = C.PREDICATE_RULES[name]

    def run(spark, sf):
        df = read_table(spark, sf, table)
        # stored columns: the OR prefilter reaches the Parquet reader as pushed filters
        return SC.scan(df, rules, prefilter=True, regex_ok=java_regex_checker(spark)).select(*keys, "rule_name")
    return run


for _name in C.PREDICATE_RULES:
    QUERIES[_name] = _predicate_query(_name)


@query("rules_enabled")
def q_rules_enabled(spark, sf):
    return SC.scan(events(spark, sf), C.ENABLED_MIX_RULES).select("event_id", "rule_name")


# ---------------------------------------------------------------------------
# scans, tests, reports
# ---------------------------------------------------------------------------

@query("rule_scan")
def q_rule_scan(spark, sf):
    return flagship_matches(spark, sf).select("event_id", "rule_id", "rule_name", "rule_severity",
                                              "rule_description", "event_action", "source_ip")


@query("rule_scan_reasons")
def q_rule_scan_reasons(spark, sf):
    return SC.scan_reasons(flagship_matches(spark, sf))


@query("rule_test_summary")
def q_rule_test_summary(spark, sf):
    return SC.rule_test_summary(events(spark, sf), C.flagship_rules() + C.extra_rules())


@query("rule_test_sample")
def q_rule_test_sample(spark, sf):
    m = SC.scan(events(spark, sf), C.flagship_rules() + C.extra_rules())
    return SC.first_matches(m, 5).select("rule_name", "event_id", "sample_rank")


@query("rule_explain")
def q_rule_explain(spark, sf):
    return SC.rule_explain(events(spark, sf), C.flagship_rules()[0])


@query("match_report")
def q_match_report(spark, sf):
    return SC.match_report(flagship_matches(spark, sf))


@query("match_severity_summary")
def q_match_severity_summary(spark, sf):
    return SC.match_severity_summary(flagship_matches(spark, sf))


@query("match_severity_buckets")
def q_match_severity_buckets(spark, sf):
    return SC.match_severity_buckets(flagship_matches(spark, sf))


@query("rule_stats")
def q_rule_stats(spark, sf):
    rules = C.flagship_rules() + C.ENABLED_MIX_RULES
    return SC.rule_stats(rules, SC.scan(events(spark, sf), rules))


@query("match_summary_from_table")
def q_match_summary_from_table(spark, sf):
    # scan once, write the match table (partitioned by severity), report from the table
    from vigilark.session import materialize
    m = flagship_matches(spark, sf).select("event_id", "rule_id", "rule_name", "rule_severity", "event_action")
    table = materialize(m, "matches", partition_by=("rule_severity",))
    return SC.match_severity_summary(table)


@query("match_head")
def q_match_head(spark, sf):
    return SC.match_head(flagship_matches(spark, sf), 10).select("event_id", "rule_id", "rule_name")


@query("events_append")
def q_events_append(spark, sf):
    ev = events(spark, sf)
    first = SC.scan(ev, C.flagship_rules()).select("event_id", "rule_name", "rule_severity")
    second = SC.scan(ev, C.extra_rules()).select("event_id", "rule_name", "event_type")
    return AN.append(first, second)


# ---------------------------------------------------------------------------
# dashboard analytics
# ---------------------------------------------------------------------------

@query("overview")
def q_overview(spark, sf):
    return AN.overview(agg_events(spark, sf))


@query("timeline")
def q_timeline(spark, sf):
    return AN.timeline(agg_events(spark, sf))


@query("action_counts")
def q_action_counts(spark, sf):
    return AN.action_counts(agg_events(spark, sf))


@query("severity_counts")
def q_severity_counts(spark, sf):
    return AN.severity_counts(agg_events(spark, sf))


@query("outcome_counts")
def q_outcome_counts(spark, sf):
    return AN.outcome_counts(agg_events(spark, sf))


@query("top_source_ips")
def q_top_source_ips(spark, sf):
    return AN.top_source_ips(agg_events(spark, sf))


@query("top_users")
def q_top_users(spark, sf):
    return AN.top_users(agg_events(spark, sf))


@query("events_by_hour")
def q_events_by_hour(spark, sf):
    return AN.events_by_hour(agg_events(spark, sf))


@query("distinct_options")
def q_distinct_options(spark, sf):
    return AN.distinct_options(agg_events(spark, sf))


@query("filter_multi")
def q_filter_multi(spark, sf):
    out = AN.filter_multi(events(spark, sf), **C.MULTI_FILTER)
    return out.select("event_id", "event_severity", "event_action", "event_outcome")


@query("filter_counts")
def q_filter_counts(spark, sf):
    return AN.filter_counts(agg_events(spark, sf), **C.MULTI_FILTER)


@query("events_latest")
def q_events_latest(spark, sf):
    return AN.events_latest(events(spark, sf)).select("event_id", "timestamp", "event_action", "event_severity")


# ---------------------------------------------------------------------------
# alerts
# ---------------------------------------------------------------------------

@query("alert_status")
def q_alert_status(spark, sf):
    return AL.alert_status_for(agg_events(spark, sf), spark, C.ALERT_RULES)


@query("alerts_triggered")
def q_alerts_triggered(spark, sf):
    return AL.alerts_triggered(AL.alert_status_for(agg_events(spark, sf), spark, C.ALERT_RULES))


def queries() -> dict[str, Query]:
    from vigilark.plans import roundtrip, rule_files, streams, table_scan  # noqa: F401  (register)
    return dict(QUERIES)
