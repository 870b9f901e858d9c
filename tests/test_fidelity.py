"""Rule text, rule files and CSV cells come out as they went in."""

import csv
import glob
import json

import pytest

from conftest import SF_SMALL
from vigilark.operators.table_scan import detect
from vigilark.sources import sinks
from vigilark.sources.rules import export_rules, load_rules, rule_texts_frame


@pytest.mark.parametrize("method", ["compiled", "table"])
def test_variable_syntax_in_rules_is_plain_text(spark, method):
    text = "${env:PATH}"
    ev = spark.createDataFrame([(1, text), (2, "other")], "event_id long, message string")
    rules = [{"name": text, "conditions": {"message": {"in": [text]}}}]
    got = detect(ev, rules, method=method).select("event_id", "rule_name").collect()
    assert [tuple(r) for r in got] == [(1, text)]


@pytest.mark.parametrize("enabled", [True, False, "false", "yes", None, 0, [], {"a": 1}])
def test_export_keeps_every_json_type(spark, enabled):
    rule = {"name": 5, "description": "d", "severity": None, "enabled": enabled, "conditions": {"b": 1, "a": {"in": ["x"]}},
            "metadata": "hello", "created_at": "2024-01-01"}
    rules, _ = load_rules(rule_texts_frame(spark, [("p", "\n" + json.dumps([rule]))]))
    back = json.loads(export_rules(rules).first()["value"])
    assert back == rule and list(back["conditions"]) == ["b", "a"]


def test_null_entries_are_rejected(spark):
    rules, rejects = load_rules(rule_texts_frame(spark, [("p", '[null, {"name": "n", "conditions": {"a": 1}}]')]))
    assert rules.count() == 1 and [r["entry_index"] for r in rejects.collect()] == [0]


def test_csv_cells(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, ""), (4, None), (5, " padded "), (6, "back\\slash")]
    path = sinks.write_csv(spark.createDataFrame(rows, "id long, t string").coalesce(1), str(tmp_path / "c"))
    with open(glob.glob(path + "/part-*")[0], newline="") as f:
        plain = list(csv.reader(f))[1:]
    assert [(int(i), t) for i, t in plain] == [(i, t or "") for i, t in rows]
    assert [tuple(r) for r in sinks.read_csv(spark, path, "id long, t string").orderBy("id").collect()] == rows


def test_stream_reads_a_directory_table(spark, tmp_path):
    from vigilark.sources.events import read_table
    from vigilark.streaming.streams import read_event_stream
    read_table(spark, SF_SMALL, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    q = read_event_stream(spark, str(tmp_path), udm=False).writeStream.format("memory").queryName("dir_events").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dir_events").count() == read_table(spark, SF_SMALL, "events").count()
