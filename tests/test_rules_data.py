"""Rule files as data: load (object / array / bad JSON / nested folders), validate, merge, export."""

import json
import os

from pyspark.sql import functions as F

from vigilark.operators.rules import SAMPLE_RULES, as_rules
from vigilark.sources import rules as rules_source
from vigilark.sources.rules import RULE_FILE_EXTENSION as EXT
from vigilark.sources.rules import (collect_rules, export_rules, export_rules_text, load_rules, merge_rules,
                                    read_rule_files, rule_set_stats, rule_texts_frame, rules_frame, validate_rules)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_load_folder(spark, tmp_path):
    root = str(tmp_path)
    _write(f"{root}/a.{EXT}", json.dumps(SAMPLE_RULES, indent=2))          # multi-line file
    _write(f"{root}/sub/deeper/b.{EXT}", json.dumps({"name": "one", "conditions": {"x": 1}}))
    _write(f"{root}/sub/c.json", json.dumps([{"name": "two", "conditions": {"y": {"gt": 1}}}, 5]))
    _write(f"{root}/bad.{EXT}", "{not json")
    _write(f"{root}/notes.txt", json.dumps({"name": "ignored"}))
    _write(f"{root}/.git/d.{EXT}", json.dumps({"name": "in_git"}))
    rules, rejects = load_rules(read_rule_files(spark, root))
    names = sorted(r.name for r in rules.collect())
    assert names == sorted([r["name"] for r in SAMPLE_RULES] + ["one", "two"])
    errs = sorted(r.error for r in rejects.collect())
    assert errs == ["JSON decode error", "rule entry is not an object"]
    got = collect_rules(rules)
    assert [c for c in got if c.name == "SSH_Brute_Force_Detection"][0].conditions == \
        tuple(SAMPLE_RULES[0]["conditions"].items())


def test_hidden_names_load_and_git_does_not(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a folder")
    paths = ["_base", ".h", "_sub/x", ".team/deep/er/y", ".git/no", "sub/.git/no", ".github/no", "z"]
    for p in paths:
        _write(f"{root}/{p}.{EXT}", json.dumps({"name": p, "conditions": {"f": 1}}))
    want = [p for p in paths if not p.endswith("no")]
    for entries in (10_000, 1):  # one round, and a round a folder
        monkeypatch.setattr(rules_source, "LIST_ENTRIES", entries)
        rules, rejects = load_rules(read_rule_files(spark, root))
        assert sorted(r.name for r in rules.collect()) == sorted(want)
        assert rejects.count() == 0


def test_empty_folder_is_reported(spark, tmp_path):
    rules, rejects = load_rules(read_rule_files(spark, str(tmp_path)))
    assert rules.count() == 0
    assert [tuple(r) for r in rejects.collect()] == [(None, None, "no rule files found")]


def test_file_name_patterns():
    fits = rules_source._names("*.{x,json}").match
    assert fits("a.x") and fits(".h.json") and not fits("a.xy") and not fits("ax")
    assert rules_source._names("part-*").match("part-0") and not rules_source._names("part-*").match(".part-0.crc")


def test_several_operators_warn(spark):
    rules = rules_frame(spark, [{"name": "w", "conditions": {"a": {"gt": 1, "lt": 5}, "b": {"eq": 1}, "c": 3, "d": {"in": [1], "ne": 2}}},
                                {"name": "none"}, {"name": "one", "conditions": {"a": {"eq": {"x": 1, "y": 2}}}}])
    got = {r.name: (r.valid, r.warnings) for r in validate_rules(rules).collect()}
    first = rules_source.MANY_OPERATORS
    assert got == {"w": (True, [first + "a", first + "d"]), "none": (False, []), "one": (True, [])}


def test_enabled_truthiness(spark):
    texts = [("m", json.dumps([
        {"name": "a", "enabled": "false", "conditions": {"x": 1}},
        {"name": "b", "enabled": 0, "conditions": {"x": 1}},
        {"name": "c", "conditions": {"x": 1}},
        {"name": "d", "enabled": [], "conditions": {"x": 1}},
        {"name": "e", "enabled": None, "conditions": {"x": 1}},
    ]))]
    rules, _ = load_rules(rule_texts_frame(spark, texts))
    got = {r.name: r.enabled for r in rules.collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False}
    assert rule_set_stats(rules).first().asDict() == {"total_rules": 5, "enabled_rules": 2}


CASES = [
    {"name": "ok", "severity": "low", "conditions": {"x": 1}},
    {"conditions": {"x": 1}},
    {"name": "", "conditions": {}},
    {"name": "s", "severity": "LOW", "conditions": {"x": 1}},
    {"name": "n", "severity": None, "conditions": {"x": 1}},
    {"name": "k", "conditions": {"": 1}},
    {"name": 0, "conditions": {"x": 1}},
]


def test_validate_matches_driver_rules(spark):
    texts = [("v", json.dumps(CASES))]
    rules, _ = load_rules(rule_texts_frame(spark, texts))
    got = [list(r.errors) for r in validate_rules(rules).orderBy("entry_index").collect()]
    no_name = "Rule must have a 'name' field"
    assert [no_name in e for e in got] == [not c.get("name") for c in CASES]
    assert got[0] == [] and got[2] == ["Rule must have a 'name' field",
                                       "Rule must have 'conditions' field with at least one condition"]


def test_merge_skips_existing_names(spark):
    old = rules_frame(spark, SAMPLE_RULES[:2], path="old")
    new = rules_frame(spark, SAMPLE_RULES[1:] + [{"name": "Critical_Event_Alert", "conditions": {"a": 1}}],
                      path="new")
    merged = merge_rules(old, new)
    names = sorted(r.name for r in merged.collect())
    assert names == sorted(r["name"] for r in SAMPLE_RULES)
    crit = merged.filter(F.col("name") == "Critical_Event_Alert").first()
    assert json.loads(crit.rule_json)["conditions"] == {"event.severity": "critical"}


def test_export_round_trip(spark):
    rules = rules_frame(spark, SAMPLE_RULES)
    lines = [json.loads(r.value) for r in export_rules(rules).collect()]
    assert [list(x) for x in lines][0] == ["name", "description", "severity", "enabled", "conditions",
                                             "metadata", "created_at"]
    by_name = {x["name"]: x for x in lines}
    for r in SAMPLE_RULES:
        assert by_name[r["name"]]["conditions"] == r["conditions"]
        assert list(by_name[r["name"]]["conditions"]) == list(r["conditions"])
    text = export_rules_text(as_rules(SAMPLE_RULES))
    assert [x["name"] for x in json.loads(text)] == [r["name"] for r in SAMPLE_RULES]
