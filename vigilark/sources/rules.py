"""Rule files as data: load, validate, merge and export with Spark.

A rule file holds one JSON object or an array of them. Loading walks a folder in tasks
(names that start with ``_`` or ``.`` included, which Spark's own readers hide; folders with
``.git`` in their name skipped), reads every matching file, splits arrays into one row per rule and keeps each rule's raw JSON text, so condition
order and JSON types survive for the compiler. Files that are not valid JSON and
entries that are not objects become rows of a rejects table instead of aborting the load.

Validation runs as column expressions on the rules table (JSON types via VARIANT), so a
repository of many thousands of rule files is checked in parallel.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import translate
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators.rules import VALIDATION_MESSAGES, Rule
from vigilark.schema import SEVERITIES
from vigilark.session import materialize

# Fixed value: rule files carry this extension (JSON content); plain .json is accepted too.
RULE_FILE_EXTENSION = "yaral"
RULE_FILE_GLOB = "*.{" + RULE_FILE_EXTENSION + ",json}"


#: entries that one task lists before it hands the folders left over to the next round
LIST_ENTRIES = 10_000
#: files that one task reads
READ_FILES = 256


def _names(glob: str) -> re.Pattern:
    """A file name pattern with ``{a,b}`` alternatives, as a regular expression."""
    parts = re.split(r"\{([^{}]*)\}", glob)
    options = [""]
    for i, part in enumerate(parts):
        options = [o + x for o in options for x in (part.split(",") if i % 2 else [part])]
    return re.compile("|".join(map(translate, options)))


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(quote(uri.replace("s3a://", "s3://", 1), safe="/:@"))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!//)", "file:///", full)


def list_rule_files(spark: SparkSession, path: str, glob: str = RULE_FILE_GLOB) -> DataFrame:
    """(path) of every file under ``path`` whose name fits ``glob``. Folders are walked in tasks;
    a task that has listed ``LIST_ENTRIES`` entries leaves its other folders to the next round,
    so a round is a job over the folders that are left, and nothing is gathered in one place."""
    root = _qualified(spark, path)
    fits = _names(glob)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, top = _file_system(root)
        for batch in batches:
            left, seen, out = batch.column("path").to_pylist(), 0, []
            while left and seen < LIST_ENTRIES:
                for info in system.get_file_info(fs.FileSelector(top + left.pop())):
                    seen += 1
                    below = info.path[len(top):]
                    if info.type == fs.FileType.Directory and ".git" not in info.base_name:
                        left.append(below)
                    elif info.type == fs.FileType.File and fits.match(info.base_name):
                        out.append(below)
            yield pa.RecordBatch.from_pydict({"path": out + left, "folder": [False] * len(out) + [True] * len(left)},
                                             schema=pa.schema([("path", pa.string()), ("folder", pa.bool_())]))

    files, folders = None, spark.createDataFrame([("",)], "path string")
    while folders is not None:
        found = materialize(folders.mapInArrow(walk, "path string, folder boolean"), "rule-walk")
        new = found.filter(~F.col("folder")).select("path")
        files = new if files is None else files.unionByName(new)
        left = found.filter("folder").select("path")
        n = left.count()
        folders = left.repartition(min(n, 1024)) if n else None
    return files.select(F.concat(F.lit(root), "path").alias("path"))


def read_rule_files(spark: SparkSession, path: str, glob: str = RULE_FILE_GLOB) -> DataFrame:
    """(path, content) per rule file; recursive; hidden names included, ``.git`` folders skipped.
    Files are listed and read in tasks through ``pyarrow.fs`` (local, S3, GCS, ABFS, HDFS)."""
    root = _qualified(spark, path)
    files = list_rule_files(spark, path, glob)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _file_system(root)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with system.open_input_stream(top + name[len(root):], compression=None) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"path": [name], "content": [text]})

    tasks = max(1, -(-files.count() // READ_FILES))
    return files.repartition(tasks, "path").mapInArrow(read, "path string, content string")


def rule_texts_frame(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(path, content) rows from in-memory texts (uploads, tests)."""
    return spark.createDataFrame(texts, "path string, content string")


def _entries(files: DataFrame) -> DataFrame:
    body = F.btrim(F.col("content"), F.lit(" \t\r\n"))  # the white space of JSON
    as_array = F.from_json(body, "array<string>")
    ok_json = F.try_parse_json(body).isNotNull()
    entries = F.when(body.startswith("["), as_array).when(ok_json, F.array(body))
    return files.select("path", ok_json.alias("_ok"), entries.alias("_e"))


def load_rules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, rejects). rules: one row per rule entry, raw JSON kept in ``rule_json``. Where there
    is no file at all, rejects says so in a row without path."""
    e = _entries(files)
    rejects_file = e.filter(~F.col("_ok") | F.col("_e").isNull()).select(
        "path", F.lit(None).cast("int").alias("entry_index"), F.lit("JSON decode error").alias("error"))
    exploded = (e.filter(F.col("_e").isNotNull())
                .select("path", F.posexplode("_e").alias("entry_index", "rule_json")))
    v = F.try_parse_json("rule_json")
    kind = F.schema_of_variant(v)
    is_obj = F.coalesce(kind.startswith("OBJECT"), F.lit(False))  # a null entry is rejected too
    conds_kind = F.schema_of_variant(F.try_variant_get(v, "$.conditions", "variant"))
    cond_ok = conds_kind.isNull() | conds_kind.startswith("OBJECT")
    rejects_entry = exploded.filter(~is_obj | ~cond_ok).select(
        "path", "entry_index",
        F.when(~is_obj, F.lit("rule entry is not an object")).otherwise(F.lit("'conditions' is not an object"))
        .alias("error"))
    rules = exploded.filter(is_obj & cond_ok).select(
        "path", "entry_index", "rule_json",
        F.coalesce(F.get_json_object("rule_json", "$.name"), F.lit("Unnamed Rule")).alias("name"),
        F.coalesce(F.get_json_object("rule_json", "$.severity"), F.lit("medium")).alias("severity"),
        F.coalesce(F.get_json_object("rule_json", "$.description"), F.lit("")).alias("description"),
        truthy(F.try_variant_get(v, "$.enabled", "variant"), default=True).alias("enabled"),
        F.coalesce(F.get_json_object("rule_json", "$.conditions"), F.lit("{}")).alias("conditions_json"),
    )
    nothing = files.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("entry_index"),
        F.lit("no rule files found").alias("error"))
    return rules, rejects_file.unionByName(rejects_entry).unionByName(nothing)


def truthy(x: Column, default: bool) -> Column:
    """Python truthiness of a JSON value held as VARIANT (SQL null = key absent)."""
    t = F.schema_of_variant(x)
    return (F.when(x.isNull(), F.lit(default))
            .when(F.is_variant_null(x), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), t != "ARRAY<VOID>")
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True))))


#: warning, followed by the field
MANY_OPERATORS = "Only the first operator counts: "


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds ``errors`` (array of messages, in check order), ``valid`` and ``warnings`` to each rule
    row. A warning names a condition with several operators: only the first counts, the rule
    stays valid."""
    v = F.try_parse_json("rule_json")
    name = F.try_variant_get(v, "$.name", "variant")
    conds = F.try_variant_get(v, "$.conditions", "variant")
    sev = F.try_variant_get(v, "$.severity", "variant")
    sev_ok = ((F.schema_of_variant(sev) == "STRING")
              & F.try_variant_get(sev, "$", "string").isin(list(SEVERITIES)))
    keys = F.json_object_keys(F.get_json_object("rule_json", "$.conditions"))
    checks = F.array(
        F.when(~truthy(name, default=False), F.lit(VALIDATION_MESSAGES["name"])),
        F.when(~truthy(conds, default=False), F.lit(VALIDATION_MESSAGES["conditions"])),
        F.when(sev.isNotNull() & ~F.coalesce(sev_ok, F.lit(False)), F.lit(VALIDATION_MESSAGES["severity"])),
        F.when(F.coalesce(F.array_contains(keys, ""), F.lit(False)), F.lit(VALIDATION_MESSAGES["field"])),
    )
    errors = F.filter(checks, lambda m: m.isNotNull())
    fields = F.map_entries(F.from_json(F.get_json_object("rule_json", "$.conditions"), "map<string,string>"))
    several = F.filter(fields, lambda e: F.size(F.json_object_keys(e["value"])) > 1)
    warnings = F.transform(several, lambda e: F.concat(F.lit(MANY_OPERATORS), e["key"]))
    return rules.withColumns({"errors": errors, "valid": F.size(errors) == 0,
                              "warnings": F.coalesce(warnings, F.array().cast("array<string>"))})


def merge_rules(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("path", "entry_index"),
                ) -> DataFrame:
    """Append incoming rules whose name is not already present (first of each name wins).

    "First per name" is a ``min_by`` aggregate: map-side partial aggregation keeps one
    candidate per name per partition, so a name repeated across a third of the files never
    gathers its rows in one task."""
    cols = [c for c in incoming.columns if c != "name"]
    first = (incoming.groupBy("name")
             .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
             .select("name", *[F.col("_first." + c).alias(c) for c in cols]))
    fresh = first.join(existing.select("name").distinct(), "name", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def rule_set_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("total_rules"), F.count_if("enabled").alias("enabled_rules"))


def export_rules(rules: DataFrame) -> DataFrame:
    """One JSON text per rule with the seven rule keys (raw condition / metadata JSON kept)."""
    v = F.try_parse_json("rule_json")

    def value(path: str, default: str) -> Column:
        """Any JSON value as JSON text; an object's own text, which keeps the order of its keys."""
        found = F.try_variant_get(v, path, "variant")
        own = F.when(F.schema_of_variant(found).startswith("OBJECT"), F.get_json_object("rule_json", path))
        return F.coalesce(own, F.to_json(found), F.lit(default))

    def text(c: Column) -> Column:
        return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)

    line = F.concat(
        F.lit('{"name": '), value("$.name", '"Unnamed Rule"'),
        F.lit(', "description": '), value("$.description", '""'),
        F.lit(', "severity": '), value("$.severity", '"medium"'),
        F.lit(', "enabled": '), value("$.enabled", "true"),
        F.lit(', "conditions": '), value("$.conditions", "{}"),
        F.lit(', "metadata": '), value("$.metadata", "{}"),
        F.lit(', "created_at": '), text(F.coalesce(F.get_json_object("rule_json", "$.created_at"),
                                                   F.date_format(F.current_timestamp(),
                                                                 "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))),
        F.lit("}"))
    return rules.select(line.alias("value"))


def write_rules(rules: DataFrame, path: str, mode: str = "overwrite") -> str:
    export_rules(rules).write.mode(mode).text(path)
    return path


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Bring a rule set to the driver for the compiled scan, in order of path, entry and text. (The
    table-driven scan takes the rules table as it is.)"""
    rows = rules.orderBy("path", "entry_index", "rule_json").select("rule_json").collect()
    return [Rule.from_dict(json.loads(r.rule_json), i) for i, r in enumerate(rows)]


def rules_frame(spark: SparkSession, rules: list[dict[str, Any]], path: str = "<memory>") -> DataFrame:
    """A rules table from in-memory dicts (same columns as ``load_rules``)."""
    texts = [(path, json.dumps(rules))]
    return load_rules(rule_texts_frame(spark, texts))[0]


def export_rules_text(rules: list[Rule]) -> str:
    """Driver-side export of an in-memory rule list: an indented JSON array."""
    return json.dumps([r.to_dict() for r in rules], indent=2)


__all__ = ["list_rule_files", "read_rule_files", "load_rules", "validate_rules", "merge_rules", "rule_set_stats", "export_rules",
           "write_rules", "collect_rules", "rules_frame", "export_rules_text"]
