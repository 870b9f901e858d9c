"""Rows on which an operator once did less than the whole job."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.llm import line_dedup, ngram_join, queries


def library_ids(name, text):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids


SPECIAL = [(1, "plain words"), (2, "hello <|endoftext|> world"), (3, "a <|startoftext|> b"), (4, "A<|ENDOFTEXT|>b"),
           (5, "日本語 <|endoftext|><|startoftext|>"), (6, None)]


@pytest.fixture(scope="module")
def special(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('special')}"
    spark.createDataFrame(SPECIAL, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_token_store_query_knows_added_tokens(spark, special):
    start, want = 0, []
    for i, t in SPECIAL:
        ids = np.array([*library_ids("byte_bpe_50k.json", t or ""), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op4_token_store(spark, special).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_packing_query_and_stage_know_added_tokens(spark, special):
    import corpus_pipeline
    want = [(i, len(ids), zlib.crc32(ids.tobytes())) for i, t in SPECIAL
            for ids in [np.array([*library_ids("word_bpe_49k.json", t or ""), 1], "<u4")]]
    docs = spark.read.parquet(f"{special}/documents.parquet")
    for rows in (queries.op5_best_fit_packing(spark, special), corpus_pipeline.pack(spark, docs, special)):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows.collect()) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_line_dedup_finds_copies_in_null_id_documents(spark, kind):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(5))  # 60 words, 5 lines
    own = "\n".join(" ".join(f"v{i}x{j}" for j in range(12)) for i in range(5))
    rows = [(0, "first\n" + passage), (None, passage + "\nsecond"), (None, own + "\nthird"), (None, "fourth\n" + own + "\n" + own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {(r["doc_id"], r["text"], r["n_removed"], r["n_removed_words"]) for r in line_dedup.dedup_report(df).collect()}
    zero = {"long": 0, "string": "0"}[kind]
    assert {(zero, rows[0][1], 0, 0), (None, "second", 5, 60)} <= got and len(got) == 4
    # of the three copies of the other passage one is left, in the null-id document that comes first
    assert sorted(r[2:] for r in got - {(zero, rows[0][1], 0, 0), (None, "second", 5, 60)}) in ([(0, 0), (10, 120)], [(5, 60), (5, 60)])
    kept = line_dedup.without_copies(df.filter("text not like 'fourth%'").unionByName(
        spark.createDataFrame([(None, passage)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))))
    assert {r["text"] for r in kept.collect()} == {rows[0][1], "second", rows[2][1]}


def test_one_of_each_keeps_one_row_a_component(spark):
    def text(s, n=60):
        return " ".join(f"t{s}w{i}" for i in range(n))

    rows = [(1, text(1), "a"), (5, text(1) + " tail", "a"), (5, text(2), "a"),  # an id with two texts, one unique
            (6, text(2) + " tail", "a"),  # near the other text of 5, not near 1
            (7, text(3), "a"), (7, text(3), "a"), (7, text(3), "b"),  # rows that repeat id and text
            (None, text(4), "a"), (None, text(4), "a"), (None, text(4) + " tail", "a"),  # copies with null ids alone
            (None, text(1), "a"), (0, text(5), "a"), (None, text(5), "a"),  # null ids come after every id
            (None, text(6), "a"), (8, None, "a"), (8, "", "a"), (None, " ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in kept.collect()), key=str)
    nulls = [r for r in got if r[0] is None and (r[1] or "").startswith(text(4))]
    assert len(nulls) == 1
    want = [rows[i] for i in (0, 2, 4, 11, 13, 14, 15, 16)]
    assert sorted([r for r in got if r not in nulls], key=str) == sorted(want, key=str)
