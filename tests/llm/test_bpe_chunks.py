"""Chunk reuse against the tokenizers library: whole texts, odd cuts, awkward rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigilark.llm import bpe_chunks as B
from vigilark.llm.common import table

SF = "/root/testdata/sf0.01"
TOOL = Tokenizer.from_file(public_tokenizers.path(B.TOKENIZER))
ODD = ["a", "b", "é", "é", "̈", " ", "  ", "\n", "\t", " ", " ", "'s", "'", "1", "½", "中", "!!",
       "<|startoftext|>", "<|endoftext|>", "<|start", "oftext|>", "İ", "Σ", "ß", "\U0001f600", "\x1c", "\x85",
       "hello", "world's", "don't", "\x00"]


def library(text):
    ids = TOOL.encode(text or "", add_special_tokens=False).ids
    return ids, TOOL.decode(ids, skip_special_tokens=False)


def expected(text):
    ids, back = library(text)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_any_cut_is_repaired():
    code, rnd = B.ChunkEncoder(), random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 120)))
        at = sorted({0, len(text), *(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 9)))})
        known = {i: code.ids(text[x:y]) for i, (x, y) in enumerate(zip(at, at[1:])) if rnd.random() < .5}
        assert code.whole(text, known, at) == np.array(library(text)[0], "<u4").tobytes(), (text, at)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(2)
    passage = "".join(map(chr, rng.integers(97, 123, 30_000)))
    a, b = B.cuts(passage), B.cuts("a few words before " + passage)
    parts = lambda text, at: {text[x:y] for x, y in zip(at, at[1:])}
    same = parts(passage, a) & parts("a few words before " + passage, b)
    assert len(same) >= len(a) - 3
    assert all(B.LEAST <= y - x <= B.MOST for x, y in zip(a, a[1:-1]))
    assert B.cuts("x" * 50_000)[1] == B.MOST and B.cuts("") == [0] and B.cuts("ab") == [0, 2]


def test_texts_without_spaces():
    code, rng = B.ChunkEncoder(), np.random.default_rng(3)
    for text in ("".join(map(chr, rng.integers(97, 123, 40_000))), "中文" * 9_000, "a" * 30_000):
        assert code.whole(text, {}) == np.array(library(text)[0], "<u4").tobytes()


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in B.chunk_encode(docs).collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(5)
    prose = " ".join("".join(rng.choice(list("abcdef \n"), 9)) for _ in range(2_000))
    other = " ".join("".join(rng.choice(list("ghijk"), 5)) for _ in range(500))
    texts = [(1, None), (2, ""), (3, " \n"), (4, prose), (4, prose), (None, prose), (5, "Head " + prose), (6, prose + " tail"),
             (7, other + prose + other), (8, "".join(ODD) * 50), (None, None), (9, "x"), (9, "y")]
    rows = [(i, t, "h", 1, "k", b"z") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n long, k string, ids binary").repartition(3)


def test_awkward_rows(spark, awkward):
    got = sorted((tuple(r) for r in B.chunk_encode(awkward).collect()), key=str)
    assert got == sorted(((r["doc_id"], *expected(r["text"])) for r in awkward.collect()), key=str)
    texts = awkward.filter("length(text) > 0").select(B.key_of(awkward.text).alias("k"), "text")
    assert B.shared_chunks(texts)[1].count() > 5      # and they were reused
    full = B.chunk_encode(awkward.filter("doc_id = 8"), with_ids=True).first()
    assert np.frombuffer(full["ids"], "<u4").tolist() == library(full and "".join(ODD) * 50)[0]
    assert full["decoded"] == library("".join(ODD) * 50)[1]
    assert B.chunk_encode(awkward.filter("false")).collect() == []


def test_hot_chunk_in_parts(spark, awkward, monkeypatch):
    monkeypatch.setattr(B, "PLACES", 2)
    got = sorted((tuple(r) for r in B.chunk_encode(awkward).collect()), key=str)
    assert got == sorted(((r["doc_id"], *expected(r["text"])) for r in awkward.collect()), key=str)


def test_tokenizers_that_keep_spaces_are_refused():
    with pytest.raises(ValueError):
        B.ChunkEncoder("byte_bpe_50k.json")
