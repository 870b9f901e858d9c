"""Collocations against a plain count of every phrase, on the given table and on awkward rows."""

import re
from collections import Counter

import pytest

from vigilark.llm import collocations as C
from vigilark.llm.common import table

SF = "/root/testdata/sf0.01"
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, minimum=10, top=2000, share=50):
    counts = {}
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(FOLD)):
            w = re.findall("[^\\x20\\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i:i + k])] += 1
    out = {}
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= minimum}
        gone = {s for k, v in found.items() if len(k) == 3 for s in (k[:2], k[1:]) if 100 * v >= share * found[s]}
        res = []
        for k, a in found.items():
            if k not in gone:
                sc, _, left, right = min((1000000 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]])
                                         for i in range(1, len(k)))
                res.append((-sc, -a, " ".join(k).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(res)[:top], 1):
            out[lang, i] = (p.decode(), -a, left, right, n, -s)
    return out


def run(docs, **kw):
    rows = C.collocations(docs, **kw).collect()
    got = {(r["lang"], r["rank"]): tuple(r[k] for k in ("phrase", "a", "l", "r", "n", "score")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("kw", [dict(), dict(frontier=15, top=100), dict(frontier=10, top=100, sent=0)])
def test_whole_table(spark, kw):
    docs = table(spark, SF, "documents")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], top=kw.get("top", 2000))
    assert run(docs, **kw) == want and want


SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50)      # long texts in several blocks
    loop = "Rio Grande rio  grande\tNorth, a a a a! Été été zoo\x0bzoo zoo zoo\x1fzoo q" + chr(0)
    rows = [(1, loop, "en"), (1, loop, "en"), (None, loop * 40, None), (3, "x " * 30 + "y", "und"), (4, None, "en"), (5, "", "de"),
            (6, " \t\n ...", "fr"), (7, "one two three four " * 900, "fr"), (8, "solo", "it"), (9, "w" * 400 + " w", "it")]
    docs = spark.createDataFrame([(i, t, g, "p", 3) for i, t, g in rows], SCHEMA).repartition(3)
    want = brute([(g, t) for _, t, g in rows])
    assert {g for g, _ in want} == {"und", "fr"}
    assert run(docs) == want
    assert run(docs, minimum=2, frontier=1, top=3) == brute([(g, t) for _, t, g in rows], minimum=2, top=3)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_past_64_bits(spark):
    big = 10 ** 12
    df = spark.createDataFrame([(big + 7, 2 * big + 1, big + 9)], "a long, l long, r long")
    a, left, right = big + 7, 2 * big + 1, big + 9
    assert df.select(C.score(df.a, df.l, df.r)).first()[0] == 1000000 * a * a // (left * right)
