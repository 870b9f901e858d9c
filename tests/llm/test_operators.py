"""The training-data operators against brute force on small tables with every awkward row:
nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilark.llm import (ann, common, language_id, line_dedup, lm_score, mixture, ngram_join, packing, quality_classifier,
                          quality_rules, token_store)
from vigilark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, bins string, rank int"


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["the", "of", "ka", "lo", "mi", "ren", "tor", "sa", "vel", "and"]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) + "." * int(i % 9 == 8) for i in range(n))


PASSAGE = sentence(1, 60)
TEXTS = [
    (1, sentence(2, 40) + "\n" + PASSAGE, "en", "a"), (2, PASSAGE + "\n" + sentence(3, 30), "en", "a"),
    (3, sentence(4, 120), "fr", "b"), (4, sentence(4, 120), "fr", "b"), (5, sentence(4, 120) + " tail", "fr", None),
    (6, None, None, "b"), (7, "", "en", "c"), (8, " \n\t ", "en", "c"), (9, "one", "en", "c"), (10, "ONE", "en", "c"),
    (11, sentence(5, 6000), "en", "c"), (12, "é è\nüß " * 30, "de", "d"), (13, "!!! ### $$$", None, "d"),
    (14, "same line here\nsame line here\nother", "en", "d"), (15, "word " * 50, "en", "d"),
    (16, sentence(6, 30), "en", "a"), (16, sentence(6, 30), "en", "a"), (None, sentence(7, 30), "en", "a"), (17, "日本語 текст <|endoftext|>\x00 x", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t or ""), -1, -2, "x", 0) for i, t, g, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (13, 0, 0), (15, 0, 0), (None, 1, 0), (5, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_quality_rules_counts(docs, empty):
    got = {}
    for r in quality_rules.quality_rules(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, _, _ in TEXTS:
        t = t or ""
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(ws[k:k + 8]) for k in range(len(ws) - 7)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 500 else set()
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        if len(grams) < 500:
            assert r["n_repeat_words"] == len(hit)
            assert r["base_failed"] == (len(ws) < 20 or 100 * len(hit) > 30 * len(ws))
    assert len(got[16]) == 2
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_classifier(docs, labels, empty):
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs, labels).collect()}
    assert got[1]["kept"] and got[2]["kept"] and not got[13]["kept"] and not got[15]["kept"]
    assert all(not got[i]["kept"] and got[i]["score"] == 0 for i in (6, 7, 8))
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and 1 in {r["doc_id"] for r in kept.collect()}
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    free = quality_classifier.quality_classifier(docs, labels.filter("false")).filter("score > 0")
    assert free.filter("not kept").count() == 0


def test_sparse_sites_shrink():
    assert quality_classifier._strength(1, 0.5, 0.2, 3.0) == 1.0
    assert quality_classifier._strength(50, 0.8, 0.0001, 20.0) == 1e4  # no spread beyond noise: follow the global rate


def test_mixture(docs, empty):
    rows = mixture.mixture_report(docs).collect()
    assert len(rows) == len(TEXTS)
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in TEXTS}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum({(r["source_size"], r["target"]): r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mixture_report(docs).collect()))
    mix = mixture.mixture(docs)
    assert mix.columns == docs.columns
    taken = sum(r["taken"] for r in rows)
    assert mix.agg(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).first()[0] >= taken
    assert mixture.mixture_report(empty).count() == 0 and mixture.mixture(empty).count() == 0


def brute_fit(sizes, need):
    """What a source's last block gives, over all hashed orders: first fit, and the smallest left
    out if that is nearer."""
    found = []
    for t in range(mixture.TRIES):
        def place(h, t=t):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), 42)
            return struct.unpack("<q", xxhash.xxh64_digest(struct.pack("<i", t), seed)[::-1])[0]
        left, out, rest = need, [], []
        for h in sorted(sizes, key=place):
            if sizes[h] <= left:
                left -= sizes[h]
                out.append(h)
            else:
                rest.append((sizes[h], h))
        if rest and min(rest)[0] - left < left:
            left, out = min(rest)[0] - left, [*out, min(rest)[1]]
        found.append((left, out))
    return min(found)


def test_fitting_brute(spark):
    rng = np.random.default_rng(3)
    cases = [({int(h): int(n) for h, n in zip(rng.integers(-99, 99, 12), rng.integers(0, 60, 12))}, float(need))
             for need in (*rng.uniform(0, 400, 40), 0.5, 1.0)]
    rows = [([(h, n) for h, n in sorted(c.items())], need) for c, need in cases]
    d = spark.createDataFrame(rows, "entries array<struct<h2:bigint,words:bigint>>, need double").repartition(1)
    got = {r["need"]: r["t"] for r in d.select("need", mixture.fitting(F.col("entries"), F.col("need")).alias("t")).collect()}
    for c, need in cases:
        miss, _ = brute_fit(c, need)
        assert abs(sum(c[h] for h in got[need]) - need) == pytest.approx(miss) and len(set(got[need])) == len(got[need])


def test_mixture_is_what_its_report_says_and_near_its_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = d.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))  # a third of the rows without id
    key = ("doc_id", F.xxhash64("text", "source").alias("t"))
    takes = mixture.mixture(d).groupBy(*key).count()
    rows = d.select(*key, F.coalesce("source", F.lit("-")).alias("s"), F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")).alias("n"))
    mixed = {(r["doc_id"], r["t"]): r["count"] for r in takes.collect()}
    held = {}
    for r in rows.collect():
        held.setdefault((r["doc_id"], r["t"]), []).append((r["s"], r["n"]))
    report = mixture.mixture_report(d).collect()
    assert len(report) == d.count() and sum(r["taken"] for r in report) == sum(
        c * held[k][0][1] for k, c in mixed.items())
    by_target = {}
    for r in report:
        got = by_target.setdefault((r["source_size"], r["target"]), [0])
        got[0] += r["taken"]
    assert len(by_target) > 2
    assert all(abs(got[0] - target) <= 0.01 * target for (_, target), got in by_target.items())


def test_targets_fill_by_weight(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 50), (None, 940)], "source string, source_size long")
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 1.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixture.targets(s, w).collect()}
    assert got == pytest.approx({"a": 910.0, "b": 30.0, "c": 150.0, None: 910.0})


def test_splitting_tree_is_exact(spark):
    root = [37, 5, 0, 211, 1]
    q = spark.createDataFrame([(root,)], "k array<long>")
    leaves = [r["k"] for r in mixture.split_tree(q, 7, 3).collect()]
    assert len(leaves) == 7 and np.sum(leaves, 0).tolist() == root and min(map(min, leaves)) >= 0
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 3


def brute_draw(g, b, n, u):
    """The smallest k within 12 deviations of the mean whose cumulated probability reaches u."""
    if n <= 0 or b <= 0 or g <= 0:
        return n if n > 0 and b <= 0 else 0
    mean = n * g / (g + b)
    reach = math.ceil(12 * math.sqrt(mean * b / (g + b) + 1)) + 1
    low, high = max(0, n - b, math.floor(mean) - reach), min(n, g, math.floor(mean) + reach)
    total = 0
    for k in range(low, high):
        total += math.comb(g, k) * math.comb(b, n - k)
        if total / math.comb(g + b, n) >= u:
            return k
    return high


def test_a_draw_is_right_and_a_small_expression(spark):
    rng = np.random.default_rng(5)
    rows = []
    for top in (3, 12, 60, 200):
        for _ in range(25):
            g, b = map(int, rng.integers(0, top, 2))
            rows.append((g, b, int(rng.integers(0, g + b + 1)), float(rng.uniform(0.001, 0.999))))
    cols = [F.col(c) for c in "gbnu"]
    d = spark.createDataFrame(rows, "g long, b long, n long, u double")
    got = d.select(*cols, mixture._hypergeometric(*cols).alias("k")).collect()
    assert [r["k"] for r in got] == [brute_draw(*r[:4]) for r in got]
    # the driver analyses and copies it for every plan; with each use written out it has 31,000 characters
    assert len(str(mixture._hypergeometric(*cols))) < 5000


def test_token_store_round_trip(docs, empty, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    folder = f"file://{tmp_path}/store"
    d = token_store.train_dictionary(docs)
    token_store.write_shards(docs, folder, d)
    got = sorted(token_store.read_shards(docs.sparkSession, folder, d, with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted(((i is not None, i or 0, t or "") for i, t, _, _ in TEXTS))
    start = 0
    for r, (known, i, t) in zip(got, want, strict=True):
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if known else None, start, len(ids) // 4, zlib.crc32(ids))
        assert bytes(r["ids"]) == ids
        start += len(ids) // 4
    assert token_store.read_document(folder, 0, 1, d) == bytes(got[1]["ids"])
    with pytest.raises(ValueError):
        token_store.read_document(folder, 0, 1, d + b"x")
    assert token_store.token_store(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tool.encode_special_tokens = True
    rows = packing.best_fit_packing(docs).collect()
    want = sorted((i or 0, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes()))
                  for i, t, _, _ in TEXTS for ids in [[*tool.encode(t or "", add_special_tokens=False).ids, 1]]
                  for k in range(0, len(ids), 4096))
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.best_fit_packing(empty).count() == 0


def test_repacking_and_bounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(900, 2200, 400)
    bins, offsets, free = packing.best_fit_decreasing(lengths, 4096)
    assert packing.lower_bound(lengths, 4096) <= len(free)
    for b in range(len(free)):
        assert lengths[bins == b].sum() == 4096 - free[b]
    assert packing.lower_bound(np.full(7, 2100), 4096) == 7 and packing.lower_bound(np.full(6, 1365), 4096) == 2
    monkeypatch.setattr(packing, "PART_ROWS", 60)  # several partitions, with gaps, so that pieces are exchanged
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    out = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    total = {}
    for r in out:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 4096 and len(total) >= packing.lower_bound(lengths, 4096)


def brute_losses(docs, good, classes):
    """Per document, the token losses of the two models written out plainly; ``classes``: word -> class."""
    runs = {i: re.findall(r"[^\x20\x09-\x0D]{1,64}", t or "") for i, t in docs}
    models = []
    nexts = [Counter((classes[a], classes[b]) for i in ids for a, b in zip(runs[i], runs[i][1:])) for ids in (good, set(runs))]
    chars = {c for ws in runs.values() for w in ws for c in w + " " if c != "\0"}
    for ids in (good, set(runs)):
        said = Counter(w for i in ids for w in runs[i])
        grams, ctx = Counter(), Counter()
        for w, n in said.items():
            s = "\0\0" + w + " "
            for j in range(2, len(s)):
                if s[j] != "\0":
                    for k in range(3):
                        grams[s[j - k:j + 1]] += n
                        ctx[k, s[j - k:j]] += n
        models.append((said, grams, ctx, sum(said.values()), ctx[0, ""] + len(chars) + 1))

    def log(model, w):
        said, grams, ctx, total, size = model
        s, out = "\0\0" + w + " ", 0.0
        for j in range(2, len(s)):
            if s[j] != "\0":
                p = lm_score.WEIGHTS[2] * (grams[s[j]] + 1) / size
                for k, weight in ((2, lm_score.WEIGHTS[0]), (1, lm_score.WEIGHTS[1])):
                    if ctx[k, s[j - k:j]]:
                        p += weight * grams[s[j - k:j + 1]] / ctx[k, s[j - k:j]]
                out += math.log(p)
        p = (1 - lm_score.MEMORY) * math.exp(out) + lm_score.MEMORY * said[w] / max(total, 1)
        return math.log(p)

    def gain(n, a, b):
        first, then = (sum(v for k, v in n.items() if k[j] == c) for j, c in enumerate((a, b)))
        share, after = then / max(sum(n.values()), 1), n[a, b] / max(first, 1)
        return math.log((lm_score.PAIR * after + (1 - lm_score.PAIR) * share) / share) if first and then else 0.0

    def loss(w, before):
        alone = log(models[1], w) - log(models[0], w)
        return alone + (gain(nexts[1], classes[before], classes[w]) - gain(nexts[0], classes[before], classes[w]) if before else 0)

    return {i: [loss(w, b) for w, b in zip(ws, [None, *ws])] for i, ws in runs.items()}


def test_lm_score_brute(spark):
    texts = [(i, t) for i, t, _, _ in TEXTS if i not in (None, 16, 11, 17)] + [(20, "x" * 130 + " tail")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    good = spark.createDataFrame([(1, 1, 0), (4, 1, None), (12, 1, 1), (14, 0, 0)], "doc_id long, quality int, toxic int")
    counts = lm_score.count_words(lm_score.marked(df, good))
    of = lm_score.classes_of(counts, counts.agg({"nb": "sum"}).first()[0])
    classes = {r["word"]: int(of[r["b"]]) for r in counts.withColumn("b", lm_score.bucket(counts["word"])).collect()}
    assert {w for w, c in classes.items() if c < lm_score.OWN} and max(classes.values()) < lm_score.CLASSES
    want = brute_losses(texts, {1, 4}, classes)
    for r in lm_score.lm_score(df, good, hot_rows=40).collect():
        assert r["n_tokens_scored"] == len(want[r["doc_id"]])
        if want[r["doc_id"]]:
            assert abs(r["score"] - sum(want[r["doc_id"]]) / len(want[r["doc_id"]])) < 1e-6
        else:
            assert r["score"] is None


def test_lm_score_sees_order(spark):
    said = ["the cat sat on the mat and the dog ran to the cat", "a dog ran and a cat sat on a mat"]
    mixed = [" ".join(sorted(t.split())) for t in said]
    df = spark.createDataFrame(list(enumerate(said + mixed, 1)), "doc_id long, text string")
    good = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, good).collect()}
    assert got[1] < got[3] and got[2] < got[4]


def test_lm_score(docs, labels, empty):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    a, b, c = (sorted(lm_score.lm_score(docs, labels, **o).collect(), key=key) for o in ({}, {"hot_rows": 0}, {"spell_rows": 0}))
    assert a == b and len(a) == len(TEXTS)
    assert all(x["n_tokens_scored"] == y["n_tokens_scored"] and abs((x["score"] or 0) - (y["score"] or 0)) < 1e-6 for x, y in zip(a, c))
    by_id = {r["doc_id"]: r for r in a}
    assert by_id[6]["score"] is None and by_id[7]["score"] is None and by_id[1]["score"] < by_id[13]["score"]
    assert by_id[16]["n_tokens_scored"] == 30
    assert lm_score.lm_score(empty, labels).count() == 0


def sets_of(n):
    out = {}
    for i, t, _, _ in TEXTS:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, n, percent):
    sets = sets_of(n)
    up = {i: i for i in sets if i is not None}
    for _ in up:
        for a, b in itertools.combinations(up, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[a] = up[b] = min(up[a], up[b])
    got = ngram_join.ngram_components(docs, n, percent).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == up.get(r["doc_id"])
    kept = ngram_join.one_of_each(docs, n, percent)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *up.values()}
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_join_splits_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 4)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    base = sentence(9, 200).split()
    rows = [(i, " ".join(base[:i % 100] + [f"edit{i}"] + base[i % 100:])) for i in range(60)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_line_dedup(spark, docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.dedup_report(docs).collect()}
    assert got[1]["text"] == TEXTS[0][1] and got[2]["text"] == TEXTS[1][1].split("\n")[1]
    assert got[4]["text"] == "" and got[3]["n_removed"] == 0 and got[6]["text"] is None
    assert got[14]["n_removed"] == 0  # short repeats stay
    kept = line_dedup.without_copies(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 4 not in ids and ids.count(16) == 2 and {6, 7, 8, None} <= set(ids)
    assert line_dedup.dedup_report(empty).count() == 0
    lines = [sentence(s, 12) for s in range(20, 30)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x y", *lines[2:8], "", "z"])), (3, "\n".join(lines[:4])), (4, "\n".join([lines[9], *lines[5:]]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x y\n\nz", 3: rows[2][1], 4: lines[9]}


def test_language_id(spark, docs, empty):
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (6, 7, 8, 13))
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 4 == 2)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "de", "und") for r in got.values())
    assert language_id.language_id(empty).count() == 0


def test_language_id_letters_and_marks(spark):
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e"
    assert language_id.plain(hindi + " 7!") == hindi.encode()
    assert [language_id.plain(t) for t in ("\u00bd \u00b2 \u00b3", "\u2460\u2167", "\u0301", "")] == [b""] * 4
    rows = [(i, hindi * 20, "hi") for i in range(8)] + [(8 + i, "some plain words of text " * 20, "en") for i in range(8)]
    rows += [(50, "\u00bd \u00b2 \u00b3", "en"), (51, "\u0301\u0301", "hi"), (52, hindi, "hi")]
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52, 9)] == ["und", "und", "hi", "en"]


def test_sampled_passages_cover_whole_texts(spark):
    rows = [("a", str(i), "".join(chr(97 + j) * 10 for j in range(20))) for i in range(300)] + [("b", None, "x" * 25), ("b", None, "x" * 25), ("b", "1", "")]
    d = spark.createDataFrame(rows, "grp string, id string, text string")
    counts = {r["grp"]: r["n"] for r in d.groupBy("grp").agg(F.sum(common.passages_of(F.col("text"), 10)).alias("n")).collect()}
    assert counts == {"a": 6000, "b": 6}
    got = common.sample_passages(d, counts, 500, 10)
    a = Counter(p for g, p in got if g == "a")
    assert set(a) == {chr(97 + j) * 10 for j in range(20)} and 400 < sum(a.values()) < 600
    assert sorted(p for g, p in got if g == "b") == ["x" * 5, "x" * 10, "x" * 10]  # all of them, repeats once
    assert got == common.sample_passages(d.repartition(7), counts, 500, 10) and common.sample_passages(d, {}, 5, 10) == []


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_classifier_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    test = F.col("doc_id") % 3 == 0
    r = quality_classifier.quality_classifier(d, y.filter(~test)).join(y.filter(test), "doc_id")
    assert r.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def brute_nearest(x, ids, q, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit[q]
    s[q] = -9
    return [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]


def test_neighbours_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.nearest(v, block_rows=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = [len(set(brute_nearest(x, ids, q)) & set(got[int(ids[q])].values())) for q in np.flatnonzero(ids % 50 == 0)]
    assert np.mean(hits) / 5 >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (50, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(9))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(v).collect()}
    assert got[0, 1] == (1, 1.0) and got[0, 3][0] == 2 and (0, 4) not in got
    assert [got[50, i][0] for i in (1, 2, 3)] == [0, 1, 2] and (100, 1) not in got
    assert ann.nearest(v.filter("false")).count() == 0
    odd = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 0.0]), (3, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in ann.nearest(odd).collect()}
    assert got[1] == (1, pytest.approx(1.0)) and {got[2][0], got[3][0]} == {2, 3}
    assert [got[2][1], got[3][1]] == pytest.approx([math.sqrt(0.5)] * 2)
