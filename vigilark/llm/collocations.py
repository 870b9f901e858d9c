"""Phrase collocations by best-first branch and bound.

Words and pairs of neighbouring words are counted in one scan, which settles every prefix count, the
scores of all two-word phrases, and an admissible bound for what grows out of a pair ``u v``: a phrase
``u v w`` occurs at most f(u v) times, and cut after u its rest occurs at least as often as itself, so

    score(u v w) <= floor(1000000 * f(u v) / f(u)),   a(u v w) <= f(u v).

A pair under ``MINIMUM`` has nothing to grow (its phrases are no candidates). The pairs are the
frontier, best bound first. A round expands the best ``FRONTIER`` pairs of each language: one scan
counts all phrases of three words that begin or end with one of them. That gives the phrases that grow
out of a pair, and those that may drop it. Whatever ranks above the best pair left unexpanded is then
settled: a pair's own score never passes its bound, so it was expanded on both sides. A language whose
``TOP`` first survivors, ties included, rank strictly above that is done; the others go another round
with ``GROWTH`` times the frontier, at most to all their pairs. Scores and counts are compared together
(score, then a), so equal scores do not stretch the frontier.

What moves: one row a task buffer and distinct word or pair, and a few rows a pair kept. To the driver
and back go the pairs to expand, ``SENT`` at most; a round with more counts all phrases of three words
instead, by a shuffle, with the same result. Counts are pre-aggregated in each task, so a word, passage
or language that a third of the rows hold is a few rows a task. Arithmetic is in decimals of 38 digits
(counts up to 10^15); division rounds down.

Inputs: a null text is empty; an empty one, or one without words, adds nothing. A null language is
``und``, together with rows that say so. Very long texts are read in blocks at spaces; repeated rows
count as often as they occur. ``doc_id`` and other columns are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import saved

#: fixed by the contract: least count of a candidate, rows a language, share of a phrase (in %) that drops it
MINIMUM, TOP, SHARE = 10, 2000, 50
#: pairs a language expands in the first round; growth a round; most pairs sent to the tasks
FRONTIER, GROWTH, SENT = 20_000, 8, 500_000
#: words a task buffers, phrases of three words it buffers, bytes of a long text read at once, rows sent at once
BUFFER, FOUND, BLOCK, ROWS = 1_000_000, 100_000, 1 << 20, 50_000
UNKNOWN = "und"

STOP = b"."
#: A-Z lower-cased, all that ends a piece to a full stop, tab to space
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + STOP * 10)
COUNTS = "lang string, phrase string, f bigint"


def blocks_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, ``STOP`` between pieces; a long text in several lists, cut at spaces."""
    data, at = text.encode().translate(FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK) if len(data) - at > BLOCK else -1
        end = len(data) if end < 0 else end
        yield data[at:end].replace(STOP, b" . ").split()
        at = end


def pairs_in(b: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    """(lang, text) of each row, one at a time: a batch holds many megabytes of text."""
    for lang, text in zip(b["lang"], b["text"]):
        yield lang.as_py(), text.as_py()


class Numbers(dict):
    """Word -> number in order of appearance; ``STOP`` is 0."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def rows_of(lang: str, phrases: pa.Array, counts) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), ROWS):
        part = phrases[at:at + ROWS]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), part.cast(pa.string()),
                                          pa.array(counts[at:at + ROWS], pa.int64())], ["lang", "phrase", "f"])


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; the number of all words under the empty phrase."""
    buffers: dict[str, list[np.ndarray]] = {}
    numbers, size = Numbers(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(numbers), pa.binary())
        for lang, parts in buffers.items():
            a = np.concatenate(parts).astype(np.int64)
            f = np.bincount(a)
            seen = np.flatnonzero(f[1:]) + 1
            yield from rows_of(lang, pa.array([b""], pa.binary()), [int(f[1:].sum())])
            yield from rows_of(lang, names.take(pa.array(seen)), f[seen])
            pairs = (a[:-1] << 32 | a[1:])[(a[:-1] > 0) & (a[1:] > 0)]
            pairs, f = np.unique(pairs, return_counts=True)
            yield from rows_of(lang, pc.binary_join_element_wise(
                names.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF)), b" "), f)

    for b in batches:
        for lang, text in pairs_in(b):
            parts = buffers.setdefault(lang, [])
            for words in blocks_of(text):
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words)
            parts.append(np.zeros(1, np.int32))
            if size > BUFFER:
                yield from flush()
                buffers, numbers, size = {}, Numbers(), 0
    if buffers:
        yield from flush()


def _triples(sent):
    """Counts of the phrases of three words that begin or end with a pair of ``sent`` (a broadcast
    list of (lang, pair)); of all of them if it is None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[str, tuple[dict, np.ndarray]] = {}
        if sent is not None:
            by: dict[str, list[bytes]] = {}
            for lang, pair in sent.value:
                by.setdefault(lang, []).append(pair.encode())
            for lang, pairs in by.items():
                numbers = Numbers()
                ends = [[numbers[w] for w in p.split(b" ")] for p in pairs]
                nodes[lang] = dict(numbers), np.sort(np.array([u << 32 | v for u, v in ends], np.int64))
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in pairs_in(b):
                if sent is not None and lang not in nodes:
                    continue
                count = found.setdefault(lang, Counter())
                tail: list[bytes] = []
                for words in blocks_of(text):
                    words = tail + words
                    tail = words[-2:]
                    if sent is None:
                        count.update(zip(words, words[1:], words[2:]))
                        continue
                    numbers, pairs = nodes[lang]
                    a = np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))
                    keys = a[:-1] << 32 | a[1:]
                    at = np.searchsorted(pairs, keys)
                    hit = pairs[np.minimum(at, len(pairs) - 1)] == keys
                    for i in np.flatnonzero(hit[:-1] | hit[1:]).tolist():
                        count[words[i], words[i + 1], words[i + 2]] += 1
            if sum(map(len, found.values())) > FOUND:
                yield from triples_out(found)
                found = {}
        yield from triples_out(found)
    return run


def triples_out(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, count in found.items():
        rows = [(b" ".join(t), n) for t, n in count.items() if STOP not in t]
        if rows:
            yield from rows_of(lang, pa.array([p for p, _ in rows], pa.binary()), [n for _, n in rows])


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def wide(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def word(phrase: str, i: int) -> Column:
    return F.split(phrase, " ")[i]


def pairs_of(counts: DataFrame) -> DataFrame:
    """The candidates of two words with their score and the bound of what grows out of them."""
    f = counts.select("lang", "phrase", "f")
    pairs = counts.filter(F.col("phrase").contains(" ")).select(
        "lang", "phrase", F.col("f").alias("a"), word("phrase", 0).alias("u"), word("phrase", 1).alias("v"))
    pairs = (pairs.join(f.toDF("lang", "u", "l"), ["lang", "u"]).join(f.toDF("lang", "v", "r"), ["lang", "v"]))
    bound = F.call_function("div", wide(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), wide(F.col("l")))
    return pairs.select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
                        bound.alias("bound"))


def grown(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """The candidates of three words with the cut that scores lowest (ties: the first)."""
    f = counts.select("lang", "phrase", "f")

    def rest(i: int, n: int) -> Column:
        return F.array_join(F.slice(F.split("phrase", " "), i + 1, n), " ")

    out = triples.select("lang", "phrase", F.col("f").alias("a"), rest(0, 1).alias("u"), rest(1, 2).alias("vw"),
                         rest(0, 2).alias("uv"), rest(2, 1).alias("w"))
    for name in ("u", "vw", "uv", "w"):
        out = out.join(f.toDF("lang", name, "f_" + name), ["lang", name])
    cut = [F.struct(score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"),
                    F.col(y).alias("r")) for k, x, y in ((1, "f_u", "f_vw"), (2, "f_uv", "f_w"))]
    return out.withColumn("cut", F.least(*cut)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def survivors(expanded: DataFrame, triples: DataFrame, counts: DataFrame, share: int) -> DataFrame:
    """Candidates left among the expanded pairs and the phrases that grew out of all of them."""
    inside = triples.select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(F.split("phrase", " "), 1, 2), " "),
        F.array_join(F.slice(F.split("phrase", " "), 2, 2), " "))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    names = ("lang", "phrase", "a", "l", "r", "score")
    kept = (expanded.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * share)).select(*names))
    return kept.unionByName(grown(triples, counts).select(*names))


def ranked(df: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, minimum: int = MINIMUM, top: int = TOP, share: int = SHARE,
                 frontier: int = FRONTIER, sent: int = SENT) -> DataFrame:
    """Per language (by ``lang``) the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter(F.length("text") > 0)
    counts = saved(texts.mapInArrow(_words_and_pairs, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
                   .filter((F.col("f") >= minimum) | (F.col("phrase") == "")))
    totals = counts.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    pairs = saved(pairs_of(counts))
    order = Window.partitionBy("lang").orderBy(F.desc("bound"), F.desc("a"), "phrase")
    open_, done, most = totals.select("lang"), None, frontier
    while True:
        # the best pairs of each open language, and the first that is left
        best = saved(pairs.join(open_, "lang", "left_semi").withColumn("place", F.row_number().over(order))
                     .filter(F.col("place") <= most + 1))
        nodes = best.filter(F.col("place") <= most).drop("bound", "place")
        left = best.filter(F.col("place") == most + 1).select("lang", F.col("bound").alias("b"), F.col("a").alias("b_a"))
        told = None
        if nodes.count() <= sent:
            told = spark.sparkContext.broadcast([(r["lang"], r["phrase"]) for r in nodes.select("lang", "phrase").collect()])
        triples = saved(texts.mapInArrow(_triples(told), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
                        .filter(F.col("f") >= minimum).join(open_, "lang", "left_semi"))
        if told is None:        # all were counted: every pair of the open languages is expanded
            nodes, left = pairs.join(open_, "lang", "left_semi").drop("bound"), left.filter(F.lit(False))
        found = survivors(nodes, triples, counts, share).join(left, "lang", "left")
        above = F.col("b").isNull() | (F.col("score") > F.col("b")) | ((F.col("score") == F.col("b")) & (F.col("a") > F.col("b_a")))
        first = saved(ranked(found.filter(above).drop("b", "b_a"), top))
        settled = first.groupBy("lang").count().filter(F.col("count") >= top)
        open_ = saved(left.select("lang").join(settled, "lang", "left_anti"))
        first = first.join(open_, "lang", "left_anti")
        done = first if done is None else done.unionByName(first)
        if open_.isEmpty():
            break
        most *= GROWTH
    return done.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
