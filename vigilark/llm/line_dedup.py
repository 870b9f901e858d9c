"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

Every line with a word gets an id; ids that occur once end every repeated run, so only repeated
lines go on. Doubling ranks each position by its first 1, 2, 4 .. lines: a round sorts the
distinct pairs of neighbouring ranks and numbers them in order, which is the suffix array to
that depth, and a rank's members are the interval of suffixes whose common prefix is that long.
An interval that is not alone is a repeated run of lines.

A run counts when it has at least ``min_words`` words and an earlier copy (smaller document id,
or earlier in the same document). It is enough to look at minimal runs: for each position the
shortest run of that many words that starts there, and the shortest that ends there. Equal runs
have equal minimal runs, and together these cover exactly the maximal repeated runs. A minimal
run of m lines is named by two overlapping ranks of the largest power of two up to m, so depth
is bounded by ``min_words`` and does not grow with the copies. Lines in a run that has an
earlier copy are deleted; the first copy stays.

Scale: the first pass shuffles a few bytes a line with map-side sums; later rounds hold only
repeated lines, keyed by rank or by document. A line shared by a third of the corpus is one
partial row a task in every count, and a skewed side of a plain join where it is looked up.

Defined results: a null text stays null and an empty one empty; lines without words stay and do
not interrupt a run; documents with a null id come last in the order; rows that repeat id and
text are one document (they keep the same lines); other columns pass through ``line_dedup``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilark.llm.common import saved, words

MIN_WORDS = 50
KEY = ("none", "id", "th")  # null flag, id (0 for null, so that joins match) and text hash: a document, in corpus order


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line with a word: the document's key, n (line), i (rank among such lines), w."""
    parts = F.transform(F.split(F.col("text"), "\n"), lambda x, n: F.struct(
        n.alias("n"), F.size(words(x)).alias("w"), F.xxhash64(x).alias("h"), F.crc32(x.cast("binary")).alias("c")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").select(
        F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"),
        F.xxhash64("text").alias("th"),
        F.posexplode(F.filter(parts, lambda p: p["w"] > 0)).alias("i", "p"))
    return rows.select(*KEY, "i", "p.n", "p.w", "p.h", "p.c")


def _ranks(df: DataFrame, *keys: str) -> DataFrame:
    """Repeated values of ``keys`` with their rank in sorted order and first position."""
    found = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "i")).alias("first"))
    found = found.filter("copies > 1").orderBy(*keys)
    return saved(found.select(*keys, "first", F.monotonically_increasing_id().alias("rank")))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The lines to delete: none, id, th (the document), n (line number) and w (its words)."""
    lines = saved(_lines(docs, id_col, text_col))
    first = _ranks(lines.dropDuplicates([*KEY, "i"]), "h", "c")
    by_doc = W.partitionBy(*KEY)
    rows = lines.join(first.select("h", "c", "rank"), ["h", "c"]).dropDuplicates([*KEY, "i"]).select(
        *KEY, "i", "n", "w", F.col("rank").alias("r0"))
    # words before and up to a line, over repeated lines; runs with a gap are thrown out by count
    rows = rows.withColumn("t", F.sum("w").over(by_doc.orderBy("i")))
    rows = rows.withColumn("s", F.col("t") - F.col("w"))
    ahead = by_doc.orderBy("s").rangeBetween(0, min_words - 1)
    behind = by_doc.orderBy("t").rangeBetween(-(min_words - 1), 0)
    rows = saved(rows.select(
        "*", F.max("i").over(ahead).alias("e"), F.max("t").over(ahead).alias("te"), F.count("*").over(ahead).alias("ne"),
        F.min("i").over(behind).alias("b"), F.min("s").over(behind).alias("sb"), F.count("*").over(behind).alias("nb")))
    fore = rows.filter((F.col("te") - F.col("s") >= min_words) & (F.col("e") - F.col("i") + 1 == F.col("ne"))).select(
        *KEY, F.col("i").alias("a"), F.col("e").alias("z"))
    back = rows.filter((F.col("t") - F.col("sb") >= min_words) & (F.col("i") - F.col("b") + 1 == F.col("nb"))).select(
        *KEY, F.col("b").alias("a"), F.col("i").alias("z"))
    runs = saved(fore.unionByName(back).distinct().withColumn("m", (F.col("z") - F.col("a") + 1).cast("int")))
    longest = runs.agg(F.max("m")).first()[0] or 1

    # prefix doubling: level k ranks runs of 2^k lines
    level, levels = rows.select(*KEY, "i", F.col("r0").alias("r")), []
    levels.append(level.withColumn("k", F.lit(0)))
    for k in range(int(math.log2(longest))):
        at = by_doc.orderBy("i").rangeBetween(2 ** k, 2 ** k)
        pairs = level.withColumn("q", F.max("r").over(at)).filter("q is not null")
        ranks = _ranks(pairs, "r", "q")
        level = saved(pairs.join(ranks.select("r", "q", "rank"), ["r", "q"]).select(*KEY, "i", F.col("rank").alias("r")))
        levels.append(level.withColumn("k", F.lit(k + 1)))
    names = levels[0]
    for x in levels[1:]:
        names = names.unionByName(x)

    k = F.floor(F.log2("m")).cast("int")
    runs = runs.withColumn("k", k).withColumn("j", (F.col("z") + 1 - F.pow(F.lit(2), F.col("k"))).cast("int"))
    runs = runs.join(names.withColumnsRenamed({"i": "a", "r": "ra"}), [*KEY, "a", "k"])
    runs = saved(runs.join(names.withColumnsRenamed({"i": "j", "r": "rb"}), [*KEY, "j", "k"]).select(
        *KEY, F.col("a").alias("i"), "z", "m", "ra", "rb"))
    copies = _ranks(runs, "m", "ra", "rb")
    later = runs.join(copies.select("m", "ra", "rb", "first"), ["m", "ra", "rb"]).filter(F.struct(*KEY, "i") > F.col("first"))
    gone = later.select(*KEY, F.explode(F.sequence("i", "z")).alias("i")).distinct()
    gone = gone.join(rows.select(*KEY, "i", "n", "w"), [*KEY, "i"])
    return gone.select("none", F.when(~F.col("none"), F.col("id")).alias("id"), "th", "n", "w")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies deleted from the text, and ``__removed`` (array of line
    numbers) and ``__removed_words``. One shuffle of the texts, by document."""
    gone = repeated_lines(docs, min_words, id_col, text_col).groupBy(*KEY).agg(
        F.collect_list("n").alias("__removed"), F.sum("w").alias("__removed_words")).select(
        F.col("id").alias("__id"), F.col("th").alias("__th"), "__removed", "__removed_words")
    d = docs.withColumn("__h", F.xxhash64(F.col(text_col)))
    d = d.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left").drop("__id", "__th", "__h")
    lines = F.split(F.col(text_col), "\n")
    from vigilark.llm.common import let
    left = let(lines, lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__removed")), lambda i: F.get(ls, i)), "\n"))
    return d.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left))


def dedup_report(docs: DataFrame, **opts) -> DataFrame:
    """doc_id, text as it is left, n_removed lines and n_removed_words, for every document."""
    d = line_dedup(docs, **opts)
    return d.select("doc_id", "text", F.greatest(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("__removed_words", F.lit(0)).cast("long").alias("n_removed_words"))


def without_copies(docs: DataFrame, text_col: str = "text", **opts) -> DataFrame:
    """``docs`` with later copies deleted, columns unchanged. Documents of which no word is left
    go; those that had none stay."""
    d = line_dedup(docs, text_col=text_col, **opts)
    return d.filter(F.col("__removed").isNull() | (F.size(words(F.col(text_col))) > 0)).drop("__removed", "__removed_words")
