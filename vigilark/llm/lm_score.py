"""LM scoring by cross-entropy difference (Moore-Lewis selection).

Two models, of the target (documents labelled good) and of the background (every document),
share one vocabulary of words and characters, and their order and weights, so they are matched
and their per-token losses can be subtracted. A token is a run of at most 64 characters that are
not white space (a longer word is several tokens, so none is cut). The models are class bigrams:
a token's probability is that of its class after the class of the token before, times that of the
token in its class. A token that makes at least 1 / ``OWN`` of all tokens is a class of its own,
the others share ``SHARED`` classes by hash, the same for both models; the class bigram is mixed
with the class's own share. Within a class, a token's probability mixes
how often the model's documents hold it with how a character trigram model spells it; the
trigrams are counted over the tokens of the same documents. A document's score is the mean of
loss under the target minus loss under the background: the lower, the more like the target.

So a loss is that of the token alone, less the log of how much likelier its class is after the
class before it; the first token of a document has no such term. Pairs of classes are counted in
the task that reads the texts, and the table of pairs has (OWN + SHARED) squared cells whatever
the corpus, so it is summed by one small shuffle and broadcast, and texts are never shuffled for it.

Counts cover all documents. The word table has a row a distinct token, so it grows with the
corpus; trigrams and spellings are computed once a distinct token. To score, the words seen at
least total / ``hot_rows`` times (``hot_rows`` at most, whatever the corpus) are broadcast and
summed where documents are read. Every other word has fewer occurrences than that, so none is a
hot key, and its occurrences are joined to the table. The split changes no score. Losses are
summed as whole nanonats, so reruns agree.

Defined results: a null, empty or white text has no tokens and a null score; U+0000 marks the
start of a token and is not scored as a character; characters never counted share the unigram
floor; repeated rows score alike; without target documents the target only spells, at its floor;
only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import saved, small
from vigilark.session import materialize

TOKEN = r"[^\x20\x09-\x0D]{1,64}"
#: interpolation weights of the character trigram, bigram and unigram
WEIGHTS = (0.6, 0.3, 0.1)
#: the weight of a token's own count beside its spelling
MEMORY = 0.8
HOT_ROWS = 1_000_000
SPELL_ROWS = 2_000_000
#: classes of the class bigram: at most OWN frequent tokens, and SHARED classes for the others
OWN, SHARED = 512, 512
CLASSES = OWN + SHARED
#: tokens are looked up by one of so many hashes
BUCKETS = 1 << 20
#: the weight of the class bigram beside the class alone
PAIR = 0.5
BROADCAST_IDS = 1_000_000
NANO = 1_000_000_000
BITS, MASK1, MASK2 = 21, (1 << 21) - 1, (1 << 42) - 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram keys, index of their word): two marks of the start, the characters, a space."""
    parts = [f"\0\0{w} " for w in words]
    cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keys = (cps[:-2] << 2 * BITS) | (cps[1:-1] << BITS) | cps[2:]
    inside = (owner[:-2] == owner[2:]) & (cps[2:] != 0)
    return keys[inside], owner[2:][inside]


def marked(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """good (1 for the target's documents, else 0) and text of every document."""
    marks = small(saved(good_ids.select(F.col(id_col).alias("__g")).filter("__g is not null").distinct()), BROADCAST_IDS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, F.col("id") == F.col("__g"), "left")
    return rows.select(F.col("__g").isNotNull().cast("long").alias("good"), "text")


def count_words(docs: DataFrame) -> DataFrame:
    """word, nt (occurrences in good documents), nb (in all documents) of ``marked`` documents,
    written to the shared folder."""
    rows = docs.select("good", F.explode(tokens(F.col("text"))).alias("word"))
    return materialize(rows.groupBy("word").agg(F.sum("good").alias("nt"), F.count("*").alias("nb")), "lm-words")


def count_trigrams(counts: DataFrame) -> DataFrame:
    """key, nt and nb of every character trigram of the counted tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = spelled(batch.column("word").to_pylist())
            new, at = np.unique(keys, return_inverse=True)
            sums = [np.zeros(len(new), np.int64) for _ in range(2)]
            for out, c in zip(sums, ("nt", "nb")):
                np.add.at(out, at, batch.column(c).to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(new), *map(pa.array, sums)], names=["key", "nt", "nb"])

    return counts.mapInArrow(count, "key long, nt long, nb long").groupBy("key").agg(F.sum("nt").alias("nt"), F.sum("nb").alias("nb"))


def fit_spelling(counts: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """(model: k, key, pt, pb with weighted probabilities of orders 3, 2 and 1; the floors)."""
    tri = saved(count_trigrams(counts))
    sums = lambda df, key: df.groupBy(key.alias("key")).agg(F.sum("nt").alias("nt"), F.sum("nb").alias("nb"))
    bi = saved(sums(tri, F.col("key").bitwiseAND(F.lit(MASK2))))
    uni = saved(sums(bi, F.col("key").bitwiseAND(F.lit(MASK1))))
    total = uni.agg(F.sum("nt").alias("t"), F.sum("nb").alias("b"), F.count("*").alias("v")).first()
    size = total["v"] + 1  # the shared characters, with the unknown one
    nt, nb = (total["t"] or 0) + size, (total["b"] or 0) + size

    def order(df: DataFrame, k: int, weight: float) -> DataFrame:
        ctx = F.shiftright("key", BITS)
        ctxs = df.groupBy(ctx.alias("ctx")).agg(F.sum("nt").alias("ct"), F.sum("nb").alias("cb"))
        part = lambda n, c: F.lit(weight) * F.coalesce(F.try_divide(F.col(n), F.col(c)), F.lit(0.0))
        return df.withColumn("ctx", ctx).join(ctxs, "ctx").select(
            F.lit(k).alias("k"), "key", part("nt", "ct").alias("pt"), part("nb", "cb").alias("pb"))

    w3, w2, w1 = WEIGHTS
    one = uni.select(F.lit(1).alias("k"), "key", (w1 * (F.col("nt") + 1) / nt).alias("pt"), (w1 * (F.col("nb") + 1) / nb).alias("pb"))
    return saved(order(tri, 3, w3).unionByName(order(bi, 2, w2)).unionByName(one)), (w1 / nt, w1 / nb)


def spellings(counts: DataFrame, model: DataFrame, floors: tuple[float, float], rows: int = SPELL_ROWS) -> DataFrame:
    """``counts`` with st and sb, the log probabilities of spelling each token. A model of up to
    ``rows`` rows is broadcast, a larger one joined."""
    if model.limit(rows + 1).count() > rows:
        return _spellings_by_join(counts, model, floors)
    table = model.orderBy("k", "key").toPandas()  # at most ``rows`` rows
    parts = [(mask, *(table.loc[table["k"] == k, c].to_numpy() for c in ("key", "pt", "pb")))
             for k, mask in ((3, -1), (2, MASK2), (1, MASK1))]
    shared = counts.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, owner = spelled(batch.column("word").to_pylist())
            p = [np.zeros(len(k)), np.zeros(len(k))]
            for mask, keys, *probs in shared.value:
                low = k & mask
                at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                for out, prob in zip(p, probs):
                    out += np.where(keys[at] == low, prob[at], 0.0)
            logs = [np.bincount(owner, np.log(np.maximum(x, f)), batch.num_rows) for x, f in zip(p, floors)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, logs)], names=[*batch.schema.names, "st", "sb"])

    return counts.mapInArrow(run, "word string, nt long, nb long, st double, sb double")


def _spellings_by_join(counts: DataFrame, model: DataFrame, floors: tuple[float, float]) -> DataFrame:
    """The same spellings by joining each token's trigrams to the model, order by order."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            k, owner = spelled(words.to_pylist())
            yield pa.RecordBatch.from_arrays([words.take(pa.array(owner)), pa.array(k)], names=["w", "k3"])

    x = counts.select("word").mapInArrow(grams, "w string, k3 long")
    x = x.withColumns({"k2": F.col("k3").bitwiseAND(F.lit(MASK2)), "k1": F.col("k3").bitwiseAND(F.lit(MASK1))})
    for k in (3, 2, 1):
        m = model.filter(F.col("k") == k).select(F.col("key").alias(f"k{k}"), F.col("pt").alias(f"t{k}"), F.col("pb").alias(f"b{k}"))
        x = x.join(m, f"k{k}", "left")

    def log(c: str, floor: float) -> Column:
        return F.log(F.greatest(sum((F.coalesce(f"{c}{k}", F.lit(0.0)) for k in (3, 2, 1)), F.lit(0.0)), F.lit(floor)))

    s = x.groupBy("w").agg(F.sum(log("t", floors[0])).alias("st"), F.sum(log("b", floors[1])).alias("sb"))
    return counts.join(s, counts["word"] == s["w"], "left").drop("w")


def word_losses(counts: DataFrame, total: tuple[int, int], spell_rows: int = SPELL_ROWS) -> DataFrame:
    """word, nb and delta (loss under the target minus loss under the background, in nanonats)."""
    known = spellings(counts, *fit_spelling(counts), spell_rows)

    def log(n: str, of: int, spell: str) -> Column:
        alone = F.lit(float(np.log(1 - MEMORY))) + F.coalesce(F.col(spell), F.lit(0.0))
        memory = F.log(F.col(n) * F.lit(MEMORY / max(of, 1)))
        both = F.greatest(alone, memory) + F.log1p(F.exp(-F.abs(alone - memory)))
        return F.when(F.col(n) > 0, both).otherwise(alone)

    delta = F.round((log("nb", total[1], "sb") - log("nt", total[0], "st")) * NANO).cast("long")
    return materialize(known.select("word", "nb", delta.alias("delta")), "lm-losses")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classes_of(counts: DataFrame, total: int) -> np.ndarray:
    """The class of each bucket of tokens: below OWN for the buckets with at least 1 / OWN of the
    ``total`` tokens (so at most OWN of them), else one of the shared classes."""
    own = counts.groupBy(bucket(F.col("word")).alias("b")).agg(F.sum("nb").alias("n")).filter(F.col("n") * OWN >= max(total, 1))
    found = sorted(r["b"] for r in own.collect())  # at most OWN
    out = (OWN + np.arange(BUCKETS) % SHARED).astype(np.int32)
    out[found] = np.arange(len(found))
    return out


def pairs_of(buckets: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class pair as one number, row) of every two neighbouring tokens of the rows' ``buckets``."""
    flat = classes[buckets.flatten().to_numpy()]
    row = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy())
    same = row[1:] == row[:-1]
    return (flat[:-1] * CLASSES + flat[1:])[same], row[1:][same]


def count_pairs(docs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each in good documents and in all ``marked`` documents, as two
    square matrices. A task sums its rows into them and sends the cells that are not zero."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CLASSES * CLASSES), np.int64)
        for batch in batches:
            pairs, row = pairs_of(batch.column("buckets"), shared.value)
            good = batch.column("good").to_numpy()[row] > 0
            for out, of in zip(sums, (pairs[good], pairs)):
                out += np.bincount(of, minlength=len(out))
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in sums)], names=["pair", "nt", "nb"])

    rows = docs.select("good", F.transform(tokens(F.col("text")), bucket).alias("buckets"))
    found = rows.mapInArrow(count, "pair long, nt long, nb long").groupBy("pair").agg(F.sum("nt").alias("nt"), F.sum("nb").alias("nb"))
    cells = found.toArrow()  # at most CLASSES squared rows
    out = np.zeros((2, CLASSES * CLASSES), np.int64)
    out[:, cells["pair"].to_numpy()] = [cells["nt"].to_numpy(), cells["nb"].to_numpy()]
    return out.reshape(2, CLASSES, CLASSES)


def pair_losses(counts: np.ndarray) -> np.ndarray:
    """What a pair of classes adds to loss under the target minus loss under the background, in
    nanonats: a class that a model never saw, before or after, adds nothing to that model's loss."""
    def gain(n: np.ndarray) -> np.ndarray:
        alone = np.outer(n.sum(axis=1), n.sum(axis=0).astype(float))
        times = np.divide(n * float(n.sum()), alone, out=np.ones(n.shape), where=alone > 0)
        return np.log((1 - PAIR) + PAIR * times)

    return np.rint((gain(counts[1]) - gain(counts[0])) * NANO).astype(np.int64)


def score_pairs(rows: DataFrame, classes: np.ndarray, losses: np.ndarray) -> DataFrame:
    """``rows`` (doc_id, th, text) as doc_id, th and delta, the sum of the losses of their pairs."""
    shared = rows.sparkSession.sparkContext.broadcast((classes, losses.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, loss = shared.value
            pairs, row = pairs_of(batch.column("buckets"), table)
            delta = np.zeros(batch.num_rows, np.int64)
            np.add.at(delta, row, loss[pairs])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(delta)], names=["doc_id", "th", "delta"])

    return rows.select("doc_id", "th", F.transform(tokens(F.col("text")), bucket).alias("buckets")).mapInArrow(
        run, "doc_id long, th long, delta long")


def score(docs: DataFrame, losses: DataFrame, total: int, classes: np.ndarray, pairs: np.ndarray, id_col: str = "doc_id",
          text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_tokens_scored and score for every row of ``docs``; ``total`` is the sum of nb, ``pairs``
    the losses of pairs of ``classes``."""
    least = total // hot_rows + 1 if hot_rows else total + 1
    hot = losses.filter(F.col("nb") >= least).select("word", "delta")
    rare = losses.filter(F.col("nb") < least).select("word", "delta")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    said = rows.select("doc_id", "th", F.explode(tokens(F.col("text"))).alias("word")).join(F.broadcast(hot), "word", "left")
    far = said.filter("delta is null").select("doc_id", "th", "word").join(rare, "word")
    parts = said.filter("delta is not null").unionByName(far).select("doc_id", "th", F.lit(0).alias("copies"), F.lit(1).alias("n"), "delta")
    marks = score_pairs(rows, classes, pairs).select("doc_id", "th", F.lit(1).alias("copies"), F.lit(0).alias("n"), "delta")
    sums = parts.unionByName(marks).groupBy(F.col("doc_id").alias("i"), F.col("th").alias("h")).agg(
        F.sum("copies").alias("copies"), F.sum("n").alias("n"), F.sum("delta").alias("delta"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))
    return rows.select("doc_id", "th").join(sums, same, "left").select(
        "doc_id", F.expr("n div copies").alias("n_tokens_scored"),
        F.try_divide(F.col("delta") / NANO, F.col("n")).alias("score"))


def lm_score(docs: DataFrame, labels: DataFrame, hot_rows: int = HOT_ROWS, spell_rows: int = SPELL_ROWS) -> DataFrame:
    """Scores of all documents, with the documents labelled good and not toxic as the target."""
    rows = marked(docs, labels.filter("quality = 1 and coalesce(toxic, 0) = 0"))
    counts = count_words(rows)
    sums = counts.agg(F.sum("nt"), F.sum("nb")).first()
    total = (sums[0] or 0, sums[1] or 0)
    classes = classes_of(counts, total[1])
    pairs = pair_losses(count_pairs(rows, classes))
    return score(docs, word_losses(counts, total, spell_rows), total[1], classes, pairs, hot_rows=hot_rows)
