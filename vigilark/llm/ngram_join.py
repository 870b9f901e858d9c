"""N-gram Jaccard self-join by a token-group matrix, and the components of its links.

A document's set is its distinct n-word shingles (64-bit hashes). Documents with equal sets are
one class (two 64-bit digests); only a class's representative goes on, so exact copies cost one
partial row a task. Then:

1. *Groups.* Classes of like size that share their smallest shingle form a group, split into
   parts of about ``GROUP_ROWS`` classes where it is larger.
2. *Matrix.* A group's token union is stored as (token, group) rows, for the tokens that can
   witness a link: with at least ``o`` of ``n`` tokens shared, any n - o + L tokens taken first
   in one common order hold at least L shared ones. L grows with n. The order puts frequent
   tokens last, so they witness only what nothing rarer does.
3. *Bound.* Groups of compatible sizes that share at least L such tokens are paired if their
   overlap, bounded by the smaller token count in each of ``BUCKETS`` hash buckets of the two
   unions, can reach the threshold. A document then opens a paired group only if its overlap
   with the group's whole union can, and meets the group's members one by one only then, by
   exact set overlap.
4. *Links* inside a task leave it as a spanning forest, and components are joined up over all.

No pair within a group of copies is written out, and nothing is dropped: groups are split, hot
tokens are put last, both without changing what is found. The frequent-token list only orders
tokens; it is counted on every ``ORDER_SAMPLE``-th class and used up to ``ORDER_TOKENS`` tokens.

Defined results: a null text, or one without words, has an empty set and links with nothing;
fewer words than n are one shingle; rows with a null id are counted but link with nothing and
have a null component; rows that repeat an id are one document per distinct set; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilark.llm.common import LOWER, UPPER, gram_hashes, let, saved, shared_dir, small, words
from vigilark.llm.components import components

GROUP_ROWS = 128
#: shared tokens that pair two groups: at least so many (fewer where a set is too small), and one
#: in ``WITNESS_PART`` of what a link needs, so that long texts are not paired by a few phrases
WITNESSES, WITNESS_PART = 2, 32
#: hash buckets of a group's token counts (a power of two)
BUCKETS = 128
#: groups that one task is opened for at a time
PARTNERS = 8
#: witness rows that a task sends at once
SENT_ROWS = 50_000
ORDER_SAMPLE, ORDER_SEEN, ORDER_TOKENS = 16, 8, 200_000
#: most candidate documents whose ids are broadcast; more are joined by shuffle
BROADCAST_IDS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    out = text
    for a, b in zip(UPPER, LOWER, strict=True):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)


def shingle_set(text: Column, n: int) -> Column:
    """The sorted distinct shingle hashes of a text; empty without words."""
    ws = words(lower_ascii(text))
    return F.sort_array(F.array_distinct(let(ws, lambda x: F.when(
        (F.size(x) > 0) & (F.size(x) < n), F.array(F.xxhash64(x))).otherwise(gram_hashes(x, n)))))


def _need(n, percent: int):
    """Fewest shared tokens that a set of n tokens needs in any link."""
    return -(-percent * n // 100)


def _shared_least(need: int) -> int:
    """L: witnesses that two sets must share, for a set that needs ``need`` shared tokens."""
    return min(max(WITNESSES, need // WITNESS_PART), need)


def _witnesses(batches: Iterator[pa.RecordBatch], hot: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Each set's first n - need + L tokens in the common order, with its group, band and L."""
    for batch in batches:
        tokens, counts, kinds = [], [], {}
        bands = batch.column("band").to_pylist()
        lists = batch.column("tokens")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, g in enumerate(batch.column("grp").to_pylist()):
            t = flat[ends[i]:ends[i + 1]]
            need = _need(len(t), percent)
            least = _shared_least(need)
            k = len(t) - need + least
            if len(hot):
                at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                late = hot[at] == t
                t = np.concatenate([t[~late], t[late]])
            tokens.append(t[:k].copy())
            counts.append((kinds.setdefault((g, bands[i], least), len(kinds)), min(k, len(t))))
        if not tokens:
            continue
        kind = np.repeat(*np.array(counts, np.int32).T)
        token = np.concatenate(tokens)
        del tokens
        # by group, so that neighbouring rows are alike and pack well; copies give equal rows, sent once
        order = np.lexsort((token, kind))
        token, kind = token[order], kind[order]
        first = np.append(True, (token[1:] != token[:-1]) | (kind[1:] != kind[:-1]))
        token, kind = token[first], kind[first]
        grp, band, least = np.array(list(kinds), np.int64).T
        for at in range(0, len(token), SENT_ROWS):
            k = kind[at:at + SENT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(token[at:at + SENT_ROWS]), pa.array(grp[k]), pa.array(band[k], pa.int32()),
                                              pa.array(least[k], pa.int32())], names=["token", "grp", "band", "l"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's group and its token counts by bucket."""
    for batch in batches:
        lists = batch.column("tokens")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sigs = [np.bincount(flat[ends[i]:ends[i + 1]] & (BUCKETS - 1), minlength=BUCKETS).astype("<u4").tobytes()
                for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(sigs, pa.binary())], names=["grp", "sig"])


def _envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's largest count by bucket, and its smallest set's size."""
    for batch in batches:
        tops, least = [], []
        for sigs in batch.column("sigs").to_pylist():
            counts = np.stack([np.frombuffer(s, "<u4") for s in sigs])
            top = counts.max(0)
            tops.append(top.astype("<u1" if top.max() < 256 else "<u4").tobytes())
            least.append(int(counts.sum(1).min()))
        yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(tops, pa.binary()), pa.array(least, pa.int64())],
                                         names=["grp", "top", "least"])


def _near_enough(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose overlap, bounded bucket by bucket, can reach what their smallest sets need."""
    def counts(b: bytes) -> np.ndarray:
        return np.frombuffer(b, "<u1" if len(b) == BUCKETS else "<u4").astype(np.int64)

    for batch in batches:
        d = batch.to_pydict()
        keep = [int(np.minimum(counts(a), counts(b)).sum()) >= max(_need(x, percent), _need(y, percent))
                for a, b, x, y in zip(d["top"], d["top2"], d["least"], d["least2"], strict=True)]
        yield batch.select(["grp", "g2"]).filter(pa.array(keep, pa.bool_()))


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: (node, root) for every node that is not a root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up if root(x) != x]


def _open_group(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between a group's members (own) and the classes that open it."""
    pdf = pdf.reset_index(drop=True)  # a repeated row is a member twice, to no effect
    own = pdf[pdf["own"]]
    sets = [np.asarray(t, np.int64) for t in own["tokens"]]
    sizes = np.array([len(t) for t in sets], np.int64)
    ids = own["rep"].to_numpy(np.int64)
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    union, starts = np.unique(flat[order], return_index=True)
    member, ends = member[order], np.append(starts[1:], len(flat))
    links: list[tuple[int, int]] = []
    for is_own, rep, tokens in zip(pdf["own"], pdf["rep"], pdf["tokens"], strict=True):
        t = np.asarray(tokens, np.int64)
        at = np.minimum(np.searchsorted(union, t), len(union) - 1)
        hit = at[union[at] == t]
        if len(hit) < _need(len(t), percent):
            continue  # the whole group shares too little
        runs = ends[hit] - starts[hit]
        where = np.repeat(starts[hit] - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())
        shared = np.bincount(member[where], minlength=len(sets))
        linked = 100 * shared >= percent * (len(t) + sizes - shared)
        links.extend((int(rep), int(x)) for x in ids[linked] if x != rep)
    return pd.DataFrame(_forest(links), columns=["u", "v"], dtype="int64")


def classes(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text",
            *more: Column) -> tuple[DataFrame, DataFrame]:
    """(one row a document: doc_id, n, d1, d2 and ``more``, written with its tokens; one row a
    class: rep, n, d1, d2, low)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingle_set(F.col(text_col), n).alias("tokens"), *more)
    rows = rows.select(*[c for c in rows.columns if c != "tokens"], F.size("tokens").alias("n"), F.xxhash64("tokens").alias("d1"),
                       F.xxhash64(F.lit(1), "tokens").alias("d2"), F.get("tokens", F.lit(0)).alias("low"), "tokens")
    path = shared_dir(docs.sparkSession, "shingles")
    rows.write.option("compression", "none").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    found = rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low"))
    return rows, saved(found)


def links(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Edges u, v between class representatives that connect every linked pair."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    keyed = found.withColumn("band", band)
    count = keyed.groupBy("band", "low").count().filter(F.col("count") > GROUP_ROWS).select(
        F.col("band").alias("b"), F.col("low").alias("w"), F.ceil(F.col("count") / GROUP_ROWS).alias("parts"))
    count = small(saved(count), BROADCAST_IDS)  # at most one row in GROUP_ROWS classes

    def grouped(df: DataFrame) -> DataFrame:
        """``df`` (n, low, d1) with band and grp: a class's group follows from its own set."""
        df = df.withColumn("band", band).join(count, (F.col("band") == F.col("b")) & (F.col("low") == F.col("w")), "left")
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("d1", "parts"))
        return df.withColumn("grp", F.xxhash64("band", "low", part)).drop("b", "w", "parts")

    keyed = saved(grouped(found).select("rep", "d1", "band", "grp"))
    groups = keyed.groupBy("grp").agg(F.count("*").alias("size"))

    seen = rows.filter((F.col("n") > 0) & (F.pmod("d1", F.lit(ORDER_SAMPLE)) == 0)).dropDuplicates(["d1", "d2"])
    hot = seen.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") >= ORDER_SEEN)
    hot = np.sort(np.array([r["t"] for r in hot.orderBy(F.desc("count"), "t").limit(ORDER_TOKENS).select("t").collect()], np.int64))
    # the order of tokens reaches executors as one bounded array
    spread = docs_broadcast(rows, hot)

    def witness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _witnesses(batches, spread.value, percent)

    # copies give equal rows, which are merged before they are sent
    sets = grouped(rows.filter("n > 0")).select("tokens", "grp", "band")
    matrix = sets.mapInArrow(witness, "token long, grp long, band int, l int").repartition("token").distinct()
    # a token of one group pairs nothing
    matrix = saved(matrix.withColumn("df", F.count("*").over(W.partitionBy("token"))).filter("df > 1").drop("df"))
    near = matrix.select("token", F.col("grp").alias("g2"), F.col("band").alias("b2"), F.col("l").alias("l2"),
                         F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    pairs = matrix.join(near, ["token", "band"]).filter((F.col("b2") > F.col("band")) | (F.col("grp") < F.col("g2")))
    pairs = pairs.groupBy("grp", "g2").agg(F.count("*").alias("shared"), F.least(F.min("l"), F.min("l2")).alias("l"))
    pairs = saved(pairs.filter("shared >= l").select("grp", "g2"))
    # before any set is sent: the overlap of two groups is at most the sum of the smaller counts
    # of tokens in each hash bucket
    bound = sets.select("tokens", "grp").mapInArrow(_signatures, "grp long, sig binary").groupBy("grp").agg(
        F.collect_set("sig").alias("sigs")).mapInArrow(_envelopes, "grp long, top binary, least long")
    bound = saved(bound)
    other = bound.select(F.col("grp").alias("g2"), F.col("top").alias("top2"), F.col("least").alias("least2"))
    pairs = pairs.join(bound, "grp").join(other, "g2").select("grp", "g2", "top", "top2", "least", "least2")

    def near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _near_enough(batches, percent)

    pairs = saved(pairs.mapInArrow(near_enough, "grp long, g2 long"))
    inside = groups.filter("size > 1").select("grp", F.col("grp").alias("g2"))

    # a task: group g2 with up to PARTNERS groups that open it
    turn = F.row_number().over(W.partitionBy("g2").orderBy("grp")) - 1
    tasks = pairs.withColumn("turn", F.floor(turn / PARTNERS).cast("int"))
    tasks = saved(tasks.unionByName(inside.withColumn("turn", F.lit(0))))
    owners = tasks.select("g2", "turn").distinct().select(F.col("g2").alias("grp"), "g2", "turn", F.lit(True).alias("own"))
    openers = tasks.filter("grp <> g2").select("grp", "g2", "turn", F.lit(False).alias("own"))
    roles = saved(owners.unionByName(openers))
    members = saved(keyed.join(roles, "grp").select("rep", "d1", "g2", "turn", "own"))
    wanted = small(saved(members.select(F.col("rep").alias("doc_id"), "d1").distinct()), BROADCAST_IDS)
    sets = rows.filter("n > 0").join(wanted, ["doc_id", "d1"]).select(F.col("doc_id").alias("rep"), "d1", "tokens")
    full = members.join(sets, ["rep", "d1"]).select("g2", "turn", "own", "rep", "tokens")

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        return _open_group(pdf, percent)

    return full.groupBy("g2", "turn").applyInPandas(opened, "u long, v long")


def docs_broadcast(df: DataFrame, value: np.ndarray):
    """A bounded array for executors, as a Spark broadcast."""
    return df.sparkSession.sparkContext.broadcast(value)


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    rows, found = classes(docs, n, id_col, text_col)
    joined = components(saved(links(rows, found, percent)))
    found = found.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "d1", "d2").join(
        saved(found), (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component (the smallest id, null ids last, then the
    smallest text hash), columns unchanged. Components are of texts, whatever their ids; of rows
    that repeat id and text one stays (the first by its JSON). Rows without words stay."""
    key = [F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"),
           F.xxhash64(text_col).alias("__th")]
    names = ["__none", "__id", "__th"]
    # a class is represented by one row, numbered as the sets are written
    rows, found = classes(docs.withColumn("__row", F.monotonically_increasing_id()), n, "__row", text_col, *key)
    joined = components(saved(links(rows, found, percent)))
    texts = saved(rows.filter("n > 0").groupBy(*names).agg(F.max("d1").alias("d1"), F.max("d2").alias("d2"),
                                                           F.count("*").alias("copies")))
    first = texts.groupBy("d1", "d2").agg(F.min(F.struct(*names)).alias("first"))
    found = found.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    found = saved(found.join(first, ["d1", "d2"]))
    best = found.groupBy("component").agg(F.min("first").alias("best"))
    best = saved(found.join(best, "component").select("d1", "d2", "best"))
    marks = texts.join(best, ["d1", "d2"]).select(*names, (F.struct(*names) != F.col("best")).alias("__gone"), "copies")
    marks = small(saved(marks.filter("__gone or copies > 1").drop("copies")), BROADCAST_IDS)
    dealt = docs.select("*", *key).join(marks, names, "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = dealt.filter("not __gone").groupBy(*names).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return dealt.filter("__gone is null").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(again)
