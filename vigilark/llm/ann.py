"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

The index splits the vectors by hash into blocks of about ``BLOCK`` rows; a block holds, for each
of ``PROJECTIONS`` random lines, its vectors' projections in sorted order. A query opens a window
around its own projection on every line. Windows widen round by round (virtual rehashing: a wider
window is the union of neighbouring buckets centred on the query), and a vector that lies in at
least ``THRESHOLD`` of the windows is verified by its true cosine. A block's search ends when k
verified vectors are within ``STEP`` times the round's radius, or when the verified share reaches
``ENOUGH``. The blocks' best k are merged, so blocks are independent and none is ever large.

Queries are dealt in chunks of ``CHUNK``; a task holds one block and one chunk. The query set
meets every block, as a search of a stated query set over all rows does.

Cosine is invariant to scale, so vectors are projected at unit length; scores are computed in
double precision on the original values. Defined results: vectors that are null, empty, zero, or
hold null or non-finite values take no part; vectors of another length are another index;
repeated rows of an id are one candidate each (the id is not returned to itself); ties go to the
smaller id; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilark.llm.common import saved

PROJECTIONS, THRESHOLD = 64, 36
FIRST, STEP = 0.3, 1.15
ENOUGH = 0.45
BLOCK, CHUNK = 16_384, 2_048
SEED = 11


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles) and dim of the vectors that take part."""
    v = F.col("v")
    big = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components below 1: cosines stay what they are, to the
    last bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def build_index(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row a block: dim, block, ids, vectors, and the sorted projections with their order."""
    blocks = max(1, -(-rows.count() // block_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = scaled(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        p = (unit @ _lines(x.shape[1])).T
        order = np.argsort(p, axis=1, kind="stable")
        return pd.DataFrame([{"dim": x.shape[1], "block": int(pdf["block"].iloc[0]), "ids": pdf["id"].to_numpy(np.int64).tobytes(),
                              "vectors": x.tobytes(), "values": np.take_along_axis(p, order, 1).tobytes(),
                              "places": order.astype(np.int32).tobytes()}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(int(blocks))).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(
        build, "dim int, block int, ids binary, vectors binary, values binary, places binary")


def search_block(ids: np.ndarray, x: np.ndarray, values: np.ndarray, places: np.ndarray, q_ids: np.ndarray,
                 q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of each query's best k found in one block."""
    n = len(ids)
    norms = np.linalg.norm(x, axis=1)
    q_norms = np.linalg.norm(q, axis=1)
    centre = (q / q_norms[:, None]) @ _lines(x.shape[1])
    out = []
    for i in range(len(q)):
        counts, score = np.zeros(n, np.int64), np.full(n, -np.inf)
        verified = np.zeros(n, bool)
        low = high = None
        radius = FIRST
        others = n - int(np.count_nonzero(ids == q_ids[i]))
        while True:
            a = np.array([np.searchsorted(v, c - radius, "left") for v, c in zip(values, centre[i], strict=True)])
            b = np.array([np.searchsorted(v, c + radius, "right") for v, c in zip(values, centre[i], strict=True)])
            if low is None:
                new = [places[j, a[j]:b[j]] for j in range(len(values))]
            else:
                new = [places[j, a[j]:low[j]] for j in range(len(values))] + [places[j, high[j]:b[j]] for j in range(len(values))]
            counts += np.bincount(np.concatenate(new), minlength=n)
            low, high = a, b
            found = np.flatnonzero((counts >= THRESHOLD) & ~verified)
            if len(found):
                verified[found] = True
                score[found] = (x[found] @ q[i]) / (norms[found] * q_norms[i])
                score[found[ids[found] == q_ids[i]]] = -np.inf
            seen = int(np.count_nonzero(score > -np.inf))
            near = np.partition(score, -k)[-k] if seen >= k else -np.inf
            if seen >= min(k, others) and (2 - 2 * near <= (STEP * radius) ** 2 or seen >= ENOUGH * n or seen == others) or radius > 16:
                break
            radius *= STEP
        best = np.lexsort((ids, -score))[:k]
        out.extend((int(q_ids[i]), int(ids[j]), float(score[j])) for j in best if score[j] > -np.inf)
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
            block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every vector whose id is divisible
    by ``every``, among all the others."""
    rows = saved(usable(vectors, id_col, vec_col))
    index = saved(build_index(rows, block_rows))
    asked = rows.filter(F.col("id") % every == 0)
    chunks = max(1, -(-asked.count() // CHUNK))
    blocks = index.select(F.col("dim").alias("d"), (F.col("block") + 0).alias("b"))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(int(chunks))).cast("int"))
    sent = asked.join(blocks, F.col("dim") == F.col("d")).select("dim", F.col("b").alias("block"), "chunk", "id", "v")
    spread = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(int(chunks) - 1))))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if block.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(names, ("int64", "int64", "float64"), strict=True)})
        r = block.iloc[0]
        ids = np.frombuffer(r["ids"], np.int64)
        n = len(ids)
        found = search_block(ids, np.frombuffer(r["vectors"]).reshape(n, -1), np.frombuffer(r["values"]).reshape(PROJECTIONS, n),
                             np.frombuffer(r["places"], np.int32).reshape(PROJECTIONS, n), queries["id"].to_numpy(np.int64),
                             scaled(np.stack(queries["v"].to_numpy()).astype(np.float64)), k)
        return pd.DataFrame(found, columns=names)

    keys = ("dim", "block", "chunk")
    found = spread.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
