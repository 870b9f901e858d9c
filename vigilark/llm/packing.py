"""Best-fit packing with bound-certified repacking.

Documents are tokenized; those over the capacity are cut into full pieces and a last, shorter
one. Full pieces are sequences by themselves. The rest are dealt by hash into partitions of
about ``PART_ROWS`` pieces, and each partition is packed by best-fit decreasing. Dual-feasible
functions give a lower bound on each partition's sequences: a partition that meets its bound is
proven optimal. Those with a gap release their emptiest sequences; released pieces of all such
partitions are pooled, dealt anew and packed again, and the new packing stands where it needs
fewer sequences than were released.

Only lengths travel (a few dozen bytes a piece, not ids or text). A task holds one Arrow batch
of texts, or one partition's lengths; the deal is by hash, so no source or group is hot.

Defined results: a null text is empty (the end id alone); null ids are documents of their own;
repeated rows are packed each on its own; only id and text are read; an empty table gives no
sequences.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import saved
from vigilark.llm.tokens import encoder

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
PART_ROWS = 25_000
#: share of a gap partition's sequences that it releases, emptiest first (at least two)
RELEASE = 0.05
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
             end_id: int = END_ID, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. ``added``: the literal content of
    an added token in a text is that token."""
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, True, added)
        for batch in batches:
            out: list[list[int]] = [[] for _ in schema]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py()) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for col, v in zip(out, (doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and each bin's free space. Ties go to the earlier length and
    to the bin opened last among those equally free."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    levels: list[int] = []  # the free spaces that some open bin has, rising
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(levels, n)
        if at < len(levels):
            space = levels[at]
            b = by_free[space].pop()
            if not by_free[space]:
                del levels[at]
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        left = space - n
        free[b] = left
        if left:
            stack = by_free.setdefault(left, [])
            if not stack:
                insort(levels, left)
            stack.append(b)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual-feasible functions: with a
    threshold (long lengths count as a whole bin, short ones as nothing), and by rounding."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    long = n[-1] - n[capacity - a]
    mid = total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int(np.max(-(-(long * capacity + mid) // capacity)))
    for k in range(2, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)  # k times the function
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def _pack_round(rows: DataFrame, n: int, number: int, capacity: int, last: bool) -> DataFrame:
    """``rows`` dealt into partitions and packed: plus sequence_id, offset, released, bound, bins."""
    parts = max(1, -(-n // PART_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        out = np.zeros(len(free), bool)
        if len(free) > bound and not last:
            k = max(2, int(len(free) * RELEASE))
            out[np.argsort(-free, kind="stable")[:k]] = True
        base = (number << 56) + (int(pdf["part"].iloc[0]) << 32)
        return pdf.assign(sequence_id=base + bins, offset=offsets, released=out[bins])[
            ["doc_id", "piece", "start", "length", "ids_crc32", "key", "sequence_id", "offset", "released"]].assign(
                bound=bound, bins=len(free))

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "piece", F.lit(number)), F.lit(int(parts))))
    return dealt.groupBy("part").applyInPandas(
        pack, PIECES.replace("doc_id long", "doc_id long", 1) + ", key long, sequence_id long, offset long, released boolean, bound long, bins long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (as from ``tokenize``) with sequence_id and offset."""
    pieces = saved(pieces.withColumn("key", F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id())))
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.lit((ROUNDS + 1) << 56) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done, todo = [full], pieces.filter(F.col("length") < capacity)
    for number in range(ROUNDS):
        n = todo.count()
        if not n:
            break
        packed = saved(_pack_round(todo, n, number, capacity, number == ROUNDS - 1))
        if number:  # the new packing stands only if it saves sequences
            before, after = (x.agg(F.count_distinct("sequence_id")).first()[0] for x in (todo, packed))
            if after >= before:
                done.append(todo.select(cols))
                break
        done.append(packed.filter("not released").select(cols))
        todo = saved(packed.filter("released").drop("released", "bound", "bins"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def best_fit_packing(docs: DataFrame, **names) -> DataFrame:
    """Tokenize and pack ``docs``: one row a piece."""
    return pack_pieces(tokenize(docs, **names))
