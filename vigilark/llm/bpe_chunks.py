"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash over their characters says so, so a passage that two
documents share is cut alike in both, wherever it stands. A chunk found in more than one place is
encoded once, by the text that owns its first place (the smallest text key); every other place takes
the owner's ids. Chunks found once are encoded where they are.

A cut may split a word, so a chunk's ids near its ends need not be the document's. Every join is
repaired: the words around it are encoded again as one zone, which reaches one whole word further on
each side. That word's ids must be the same in the zone and at the end of the chunk (exact agreement);
if they are not, the zone grows by a word and is encoded again, at most to the whole text. Zones that
meet become one. Ids of the document: chunk insides and zones, in turn.

A zone may begin and end after a space or line feed only, which is sound for tokenizers that drop white
space before they split into words; ``ChunkEncoder`` refuses others. Ids are then those of the
``tokenizers`` library for the whole text, with truncation and padding unused.

What moves: the distinct texts once, by text key (repeats meet map-side, so a text that a third of the
rows share costs one row a partition); a row of 60 bytes a chunk; the ids of shared chunks. One plan
reads the moved texts twice, by exchange reuse. No table is broadcast by this module. The ids of a
chunk that very many texts share are replicated in proportion to its count, so none of its tasks sees
more than ``PLACES`` of its places. Chunks and texts are told apart by 128-bit digests.

Inputs: a null or empty text has no ids, and decodes to the empty text. Very long texts are worked on
whole, one at a time; a text without spaces becomes one zone, encoded once. Rows with null or repeated
``doc_id`` each give a row. Other columns are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import saved
from vigilark.llm.tokens import encoder

TOKENIZER = "word_bpe_49k.json"
#: characters a chunk holds: at least, at most, and (2 to this power, beyond the least) on average
LEAST, MOST, BITS = 256, 8192, 10
#: characters that the rolling hash sees
WINDOW = 32
#: places of one shared chunk that a task joins at most
PLACES = 5_000
EMPTY = hashlib.sha256(b"").hexdigest()


def cuts(text: str, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Where the text is cut, 0 and its length included. A cut depends on the ``WINDOW`` characters
    before it and on the cut before (not nearer than ``least``, not farther than ``most``)."""
    g = np.frombuffer(text.encode("utf-32-le"), "<u4") * np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA77)
    size = 1
    while size < WINDOW:            # the hash of the last 2 * size characters from two of size
        wider = g.copy()
        wider[size:] += g[:-size] << np.uint32(size)
        g, size = wider, 2 * size
    out = [0]
    for p in (np.flatnonzero((g >> np.uint32(32 - bits)) == 0) + 1).tolist():
        while p - out[-1] > most:
            out.append(out[-1] + most)
        if p - out[-1] >= least:
            out.append(p)
    while len(text) - out[-1] > most:
        out.append(out[-1] + most)
    if out[-1] != len(text):
        out.append(len(text))
    return out


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


class ChunkEncoder:
    """Encodes a text from the ids of its chunks, and decodes ids, by the library's rules."""

    def __init__(self, name: str = TOKENIZER):
        self.pieces = encoder(name, lower=True, added=True)
        self.tool = self.pieces.tool
        self.tool.no_truncation()
        self.tool.no_padding()
        parts = [self.tool.encode(t, add_special_tokens=False).ids for t in ("a b\nc", "a", "b", "c")]
        if parts[0] != parts[1] + parts[2] + parts[3]:
            raise ValueError(f"{name} keeps white space: its words can't be told apart at spaces")
        # without a decoder of its own the library joins the tokens with spaces
        self.shown = None
        if self.tool.decoder is None:
            self.shown = [self.tool.id_to_token(i) for i in range(self.tool.get_vocab_size())]

    def ids(self, text: str) -> bytes:
        """The library's ids of a text by itself, as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(text) if text else b""

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.shown is not None:
            return " ".join(map(self.shown.__getitem__, numbers))
        return self.tool.decode(numbers, skip_special_tokens=False)

    def whole(self, text: str, known: dict[int, bytes], at: list[int] | None = None) -> bytes:
        """The ids of the whole text; ``known``: those of chunks already encoded, by chunk number."""
        at = cuts(text) if at is None else at
        if len(at) <= 2:
            return known.get(0) or self.ids(text)
        chunks: dict[int, bytes] = {}

        def chunk(i: int) -> bytes:
            if i not in chunks:
                chunks[i] = known.get(i) or self.ids(text[at[i]:at[i + 1]])
            return chunks[i]

        zones = [self._around(text, c) for c in at[1:-1]]
        while True:
            zones = merged(zones)
            fixed = [self.ids(text[z.start:z.end]) for z in zones]
            grown = [self._agreed(text, at, chunk, z, ids) for z, ids in zip(zones, fixed)]
            if grown == zones:
                break
            zones = grown
        out, done = [], 0
        for z, ids in zip([*zones, Zone(len(text), len(text), len(text), len(text))], [*fixed, b""]):
            if z.start > done:      # the inside of the one chunk between two zones
                i = bisect_right(at, done) - 1
                before, after = self.ids(text[at[i]:done]), self.ids(text[z.start:at[i + 1]])
                mine = chunk(i)
                out.append(mine[len(before):len(mine) - len(after)])
            out.append(ids)
            done = max(done, z.end)
        return b"".join(out)

    def _around(self, text: str, cut: int) -> "Zone":
        """The zone of a cut: the word it stands in, and a whole word more on each side."""
        left, right = back(text, cut), ahead(text, cut)
        return Zone(back_word(text, left), left, right, ahead_word(text, right))

    def _agreed(self, text: str, at: list[int], chunk, z: "Zone", ids: bytes) -> "Zone":
        """``z`` if the zone's ids agree with the chunks on its first and last word, else a wider one."""
        start, end = z.start, z.end
        if start > 0:
            i = bisect_right(at, start) - 1
            word = self.ids(text[start:z.left])
            tail = self.ids(text[start:at[i + 1]])
            if not (ids.startswith(word) and tail.startswith(word) and chunk(i).endswith(tail)):
                start = back_word(text, start)
        if end < len(text):
            i = bisect_left(at, end) - 1
            word = self.ids(text[z.right:end])
            head = self.ids(text[at[i]:end])
            if not (ids.endswith(word) and head.endswith(word) and chunk(i).startswith(head)):
                end = ahead_word(text, end)
        if (start, end) == (z.start, z.end):
            return z
        return Zone(start, z.start if start < z.start else z.left, z.end if end > z.end else z.right, end)


class Zone(tuple):
    """A stretch of text to encode again: ``start <= left <= right <= end``; [start, left) and
    [right, end) are the words on which it must agree with the chunks."""

    def __new__(cls, start: int, left: int, right: int, end: int):
        return super().__new__(cls, (start, left, right, end))

    start, left, right, end = (property(lambda z, i=i: z[i]) for i in range(4))


def merged(zones: list[Zone]) -> list[Zone]:
    out: list[Zone] = []
    for z in zones:
        if out and z.start < out[-1].end:
            last = out.pop()
            z = Zone(last.start, last.left, max(last.right, z.right), max(last.end, z.end))
        out.append(z)
    return out


def back(text: str, p: int) -> int:
    """The last place at or before ``p`` that follows a space or line feed (or the text's start)."""
    return max(text.rfind(" ", 0, p), text.rfind("\n", 0, p)) + 1


def ahead(text: str, p: int) -> int:
    """The first place at or after ``p`` that follows a space or line feed (or the text's end)."""
    hits = [q for q in (text.find(" ", max(p - 1, 0)), text.find("\n", max(p - 1, 0))) if q >= 0]
    return min(hits) + 1 if hits else len(text)


def back_word(text: str, p: int) -> int:
    """Like ``back``, but with at least one character other than space or line feed in between."""
    while p > 0 and text[p - 1] in " \n":
        p -= 1
    return back(text, p)


def ahead_word(text: str, p: int) -> int:
    while p < len(text) and text[p] in " \n":
        p += 1
    return ahead(text, p + 1) if p < len(text) else p


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


GRID = "k binary, i int, h binary"


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text key, chunk number, chunk digest) of every chunk."""
    for b in batches:
        k, i, h = [], [], []
        for key, text in zip(b["k"].to_pylist(), b["text"].to_pylist()):
            at = cuts(text)
            k += [key] * (len(at) - 1)
            i += range(len(at) - 1)
            h += [digest(text[x:y]) for x, y in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(i, pa.int32()), pa.array(h, pa.binary())],
                                         ["k", "i", "h"])


def _own(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the shared chunks that a text owns."""
        code = ChunkEncoder(name)
        for b in batches:
            h, n, ids = [], [], []
            for text, own in zip(b["text"].to_pylist(), b["own"].to_pylist()):
                at = cuts(text)
                for o in own:
                    h.append(o["h"])
                    n.append(o["n"])
                    ids.append(code.ids(text[at[o["i"]]:at[o["i"] + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                                             ["h", "n", "ids"])
    return run


def _assemble(name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ChunkEncoder(name)
        for b in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for text, known in zip(b["text"].to_pylist(), b["known"].to_pylist()):
                ids = code.whole(text, {x["i"]: x["ids"] for x in known or ()})
                back = code.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                kept += [(ids, back)] if with_ids else []
            cols = [b["k"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([x for x, _ in kept], pa.binary()), pa.array([x for _, x in kept], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def shared_chunks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` (k, text) -> every chunk (k, i, h), and the chunks that stand in more than one place
    (h, owner's k and i, n: about how many places). A text that repeats is one place."""
    grid = saved(texts.mapInArrow(_grid, GRID))
    place = F.struct("k", "i")
    shared = (grid.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("first") != F.col("last"))
              .select("h", F.col("first.k").alias("k"), F.col("first.i").alias("i"), "n"))
    return grid, saved(shared)


def encode_texts(texts: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Distinct texts of ``texts`` (k: its key, text: not empty) -> k, n_tokens, ids_sha256,
    decoded_sha256, and with ``with_ids`` the ids (binary) and the decoded text too."""
    grid, shared = shared_chunks(texts)
    moved = texts.groupBy("k").agg(F.first("text").alias("text"))
    own = shared.groupBy("k").agg(F.collect_list(F.struct("h", "i", "n")).alias("own"))
    ids = (moved.join(own, "k").select("text", "own").mapInArrow(_own(tokenizer), "h binary, n bigint, ids binary")
           .select("h", "ids", F.explode(F.sequence(F.lit(0), (F.col("n") / PLACES).cast("int"))).alias("part")))
    # tiny rows: a place learns its chunk's count from one of 16 copies of the count
    salt = F.pmod(F.xxhash64("k", "i"), F.lit(16)).cast("int")
    counts = shared.select("h", F.col("k").alias("k1"), F.col("i").alias("i1"), "n",
                           F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    places = (grid.withColumn("salt", salt).join(counts, ["h", "salt"])
              .filter((F.col("k") != F.col("k1")) | (F.col("i") != F.col("i1")))
              .select("h", "k", "i", F.pmod(F.xxhash64("k", "i", F.lit(1)), (F.col("n") / PLACES).cast("int") + 1)
                      .cast("int").alias("part")).distinct())
    known = places.join(ids, ["h", "part"]).groupBy("k").agg(F.collect_list(F.struct("i", "ids")).alias("known"))
    schema = "k binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return (moved.join(known, "k", "left").select("k", "text", "known")
            .mapInArrow(_assemble(tokenizer, with_ids), schema + (", ids binary, decoded string" if with_ids else "")))


def chunk_encode(docs: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex; of the ids as
    little-endian unsigned 32-bit integers, and of the decoded text in UTF-8); ``with_ids`` adds
    ``ids`` and ``decoded`` themselves."""
    rows = docs.select("doc_id", "text").withColumn("k", key_of(F.coalesce("text", F.lit(""))))
    full = F.length("text") > 0
    # the join on k asks for a key that is not null: said here, all readers of the texts share one exchange
    done = encode_texts(rows.filter(full & F.col("k").isNotNull()).select("k", "text"), tokenizer, with_ids)
    out = rows.filter(full).select("doc_id", "k").join(done, "k").drop("k")
    none = rows.filter(~F.coalesce(full, F.lit(False))).select(
        "doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(EMPTY).alias("ids_sha256"),
        F.lit(EMPTY).alias("decoded_sha256"),
        *([F.lit(b"").alias("ids"), F.lit("").alias("decoded")] if with_ids else []))
    return out.unionByName(none)
