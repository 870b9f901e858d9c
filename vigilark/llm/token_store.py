"""Token-ID output: documents as zstandard frames that share one trained dictionary.

The dictionary is trained on a bounded sample of serialized id arrays (about ``SAMPLE`` passages
of ``SAMPLE_CHARS`` characters, drawn by hash from whole texts); each document's ids are
compressed separately, so a short document is read alone. Documents are range-partitioned by id
and sorted; every task encodes its range and writes one shard:

    magic | dictionary hash | frame .. frame | index | index offset, number of documents

The index has each document's id, frame offset, frame length, number of ids and a null flag. A
shard is written under an attempt's own name and then renamed, so a task that is lost and rerun
leaves one complete shard. The manifest (one row a shard) is a Parquet table beside the shards
with the dictionary's hash; a reader refuses frames of another dictionary.

Files go through ``pyarrow.fs``, to the shared folder that the session names.

Defined results: a null text is an empty one (the end id alone); null ids sort first; repeated
rows are separate documents, ordered by id, then text; a very long text is one frame; only id
and text are read; an empty table gives a manifest with empty shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilark.llm.common import passages_of, sample_passages, shared_dir
from vigilark.llm.tokens import encoder

MAGIC = b"VKTOKEN1"
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: bytes of text a shard, on average
SHARD_BYTES = 32_000_000
#: dictionary: sampled passages, their characters, and its size
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 400, 16_000, 64 * 1024
LEVEL = 3
ENTRY, FOOTER = "<qQQQ?", "<QQ"
END = struct.pack("<I", END_ID)


def _fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def measure(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(bytes, passages) of all texts."""
    return tuple(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)),
                          F.coalesce(F.sum(passages_of(F.col(text_col), SAMPLE_CHARS)), F.lit(0))).first())


def train_dictionary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str = TOKENIZER,
                     added: bool = False, passages: int | None = None) -> bytes:
    """A dictionary from about ``SAMPLE`` passages of whole texts. Too few samples to train on
    become the dictionary themselves. ``passages``: how many there are, if known."""
    import zstandard
    texts = docs.select(F.lit("").alias("grp"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n = measure(docs, text_col)[1] if passages is None else passages
    samples = [encoder(tokenizer, False, added).encode(t) for _, t in sample_passages(texts, {"": n}, SAMPLE, SAMPLE_CHARS)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(raw: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_shards(docs: DataFrame, folder: str, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = TOKENIZER, added: bool = False, size: int | None = None) -> DataFrame:
    """Write the shards and the manifest (``size``: bytes of all texts, if known); returns the manifest (shard, path, n_docs, n_tokens, start)."""
    digest = hashlib.sha256(dictionary).digest()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(1, -(-(measure(docs, text_col)[0] if size is None else size) // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        ctx = TaskContext.get()
        shard, fs_path = ctx.partitionId(), _fs(folder)
        fs, root = fs_path
        fs.create_dir(root, recursive=True)
        tool, bpe = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)), encoder(tokenizer, False, added)
        path = f"{root}/shard-{shard:06d}.vkt"
        attempt = f"{path}.attempt-{ctx.taskAttemptId()}"
        index, n_tokens = [], 0
        with fs.open_output_stream(attempt, compression=None) as out:
            out.write(MAGIC + digest)
            at = len(MAGIC) + len(digest)
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = bpe.encode(text.as_py()) + END
                    frame = tool.compress(ids)
                    out.write(frame)
                    index.append(struct.pack(ENTRY, doc_id or 0, at, len(frame), len(ids) // 4, doc_id is None))
                    at += len(frame)
                    n_tokens += len(ids) // 4
            out.write(b"".join(index))
            out.write(struct.pack(FOOTER, at, len(index)))
        fs.move(attempt, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(index)], "n_tokens": [n_tokens]},
                                         schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # the range bounds are sampled from the table itself, before anything is encoded
    dealt = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    manifest = dealt.mapInArrow(write, "shard long, n_docs long, n_tokens long")
    path = f"{folder}/manifest"
    manifest.withColumn("dictionary_sha256", F.lit(digest.hex())).withColumn(
        "dictionary", F.lit(dictionary)).write.parquet(path)
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    m = spark.read.parquet(f"{folder}/manifest").drop("dictionary")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    return m.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_index(fs, path: str) -> tuple[object, bytes, list[tuple]]:
    """An open shard, its dictionary hash and its index entries."""
    f = fs.open_input_file(path)
    head = f.read(len(MAGIC) + 32)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{path} is no token shard")
    f.seek(f.size() - struct.calcsize(FOOTER))
    at, n = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
    f.seek(at)
    return f, head[len(MAGIC):], list(struct.iter_unpack(ENTRY, f.read(n * struct.calcsize(ENTRY))))


def read_document(folder: str, shard: int, n: int, dictionary: bytes) -> bytes:
    """The ids of the n-th document of a shard, read alone."""
    import zstandard
    fs, root = _fs(folder)
    f, digest, index = read_index(fs, f"{root}/shard-{shard:06d}.vkt")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    _, at, length, n_ids, _ = index[n]
    f.seek(at)
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(f.read(length), max_output_size=4 * n_ids)


def read_shards(spark: SparkSession, folder: str, dictionary: bytes, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, as bytes)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                      + ([("ids", pa.binary())] if with_ids else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        fs, root = _fs(folder)
        tool = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f, digest, index = read_index(fs, f"{root}/shard-{shard:06d}.vkt")
                if digest != hashlib.sha256(dictionary).digest():
                    raise ValueError("the shard was written with another dictionary")
                f.seek(len(MAGIC) + 32)  # frames lie in index order
                for i in range(0, len(index), 500):
                    out: list[list] = [[] for _ in arrow]
                    for doc_id, _, length, n_ids, null in index[i:i + 500]:
                        ids = tool.decompress(f.read(length), max_output_size=4 * n_ids)
                        for col, v in zip(out, (None if null else doc_id, start, n_ids, zlib.crc32(ids), ids), strict=False):
                            col.append(v)
                        start += n_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)
                f.close()

    manifest = read_manifest(spark, folder).select("shard", "start")
    n = max(1, manifest.count())  # one row a shard
    return manifest.repartition(n, "shard").mapInArrow(read, schema)


def token_store(docs: DataFrame, folder: str | None = None, added: bool = False) -> DataFrame:
    """Write ``docs`` as shards (a new shared folder unless one is named) and read them back.
    ``added``: the literal content of an added token in a text is that token."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-store")
    size, passages = measure(docs)
    dictionary = train_dictionary(docs, added=added, passages=passages)
    write_shards(docs, folder, dictionary, added=added, size=size)
    return read_shards(spark, folder, dictionary)
