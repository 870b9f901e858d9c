"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of training texts in that language.
A text is put in lower case and stripped to its letters, then cut into chunks; every chunk is compressed with every dictionary, and the language
whose dictionary gives the smallest total wins. The margin between the best two, as a share of
the second, is the score; texts with a margin below ``min_margin`` are marked ``rejected``
(the prediction still stands in ``lang_pred``, for users that want one).

Learning reads labelled rows only and is bounded by parameters: whole texts are cut into
passages of ``PASSAGE`` characters, about ``SAMPLE`` of a language's passages are drawn by
hash, wherever they lie, and fill up to ``DICT_BYTES`` bytes. Predicting is one
pass of Arrow batches: no shuffle, and the whole text of every row counts. A task holds one
batch and one dictionary a language.

Letters are the characters of the Unicode categories L; marks (M), such as vowel signs, stay with them.

Defined results: a null text, or one without letters, gives ``und`` with score 0; with no
training rows every text is ``und``, and an empty table gives no rows; a very long text is
compressed chunk by chunk; ties go to the language first by code point; repeated
rows are predicted alike; only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import passages_of, sample_passages

#: passages drawn a language, and their characters
SAMPLE, PASSAGE = 200, 4096
DICT_BYTES = 96 * 1024
CHUNK = 4096
LEVEL = 6
MIN_MARGIN = 0.01


#: what is neither letter nor mark carries symbols and layout, not language: it becomes one space
NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """The text as it is compressed: lower case, letters and marks only, single spaces; nothing
    for a text without letters."""
    if not LETTER.search(text):
        return b""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(0).cast("long"))


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows of ``train`` with a text and a language. The
    driver gets about ``sample`` passages a language."""
    texts = train.select(F.col(lang_col).alias("grp"), F.col(id_col).cast("string").alias("id"),
                         F.col(text_col).alias("text")).filter("grp is not null")
    counts = texts.groupBy("grp").agg(F.sum(passages_of(F.col("text"), PASSAGE)).alias("n")).collect()  # a row a language
    out: dict[str, bytes] = {}
    for lang, passage in sample_passages(texts, {r["grp"]: r["n"] for r in counts}, sample, PASSAGE):
        got = out.get(lang, b"")
        if len(got) < dict_bytes:
            out[lang] = got + plain(passage)[: dict_bytes - len(got)] + b" "
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected for every row."""
    langs = sorted(dictionaries)
    content = [dictionaries[x] for x in langs]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        tools = []
        for raw in content:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                  write_checksum=False, write_dict_id=False))
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                body = text.as_py()
                data = plain(body or "")
                if not tools or not data:
                    found.append("und")
                    scores.append(0.0)
                    continue
                chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
                sizes = [sum(len(t.compress(c)) for c in chunks) for t in tools]
                best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
                second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
                found.append(langs[best])
                scores.append((second - sizes[best]) / second if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < min_margin))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn on the documents outside fold 2, predict all: doc_id, held_out, lang_pred, score, rejected."""
    out = identify(docs, learn(docs.filter(fold() != 2)))
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "rejected")
