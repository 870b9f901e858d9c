"""Small Column and DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.session import checkpoint_root, shared_dir  # noqa: F401

#: the white space that separates words: space and U+0009 .. U+000D
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def gram_hashes(ws: Column, n: int) -> Column:
    """The 64-bit hashes of all runs of ``n`` words, by position; none if there are fewer words.
    Runs are hashed by doubling (1, 2, 4 .. words), so a run costs log2(n) small hashes."""
    def step(cur: Column, size: int) -> Column:
        if size == n:
            return F.slice(cur, 1, F.greatest(F.size(ws) - (n - 1), F.lit(0)))
        add = min(size, n - size)
        if add == size:
            return let(F.zip_with(cur, F.slice(cur, size + 1, F.size(cur)), lambda a, b: F.xxhash64(a, b)),
                       lambda x: step(x, size * 2))
        rest = F.slice(gram_hashes(ws, add), size + 1, F.size(ws))
        return let(F.zip_with(cur, rest, lambda a, b: F.xxhash64(a, b)), lambda x: step(x, n))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda x: step(x, 1))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars`` (ASCII; byte-wise search and replace,
    several times faster than ``translate``)."""
    lost = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(lost[1:], lost[0])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def passages_of(text: Column, chars: int) -> Column:
    """How many passages of ``chars`` characters a text has; 0 for a null or empty one."""
    return F.coalesce(F.ceil(F.char_length(text) / chars), F.lit(0)).cast("long")


def sample_passages(texts: DataFrame, passages: dict[str, int], k: int, chars: int) -> list[tuple[str, str]]:
    """(grp, passage) of about ``k`` passages a group, in hashed order. ``texts``: grp, id, text;
    ``passages``: how many passages each group has. Whole texts are cut into passages of ``chars``
    characters, and a passage is taken if its hash is below the bound that lets ``k`` of its
    group's passages through. So a task and the driver get about ``k`` passages a group, however
    many rows or partitions there are; repeated rows are taken once."""
    share = [(g, -(2 ** 63) + (2 ** 64 - 1) * min(k, n) // n) for g, n in sorted(passages.items()) if n]
    if not share:
        return []
    bounds = texts.sparkSession.createDataFrame(share, "g string, bound long")
    rows = texts.join(F.broadcast(bounds), F.col("grp") == F.col("g")).withColumn("n", passages_of(F.col("text"), chars)).filter("n > 0")

    def drawn(th: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
                            lambda i: F.struct(i.alias("i"), F.xxhash64(F.col("id"), th, i).alias("h")))
        return F.transform(F.filter(every, lambda x: x["h"] <= F.col("bound")), lambda x: F.struct(
            x["h"].alias("h"), F.substr(F.col("text"), (x["i"] * chars + 1).cast("int"), F.lit(chars)).alias("passage")))

    picked = rows.select("grp", F.explode(let(F.xxhash64("text"), drawn)).alias("x"))
    found = picked.groupBy("grp", "x.h").agg(F.min("x.passage").alias("passage")).collect()  # about k a group
    return [(r["grp"], r["passage"]) for r in sorted(found, key=lambda r: (r["grp"], r["h"]))]


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the session's shared folder."""
    checkpoint_root(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (already saved) marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
