"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression over the whole text, and every rule of the table is a
range on one metric; the compiled verdict is their conjunction. No user function, no shuffle:
one pass over the text, so a document's cost depends on that document alone.

Defined results: a null text is a text without words; it and an empty text have zero in every
count and fail the base rules. Other columns of the input, whatever their names, are not read;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import SPACES, count_of, gram_hashes, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Common function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was",
    "der", "die", "das", "und", "in", "zu", "den", "von",
    "de", "la", "le", "et", "les", "des", "un", "que",
    "el", "los", "en", "y", "las", "del", "se", "no",
)


class Rule(NamedTuple):
    """``metric`` must lie in [``low``, ``high``]; None leaves that side open."""

    metric: str
    low: float | None
    high: float | None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("exclamations_per_word", None, 0.3),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)

#: base rules: fewest words, and most per cent of words in repeated 8-word windows
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeat_words(ws: Column) -> Column:
    """Words lying in a ``WINDOW``-word window that the text has more than once (windows are
    compared by a 64-bit hash). Texts whose windows all differ stop after the first test."""
    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)),
                          lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            same = F.filter(o, lambda x, j: ((j > 0) & (F.get(o, j - 1)["h"] == x["h"]))
                            | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        found = let(let(order, starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    return let(gram_hashes(ws, WINDOW), repeated)


def counts(text: Column) -> Column:
    """A struct of every count that a metric or an output column is made of."""
    body = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        stop = F.filter(ws, lambda w: w.isin(*dict.fromkeys(STOP_WORDS + tuple(x.capitalize() for x in STOP_WORDS))))
        n = lambda c: c.cast("long")
        return let(lines, lambda ls: F.struct(
            n(F.size(ws)).alias("n_words"), n(F.length(body) - count_of(body, SPACES)).alias("word_chars"),
            n(count_of(body, SYMBOLS)).alias("n_symbols"),
            n(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            n(repeat_words(ws)).alias("n_repeat_words"),
            n(F.size(ls)).alias("n_lines"), n(F.size(stop)).alias("n_stop"),
            n(count_of(body, "!")).alias("n_exclaim"),
            n(F.size(F.filter(ls, lambda x: F.ltrim(x).rlike(r"^[\-*•]\s")))).alias("n_bullet"),
            n(F.size(F.filter(ls, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")))).alias("n_ellipsis")))

    return let(words(text), of)


def metrics(c: Column) -> dict[str, Column]:
    """The metrics by name, from a struct of ``counts``; 0 where the denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(c[a], c[b]), F.lit(0.0))
    return {
        "n_words": c["n_words"].cast("double"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "exclamations_per_word": ratio("n_exclaim", "n_words"),
        "stop_word_share": ratio("n_stop", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "bullet_line_share": ratio("n_bullet", "n_lines"),
        "ellipsis_line_share": ratio("n_ellipsis", "n_lines"),
    }


def verdict(by_name: Mapping[str, Column], rules: Sequence[Rule]) -> Column:
    """All rules of the table hold."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (by_name[r.metric] >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (by_name[r.metric] <= F.lit(float(r.high)))
    return out


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row a document: its counts, its metrics, ``base_failed`` and ``kept``."""
    counted = docs.select(F.col(id_col), counts(F.col(text_col)).alias("c"))
    c = F.col("c")
    base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    by_name = metrics(c)
    return counted.select(
        F.col(id_col), *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"), (~base & verdict(by_name, rules)).alias("kept"),
        *(v.alias(k) for k, v in by_name.items() if k != "n_words"))
