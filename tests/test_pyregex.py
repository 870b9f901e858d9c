"""Translated patterns find what Python finds, on class-heavy random patterns."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from vigilark.functions.pyregex import UnsupportedPattern, to_java_regex

ATOMS = ["a", "b", "B", "1", "½", "é", ".", r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", r"\b", r"\B", "^", "$", r"\A", r"\Z", "[ab]",
         "[^a]", "[a&&b]", "[[a]", "[]a]", "[^]a]", r"[a-c\d]", r"[\W\d]", r"[^\Wb]", r"[^\S\d]", r"\.", r"\\", r"\v", r"\x41",
         r"\012", r"\n", "(a)", "(?:ab)", "(?P<n>b)", "(a|b1)", "(?=a)", "(?!b)", "(?<=a)", "(?<!1)", "(?i:a)", "(?-i:a)",
         "(?s:.)", "(?m:^)", "(?m:$)", "(?>a+)", "{", "}", "{2", "#", " ", "(?#c)", "&&", r"[\b]", "[-a]", r"[a\-z]", "~"]
REPEATS = ["", "", "", "", "*", "+", "?", "{2}", "{,2}", "{1,}", "*?", "??"]
TEXTS = ["", "a", "b", "ab", "aB1", "b\n", "\n", "a\nb", "½", "é", "É", "a b", "a&b", "[a]", "]a", "1a1", " \x1c", "\x0b", "a{2",
         "a}", "\\", "A.", "̈a", "aab1", "\x08", "#c", "b1b1", "_", "-z", "\n\n", "a\r\n", "ſ", "K"]


def valid(p):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return re.compile(p, re.IGNORECASE)
    except re.error:
        return None


def test_random_patterns(spark):
    rnd, found = random.Random(3), {}
    while len(found) < 250:
        p = "".join(rnd.choice(ATOMS) + rnd.choice(REPEATS) for _ in range(rnd.randint(1, 5)))
        if valid(p):
            found[p] = valid(p)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    rows = df.orderBy("i").select(*[F.col("t").rlike(to_java_regex(p)).alias(f"c{n}") for n, p in enumerate(found)]).collect()
    for text, row in zip(TEXTS, rows):
        for (p, rx), got in zip(found.items(), row):
            assert got == (rx.search(text) is not None), (p, to_java_regex(p), text)


@pytest.mark.parametrize("pattern, text, hit", [("^[a&&b]$", "&", True), ("[[a]", "[", True), ("x\\\\Z", "x\\Z", True), ("x\\Z", "x\n", False),
                                                ("(?x) a b # c", "ab", True), (r"\N{DIGIT ONE}", "1", True), (r"(a)\1", "aA", True)])
def test_named_cases(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(to_java_regex(pattern))).first()[0] is hit


def test_what_java_cannot_say_is_refused():
    with pytest.raises(UnsupportedPattern):
        to_java_regex("(a)?(?(1)b|c)")
    assert to_java_regex("(") is None
