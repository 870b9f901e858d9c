"""The piece encoder: what it keeps, and plain texts against the library."""

import random
from array import array

import public_tokenizers as P
import pytest

from vigilark.llm import tokens


class Asked:
    """The library's model, which notes what it is asked for."""

    def __init__(self, model):
        self.model, self.pieces = model, []

    def tokenize(self, piece):
        self.pieces.append(piece)
        return self.model.tokenize(piece)


def test_pieces_in_use_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    e = tokens.PieceEncoder(P.path("byte_bpe_50k.json"), False)
    e.known.model = asked = Asked(e.tool.model)
    for i in range(200):
        e.encode(f"the same words, and w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i // 100}")
        assert len(e.known) + len(getattr(e.known, "older", ())) <= 50
    assert asked.pieces.count("Ġsame") == 1 and len(asked.pieces) > 60


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_plain_texts_equal_the_library(name, lower):
    e, rng = tokens.PieceEncoder(P.path(name), lower), random.Random(5)
    parts = ["a", "Zé", "ÿž", "Ā", " ", "  ", "\n", " \n", "'s", "'re", "'ll", "'x", "'", "''", "7", "42", ".", ",!", "`{", "[~", "-@", "don't"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert tokens.PLAIN.fullmatch(text)
        want = array("I", e.tool.encode(text, add_special_tokens=False).ids).tobytes()
        assert e.encode(text) == want, repr(text)
