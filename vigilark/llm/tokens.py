"""Whole texts to token ids with the ``tokenizers`` library, piece by piece.

A BPE tokenizer encodes each pre-token on its own, so a pre-token's ids are kept and reused:
the library sees each distinct pre-token once (per worker, while it keeps coming back), and the
rest is a dictionary lookup. Pre-tokens are cut here only for texts made of plain Latin characters,
where the cutting rule below is the tokenizer's own; any other text goes whole to the library.

With ``added`` the tokenizer is used as loaded: the literal content of an added token (such as
``<|endoftext|>``) is that token, and a text that holds one goes whole to the library. Without,
such content is text like any other.
"""

from __future__ import annotations

import os
import re
from array import array

# Letters of the plain alphabet, and the tokenizers' pre-token patterns over it.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
PLAIN = re.compile(f"[\\n\\x20-\\x7e{LETTERS}]*")
# in a plain text whatever is no white space, digit or mark of ASCII is a letter; no run is ever given back
MARKS = r"!-/:-@\[-`{-~"
BYTE_PIECE = re.compile(rf" ?+[^\n 0-9{MARKS}]++|'(?:[stmd]|re|ve|ll)| ?+[0-9]++| ?+[{MARKS}]++|\s+(?!\S)|\s+")
WORD_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")

#: most pre-tokens that a worker keeps (about 150 bytes each): half of them new, half of the time before
CACHE = 600_000


def byte_table() -> dict[int, int]:
    """The byte-level alphabet as a ``str.translate`` table over bytes read as Latin-1: printable
    bytes stand for themselves, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Known(dict):
    """Pre-token -> ids in bytes; the library's model is asked for what is not there yet.
    ``age`` lets go of what was not used since it was last called."""

    def __init__(self, model):
        super().__init__()
        self.model, self.table, self.older = model, byte_table(), {}
        self.space = self.table[ord(" ")]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():     # only its spaces are not shown as they are
                shown = piece.replace(" ", chr(self.space))
            else:
                shown = piece.encode().decode("latin-1").translate(self.table)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self[piece] = ids
        return ids

    def age(self) -> None:
        self.older = self.copy()
        self.clear()


class PieceEncoder:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, lower: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = not added
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()] if added else []
        self.lower, self.pattern = lower, WORD_PIECE if lower else BYTE_PIECE
        self.known = Known(self.tool.model)

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > CACHE // 2:
            self.known.age()
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))


def encoder(name: str, lower: bool, added: bool = False) -> PieceEncoder:
    """The worker's encoder for a tokenizer of the ``public_tokenizers`` package, or for a path.
    It is kept on the library's module, which outlives a task (this module's globals travel by
    value and are new in each)."""
    import public_tokenizers
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_piece_encoders", {})
    if (name, lower, added) not in kept:
        kept[name, lower, added] = PieceEncoder(name if os.path.isabs(name) else public_tokenizers.path(name), lower, added)
    return kept[name, lower, added]
