"""Python ``re`` patterns as Java patterns for ``rlike``.

The pattern is parsed by Python itself and written anew for Java from the parsed tree, so escapes,
classes, named groups, comments and quantifiers mean what Python says they mean: a ``[`` or ``&&``
inside a class is literal, ``\\v`` is one character, ``{,3}`` starts at 0, ``\\Z`` is the very end.
Character classes are Python's (``\\w`` holds numerals of any script and no combining marks; ``\\s``
holds U+001C to U+001F; word borders follow ``\\w``). What Java cannot say (a branch that depends on
a group) raises ``UnsupportedPattern``; nothing is ever matched differently on purpose.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as K
from re import _parser


class UnsupportedPattern(ValueError):
    """A pattern that Python accepts and Java has no form for."""


# Python's character classes, as the inside of a Java class; (str, ASCII) forms.
WORD = (r"\p{L}\p{N}_", "a-zA-Z0-9_")
DIGIT = (r"\p{Nd}", "0-9")
SPACE = (r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}",
         r"\x09-\x0D\x20")
CLASSES = {K.CATEGORY_WORD: (WORD, False), K.CATEGORY_NOT_WORD: (WORD, True), K.CATEGORY_DIGIT: (DIGIT, False),
           K.CATEGORY_NOT_DIGIT: (DIGIT, True), K.CATEGORY_SPACE: (SPACE, False), K.CATEGORY_NOT_SPACE: (SPACE, True)}


def char(code: int) -> str:
    """One character, literal inside and outside a class."""
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


def one_of(items: list, ascii_only: bool) -> str:
    """A parsed class. Complements inside a class are alternatives, never nested classes."""
    negated = bool(items) and items[0][0] is K.NEGATE
    plain, others = [], []
    for op, arg in items[1:] if negated else items:
        if op is K.LITERAL:
            plain.append(char(arg))
        elif op is K.RANGE:
            plain.append(f"{char(arg[0])}-{char(arg[1])}")
        else:
            (wide, narrow), complement = CLASSES[arg]
            inside = narrow if ascii_only else wide
            if complement:
                others.append(f"[^{inside}]")
            else:
                plain.append(inside)
    parts = ([f"[{''.join(plain)}]"] if plain else []) + others
    if negated:
        return f"[^{''.join(plain)}]" if not others else f"(?:(?!{'|'.join(parts)})[\\x00-\\x{{10FFFF}}])"
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def place(at, flags: int) -> str:
    lines = flags & re.MULTILINE
    w = f"[{WORD[1] if flags & re.ASCII else WORD[0]}]"
    if at is K.AT_BEGINNING:
        return r"(?<![^\x0A])" if lines else r"\A"
    if at is K.AT_END:
        return r"(?![^\x0A])" if lines else r"(?=\x0A?\z)"
    if at is K.AT_BEGINNING_STRING:
        return r"\A"
    if at is K.AT_END_STRING:
        return r"\z"
    if at is K.AT_BOUNDARY:
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    # not a border; Python finds none in an empty text
    return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\\A\\z))"


REPEATS = {K.MAX_REPEAT: "", K.MIN_REPEAT: "?", K.POSSESSIVE_REPEAT: "+"}


def written(tree, flags: int) -> str:
    """A parsed (sub)pattern as Java text; ``flags`` are those in force."""
    out = []
    for op, arg in tree:
        if op is K.LITERAL:
            out.append(char(arg))
        elif op is K.NOT_LITERAL:
            out.append(f"[^{char(arg)}]")
        elif op is K.ANY:
            out.append(r"[\x00-\x{10FFFF}]" if flags & re.DOTALL else r"[^\x0A]")
        elif op is K.IN:
            out.append(one_of(arg, bool(flags & re.ASCII)))
        elif op is K.AT:
            out.append(place(arg, flags))
        elif op is K.BRANCH:
            out.append(f"(?:{'|'.join(written(b, flags) for b in arg[1])})")
        elif op in REPEATS:
            low, high, sub = arg
            most = "" if high is K.MAXREPEAT else high
            out.append(f"(?:{written(sub, flags)}){{{low},{most}}}{REPEATS[op]}")
        elif op is K.SUBPATTERN:
            group, add, drop, sub = arg
            body = written(sub, (flags | add) & ~drop)
            if (add | drop) & re.IGNORECASE:
                body = f"(?{'i' if add & re.IGNORECASE else '-i'}:{body})"
            out.append(f"({body})" if group is not None else f"(?:{body})")
        elif op is K.ATOMIC_GROUP:
            out.append(f"(?>{written(arg, flags)})")
        elif op is K.GROUPREF:
            out.append(f"(?:\\{arg})")
        elif op in (K.ASSERT, K.ASSERT_NOT):
            ahead, sub = arg
            sign = ("" if ahead > 0 else "<") + ("=" if op is K.ASSERT else "!")
            out.append(f"(?{sign}{written(sub, flags)})")
        elif op is K.FAILURE:
            out.append("(?!)")
        else:
            raise UnsupportedPattern(f"no Java form for {op}")
    return "".join(out)


def to_java_regex(pattern: str) -> str | None:
    """The Java pattern that ``rlike`` (an unanchored find, as ``re.search`` is) has to find, ignoring
    case; None when Python rejects the pattern (the rule condition is then false)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern, re.IGNORECASE)
            tree = _parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None
    return "(?iu)" + written(tree, tree.state.flags)
