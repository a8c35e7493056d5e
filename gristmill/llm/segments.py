"""Cutting texts into the pre-tokens of a byte-level BPE tokenizer, and caches of their values.

Pre-tokens repeat far more often than texts do, which is what makes caches of encoded ones pay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

#: Below this code point the general categories of letters and digits are the same in every
#: Unicode version, so that splitting here and splitting in a tokenizer library agree.
SETTLED = 0x250
#: Characters that are taken at a time of a very long text.
CHUNK = 1 << 20

_WHITE = "\\t-\\r \x85\xa0"
#: In front of a space that follows a non-space.
_CUT = re.compile(r"(?<=\S)(?= )")


def _ranges(category: str) -> str:
    """The settled characters of a general category, as the inside of a character class."""
    members = [c for c in range(SETTLED) if unicodedata.category(chr(c))[0] == category]
    starts = [c for c in members if c - 1 not in members]
    ends = [c for c in members if c + 1 not in members]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def settled_pattern(pattern: str) -> re.Pattern | None:
    r"""``pattern`` for settled characters alone, as the faster standard library takes it.

    Handles ``\p{L}``, ``\p{N}`` and ``\s`` in and outside of character classes, ``\S`` outside;
    None for a pattern that has any other property or class.
    """
    inside, out = False, []
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ("[", "]"):
            inside = part == "["
        members = {r"\p{L}": _ranges("L"), r"\p{N}": _ranges("N"), r"\s": _WHITE}.get(part)
        if members is not None:
            part = members if inside else f"[{members}]"
        elif part == r"\S" and not inside:
            part = f"[^{_WHITE}]"
        elif re.fullmatch(r"\\[A-Za-z].*", part) and part not in (r"\r", r"\n", r"\t"):
            return None
        out.append(part)
    return re.compile("".join(out))


def chunks(text: str, most: int = CHUNK) -> Iterator[str]:
    """Slices of a long text that tokenise independently.

    Every pre-token begins at or before a space that follows a non-space, so no pre-token crosses
    a cut in front of one, and look-ahead for white space sees the same there as at a text's end.
    """
    at = 0
    while len(text) - at > most and (found := _CUT.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Splitter:
    """The pre-tokens of a text in order.

    Where other characters than the settled ones stand, the ``regex`` library splits; with
    ``raw``, stretches that hold such characters come whole, as 1-tuples, for a tokenizer library
    to split itself, and so do texts that hold one of the strings in ``special``.
    """

    def __init__(self, pattern: str, raw: bool = False, special: tuple[str, ...] = ()):
        import regex

        self.raw, self.special = raw, special
        self.slow = regex.compile(pattern).findall
        fast = settled_pattern(pattern)
        self.fast = fast.findall if fast else self.slow
        self.settled = re.compile(f"[\0-\\u{SETTLED - 1:04x}]*").fullmatch if fast or not raw else lambda text: False

    def __call__(self, text: str) -> list:
        for special in self.special:
            if special in text:
                return [(text,)]
        if self.settled(text):
            return self.fast(text)
        if not self.raw:
            return self.slow(text)
        out: list = []
        for piece in _CUT.split(text):
            if self.settled(piece):
                out += self.fast(piece)
            else:
                out.append((piece,))
        return out


class WordCache(dict):
    """Pre-tokens to values: a fixed table of frequent ones before a bounded cache of the rest.

    The cache has two generations of ``half`` entries each; pre-tokens of more than ``long``
    characters are never kept.
    """

    def __init__(self, encode: Callable, frequent: dict | None = None, half: int = 600_000, long: int = 48):
        super().__init__(frequent or {})
        self.encode, self.frequent, self.half, self.long = encode, frequent or {}, half, long
        self.old: dict = {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
        self.keep(word, value)
        return value

    def keep(self, word, value) -> None:
        if len(word if type(word) is str else word[0]) <= self.long:
            if len(self) >= self.half + len(self.frequent):
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[word] = value
