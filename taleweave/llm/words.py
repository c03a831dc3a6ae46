"""Words of a text as runs of letters and digits, without case, accents and invisible characters."""

from __future__ import annotations

import unicodedata

import regex

_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _DROPPED.sub("", unicodedata.normalize("NFKD", text)).casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """As ``words``, with each word's place [start, end) in the original text. Slower; for texts with a hit."""
    out, chars, at = [], [], []
    for i, c in enumerate(text):
        # Folding single characters gives what folding the text gives, but for reordered marks, which are dropped.
        for p in plain(c):
            chars.append(p)
            at.append(i)
    for m in _WORD.finditer("".join(chars)):
        out.append((m.group(), at[m.start()], at[m.end() - 1] + 1))
    return out
