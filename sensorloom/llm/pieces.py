"""Splits text into the pieces of the byte-level tokenizers' pattern, many texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches cover
a text without gaps, so only their starts are needed, and those follow from runs of characters of one class.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The code points of the White_Space property.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _classes() -> np.ndarray:
    of = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = _SPACE
    return table


def piece_starts(chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Marks the first character of every piece. ``text_starts``: where each text begins (empty texts: twice the same)."""
    n = len(chars)
    kind = _classes()[chars]
    begins = np.zeros(n + 1, bool)
    begins[text_starts] = True
    begins[n] = True
    begins[0] = True
    run = begins.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    first = np.flatnonzero(run)
    first, end = first[:-1], first[1:]
    kinds, followed = kind[first], ~begins[end]
    # White space before something in the same text: its last character stands alone, or a blank joins what follows.
    space = (kinds == _SPACE) & followed
    last = end[space] - 1
    start[last] = True
    start[last[chars[last] == 32] + 1] = False
    # A lone apostrophe that begins a piece takes the ending behind it.
    lone = first[(kinds == _OTHER) & followed & (end - first == 1) & (chars[first] == 39)]
    lone = lone[start[lone] & (kind[np.minimum(lone + 1, n - 1)] == _LETTER)]
    one = np.isin(chars[lone + 1], [ord(c) for c in "stmd"])
    pair = np.minimum(lone + 2, n - 1)
    two = np.zeros(len(lone), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (chars[lone + 1] == ord(a)) & (chars[pair] == ord(b)) & ~run[pair]
    for some, length in ((one, 2), (two, 3)):
        at = lone[some]
        start[at + 1] = False
        rest = at + length
        rest = rest[rest < n]
        start[rest[~run[rest]]] = True
    return start


def split_pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All pieces of the texts as UTF-8, in order, and where each text's pieces begin and end (len(texts) + 1 bounds)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.r_[0, np.cumsum(lengths)]
    joined = "".join(texts)
    if not joined:
        return [], np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    start = piece_starts(chars, begins)
    at = np.flatnonzero(start)
    raw = np.frombuffer(joined.encode(), np.uint8)
    if len(raw) == len(chars):
        byte_at = at
    else:
        byte_at = np.flatnonzero((raw & 0xC0) != 0x80)[at]
    # Byte 255 never occurs in UTF-8: put one before each piece and split there.
    out = np.full(len(raw) + len(at), 255, np.uint8)
    body = np.ones(len(out), bool)
    body[byte_at + np.arange(len(at))] = False
    out[body] = raw
    bounds = np.searchsorted(at, begins)
    return out.tobytes().split(b"\xff")[1:], bounds
