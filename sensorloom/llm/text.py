"""Byte-level text helpers that run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Byte map of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: other bytes become spaces.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: digits, letters and everything beyond ASCII."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space. bytes.split() splits on exactly x20 and x09-x0D."""
    return text.lower().split()


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def in_slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of about ``most`` bytes; a longer text makes a slice of its own."""
    begin = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, k
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)
