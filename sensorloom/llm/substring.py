"""Substring dedup by level-wise doubling.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words of one document. A window is repeated
when its words also start anywhere else, in the same document or another. Every word that a repeated window covers goes;
windows are judged on the texts as given.

Levels have 9, 18 and 35 words (the window, halved and rounded up while more than 9). A repeat of the window repeats all
its parts, so at each level only what was repeated at the level before is looked at again, at twice the length:

1. Of all parts of a level's length inside a window, the one with the least hash speaks for it; equal windows have the
   same one at the same place. Only these parts are counted in the corpus (about one word in 14 at 9 words).
2. Windows whose part is met once alone are finished. The words of the others, as regions of documents, make the next
   level's table. Where none is left, the levels end.
3. At the window's own length all windows of the last regions are counted; repeated ones are merged into spans.

All that meets is hashes of 64 bits (``slices.frequent``); the text moves with its slice only. Copies inside a slice are sent
once with their number, so a passage that all documents have costs one number a slice.

Null and empty texts have no words and stay as they are. A text with fewer words than a window stays whole. Repeated rows
are copies of each other: all of both goes, where they are a window long. Ids aren't looked at; other columns pass, under
any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.slices import bits_of, buckets_for, bytes_of, frequent, hashes_of, joined, packed, slice_table, trim, unpacked, words_of
from sensorloom.llm.token_table import _WHITE as WHITE
from sensorloom.llm.token_table import mix
from sensorloom.session import discard, written

WINDOW = 35
#: Parts of fewer words than this aren't halved.
SHORTEST = 9
_TIMES = np.uint64(0xD1342543DE82EF95)


def levels(window: int) -> list[int]:
    """Lengths from the shortest part to the window."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _slid(x: np.ndarray, width: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` over every run of ``width`` values, by doubling."""
    m = 1
    while m < width and len(x):
        step = min(m, width - m)
        x = of(x[:-step], x[step:])
        m += step
    return x


class Level:
    """The words of a payload and its tokens at one level."""

    def __init__(self, payload: bytes, window: int, length: int, text_col: str | None = None):
        batch = unpacked(payload)
        regions = text_col is None
        self.raw, starts = bytes_of(batch["text" if regions else text_col])
        self.begin, self.end, self.bounds = words_of(self.raw, starts, WHITE)
        n = batch.num_rows
        #: For each unit the document it is of, and the place of its first word there.
        self.doc = batch["doc"].to_numpy() if regions else np.arange(n)
        self.first = batch["first"].to_numpy() if regions else np.zeros(n, np.int64)
        self.window = window
        words = hashes_of(self.raw, self.begin, self.end, lower=False)
        counts = np.diff(self.bounds)
        starts_at = max(0, len(words) - window + 1)
        left = np.repeat(self.bounds[1:], counts) - np.arange(len(words))
        self.valid = left[:starts_at] >= window
        if not self.valid.any():
            self.least, self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        # Window hashes by doubling; no hash is 0.
        parts, m = words, 1
        while m < length:
            step = min(m, length - m)
            parts = mix(parts[:-step] * _TIMES + parts[step:], m)
            m += step
        parts |= np.uint64(1)
        inside = window - length + 1
        #: For each window the least hash of its parts; 0 where a document ends inside.
        self.least = _slid(parts, inside, np.minimum) if inside > 1 else parts.copy()
        self.least[~self.valid] = 0
        none = np.zeros(inside - 1, np.uint64)
        chosen = _slid(np.r_[none, self.least, none], inside, np.maximum) == parts
        self.tokens, self.counts = np.unique(parts[chosen], return_counts=True)

    def kept(self, often: np.ndarray) -> np.ndarray:
        """First words of the windows whose token is frequent."""
        if not len(self.tokens):
            return np.empty(0, np.int64)
        heads = np.flatnonzero(np.r_[True, self.least[1:] != self.least[:-1]])
        at = np.minimum(np.searchsorted(self.tokens, self.least[heads]), len(self.tokens) - 1)
        good = often[at] & (self.tokens[at] == self.least[heads])
        return np.flatnonzero(np.repeat(good, np.diff(np.r_[heads, len(self.least)])))

    def regions(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, first word, one past the last) of the runs of words that the windows cover, cut between units."""
        change = np.zeros(len(self.begin) + 1, np.int64)
        change[windows] += 1
        change[windows + self.window] -= 1
        covered = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(self.begin) + 1, bool)
        edge[self.bounds] = True
        first = np.flatnonzero(covered & (edge[:-1] | ~np.r_[False, covered[:-1]]))
        last = np.flatnonzero(covered & (edge[1:] | ~np.r_[covered[1:], False])) + 1
        return np.searchsorted(self.bounds, first, "right") - 1, first, last


def _trimmed(run: Callable[[int, bytes, pa.Table], pa.Table]) -> Callable[[int, bytes, pa.Table], pa.Table]:
    """``run``, after which the worker gives back what a slice took."""

    def of(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        out = run(base, payload, found)
        trim()
        return out

    return of


def _no_rows(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_UNITS = pa.schema([("base", pa.int64()), ("payload", pa.binary())])


def _narrowed(window: int, length: int, text_col: str | None, buckets: int):
    """The regions of a slice that are repeated at this length, as the next level's payload."""

    def run(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        level = Level(payload, window, length, text_col)
        unit, first, last = level.regions(level.kept(bits_of(found, level.tokens, buckets)))
        if not len(unit):
            return _no_rows(_UNITS)
        begin, end = level.begin[first], level.end[last - 1]
        sizes = end - begin
        at = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(unit), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(level.raw[at])])
        place = level.first[unit] + first - level.bounds[unit]
        batch = pa.RecordBatch.from_arrays([pa.array(level.doc[unit].astype(np.int32)), pa.array(place.astype(np.int64)), text], ["doc", "first", "text"])
        return pa.Table.from_arrays([pa.array([base], pa.int64()), pa.array([packed(batch)], pa.binary())], schema=_UNITS)

    return run


_SPANS = pa.schema([("base", pa.int64()), ("doc", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])


def _repeated(window: int, text_col: str | None, buckets: int):
    """The spans of a slice that repeated windows cover: document in the slice, first word, one past the last."""

    def run(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        level = Level(payload, window, window, text_col)
        unit, first, last = level.regions(level.kept(bits_of(found, level.tokens, buckets)))
        if not len(unit):
            return _no_rows(_SPANS)
        move = level.first[unit] - level.bounds[unit]
        columns = level.doc[unit], first + move, last + move
        return pa.Table.from_arrays([pa.array([base], pa.int64()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in columns)], schema=_SPANS)

    return run


def _levelled(slices: DataFrame, text_col: str, window: int, buckets: int) -> DataFrame:
    """Spans of all slices."""
    units, column = slices, text_col
    *parts, _ = levels(window)
    for length in parts:
        found = frequent(units, lambda p, n=length, c=column: (lambda x: (x.tokens, x.counts))(Level(p, window, n, c)), 2, buckets)
        before, units = units, written(joined(units, found, _trimmed(_narrowed(window, length, column, buckets)), "base bigint, payload binary"), "regions")
        if before is not slices:
            discard(before)
        column = None
    found = frequent(units, lambda p, c=column: (lambda x: (x.tokens, x.counts))(Level(p, window, window, c)), 2, buckets)
    spans = written(joined(units, found, _trimmed(_repeated(window, column, buckets)), "base bigint, doc binary, first binary, last binary"), "spans")
    if units is not slices:
        discard(units)
    return spans


def _spans_of(found: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each document's spans among (first, last)."""
    doc, first, last = (np.frombuffer(found[c][0].as_py(), "<i8") if found.num_rows else np.empty(0, np.int64) for c in ("doc", "first", "last"))
    return np.searchsorted(doc, np.arange(n + 1)), first, last


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kept: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans (words first..last-1 that repeated windows cover); with ``kept`` also the words
    that stay, joined by one space, as UTF-8."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _finished(rows, "text", window, _listed(kept), f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, spans array<struct<first:bigint,last:bigint>>" + ", kept binary" * kept).withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns; where words go, the text is the words that stay, joined by one space."""
    return _finished(docs, text_col, window, _cut(text_col), docs.schema)


def _finished(rows: DataFrame, text_col: str, window: int, run: Callable, schema) -> DataFrame:
    slices, buckets = slice_table(rows, text_col, "slices"), buckets_for(rows)
    return joined(slices, _levelled(slices, text_col, window, buckets), _trimmed(run), schema)


def _staying(words: list[bytes], first: list[int], last: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(first, last, strict=True):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def _listed(kept: bool):
    def run(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        batch = unpacked(payload)
        raw, starts = bytes_of(batch["text"])
        bounds, first, last = _spans_of(found, batch.num_rows)
        data, counts, texts = raw.tobytes(), np.zeros(batch.num_rows, np.int64), []
        for k in range(batch.num_rows):
            words = data[starts[k] : starts[k + 1]].split()
            counts[k] = len(words)
            if kept:
                texts.append(_staying(words, first[bounds[k] : bounds[k + 1]].tolist(), last[bounds[k] : bounds[k + 1]].tolist()))
        pairs = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"])
        out = [batch["id"], pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs)]
        return pa.Table.from_arrays([*out, *([pa.array(texts, pa.binary())] if kept else [])], ["id", "n_words", "spans", *(["kept"] if kept else [])])

    return run


def _cut(text_col: str):
    def run(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        batch = unpacked(payload)
        at = batch.schema.get_field_index(text_col)
        bounds, first, last = _spans_of(found, batch.num_rows)
        texts = batch.column(at).to_pylist()
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            texts[k] = _staying(texts[k].encode().split(), first[bounds[k] : bounds[k + 1]].tolist(), last[bounds[k] : bounds[k + 1]].tolist()).decode()
        return pa.Table.from_batches([batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))])

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the words that stay, for each row of ``find_repeats`` with ``kept``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return found.select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
