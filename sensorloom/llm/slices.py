"""Slices of documents, and which of their tokens occur often enough in the whole corpus.

A slice is a row (base, payload): documents of about ``SLICE_BYTES`` as one compressed Arrow stream. An operator makes
sorted distinct 64-bit tokens with counts from a payload. ``frequent`` sends them packed to buckets of hash ranges, which
add up the counts; back to each slice goes one bit a token, in the order of its tokens: whether the count of the whole
corpus reaches a limit. The slice makes its tokens again to read the bits, so neither tokens nor places come back. A token
that a third of all documents hold is one number a slice: no bucket gets more of a token than there are slices.

The number of buckets follows the input, so a bucket holds as much at any size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sensorloom.llm.memory import trim
from sensorloom.llm.token_table import SLICE_BYTES as HASHED_BYTES
from sensorloom.llm.token_table import slices_of, word_hashes
from sensorloom.session import written

SLICE_BYTES = 4_000_000
#: Distinct tokens (sorted) and their counts, of one payload.
TokensOf = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def packed(batch: pa.RecordBatch) -> bytes:
    """An Arrow stream, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null as empty), and where each text begins, with the end."""
    for _, _, raw, starts in slices_of(column, 1 << 62):
        return raw, starts
    return np.empty(0, np.uint8), np.zeros(1, np.int64)


def words_of(raw: np.ndarray, starts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word and one past its last, and for each text its first word (with the end). ``between`` marks the
    byte values that stand between words."""
    word = ~between[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[starts] = True
    begin = np.flatnonzero(word & (cut[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (cut[1:] | ~np.r_[word[1:], False])) + 1
    return begin, end, np.searchsorted(begin, starts)


def hashes_of(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, a = np.empty(len(begin), np.uint64), 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + HASHED_BYTES, "right")))
        low = begin[a]
        out[a:b] = word_hashes(raw[low : end[b - 1]], begin[a:b] - low, end[a:b] - low, (1,), lower)[0]
        a = b
    return out


def slice_table(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """A written row (base, payload) for each slice; payloads hold all columns of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, _, _ in slices_of(batch[text_col], SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([packed(batch.slice(a, b - a))], pa.binary())], ["base", "payload"])
                base += 1

    return written(docs.mapInArrow(run, "base bigint, payload binary"), name)


def _bounds(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's tokens begin, with the end: buckets are ranges of sorted tokens."""
    edges = np.array([(j << 64) // buckets for j in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(tokens, edges), len(tokens)]


def _send(tokens_of: TokensOf, buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch["base"].to_pylist(), batch["payload"], strict=True):
                tokens, counts = tokens_of(payload.as_buffer())
                bounds, rows = _bounds(tokens, buckets), []
                low = np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                for j in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[j], bounds[j + 1]
                    size = 1 if counts[a:b].max() < 256 else 4
                    rows.append((j, struct.pack("<IB", b - a, size) + low[a:b].tobytes() + counts[a:b].astype(f"<u{size}").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in rows], pa.int32()), pa.array([base] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "base", "payload"])

    return run


def _count(least: int, width: int, first: bool):
    def run(table: pa.Table) -> pa.Table:
        tokens, counts, sizes = [], [], []
        for payload in table["payload"].to_pylist():
            n, size = struct.unpack_from("<IB", payload)
            sizes.append(n)
            tokens.append(np.frombuffer(payload, np.uint8, width * n, 5).reshape(n, width))
            counts.append(np.frombuffer(payload, f"<u{size}", n, 5 + width * n).astype(np.uint32))
        total = sum(sizes)
        whole, ends = np.zeros((total, 8), np.uint8), np.cumsum(sizes)
        for own, end in zip(tokens, ends.tolist(), strict=True):
            whole[end - len(own) : end, :width] = own
        del tokens
        order = np.argsort(whole.view("<u8").ravel())
        ranked = whole.view("<u8").ravel()[order]
        del whole
        heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        del ranked
        enough = np.add.reduceat(np.concatenate(counts)[order], heads, dtype=np.int64) >= least
        often = np.empty(total, bool)
        often[order] = np.repeat(enough, np.diff(np.r_[heads, total]))
        bits = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum(sizes)[:-1])]
        columns = [table["base"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(bits, pa.binary())]
        if first:
            # Of equal tokens the one of the first row.
            mark = np.zeros(total, bool)
            mark[np.minimum.reduceat(order, heads)] = True
            columns.append(pa.array([np.packbits(x).tobytes() for x in np.split(mark, np.cumsum(sizes)[:-1])], pa.binary()))
        del order, heads
        trim()
        return pa.Table.from_arrays(columns, ["base", "bucket", "bits", "firsts"][: len(columns)])

    return run


def frequent(slices: DataFrame, tokens_of: TokensOf, least: int, buckets: int, width: int = 8, first: bool = False) -> DataFrame:
    """Rows (base, bucket, bits): which tokens of each slice come to ``least`` in all slices. ``width``: bytes of a token that
    are compared inside a bucket, beside the high bits that the bucket tells; with fewer than 8, more tokens may seem
    frequent, but none that is frequent is lost. With ``first`` also firsts: for each token, one slice of those that have it."""
    sent = slices.mapInArrow(_send(tokens_of, buckets, width), "bucket int, base bigint, payload binary")
    return sent.groupBy("bucket").applyInArrow(_count(least, width, first), "base bigint, bucket int, bits binary" + ", firsts binary" * first)


def bits_of(found: pa.Table, tokens: np.ndarray, buckets: int, column: str = "bits") -> np.ndarray:
    """Whether each token of a slice is frequent (or first), from what came back to it."""
    bounds, often = _bounds(tokens, buckets), np.zeros(len(tokens), bool)
    for j, bits in zip(found["bucket"].to_pylist(), found[column].to_pylist(), strict=True):
        a, b = bounds[j], bounds[j + 1]
        often[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return often


def joined(slices: DataFrame, other: DataFrame, run: Callable[[int, bytes, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on each slice's payload and the rows of ``other`` with its base (perhaps none)."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key[0].as_py(), left["payload"][0].as_buffer(), right)

    return slices.groupBy("base").cogroup(other.groupBy("base")).applyInArrow(both, schema)


def buckets_for(docs: DataFrame) -> int:
    """One bucket for each input partition."""
    return max(16, docs.rdd.getNumPartitions())
