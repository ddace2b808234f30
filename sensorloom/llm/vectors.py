"""Dense count vectors that tasks make in pieces and Spark adds up as a tree.

A row is (block, chunk, part, payload): counts number chunk * CHUNK and on of a block, from task ``part``, packed in as few
bytes as they need. Sums go up in levels of ``FAN`` parts, so no group holds more than so many payloads of one chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
FAN = 64
SCHEMA = "block bigint, chunk bigint, part bigint, payload binary"
_ARROW = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def pack(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return struct.pack("<BI", width, len(counts)) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def unpack(payload: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", payload)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[5:]), f"<u{width}", n).astype(np.int64)


def rows_of(counts: np.ndarray, block: int, part: int, chunk: int = CHUNK) -> pa.RecordBatch:
    """The chunks of a vector that aren't all zero."""
    at = [k for k in range(0, len(counts), chunk) if counts[k : k + chunk].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(at), pa.int64()), pa.array([k // chunk for k in at], pa.int64()), pa.array([part] * len(at), pa.int64()), pa.array([pack(counts[k : k + chunk]) for k in at], pa.binary())],
        schema=_ARROW,
    )


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    total = 0
    for payload in table["payload"]:
        total = total + unpack(payload.as_py())
    return pa.Table.from_arrays([pa.array([key[k].as_py()], pa.int64()) for k in range(3)] + [pa.array([pack(total)], pa.binary())], schema=_ARROW)


def tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """One row for each (block, chunk); ``parts``: the number of tasks that made them."""
    while True:
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "chunk", "part").applyInArrow(_sum, SCHEMA)
        parts = -(-parts // FAN)
        if parts <= 1:
            return vectors


def entries(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (block, number, f) of all counts above zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, c, payload in zip(batch["block"].to_pylist(), batch["chunk"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                counts = unpack(payload)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b)), pa.array(c * chunk + at), pa.array(counts[at])], ["block", "number", "f"])

    return vectors.mapInArrow(run, "block bigint, number bigint, f bigint")
