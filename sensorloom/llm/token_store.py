"""Token ids in a compact binary format with a shared zstandard dictionary.

Layout of a store (a folder that any Spark reader reaches; every file is Parquet around binary payloads, since tasks can
write to a shared store only through Spark):

* ``dictionary``: one row (sha256, bytes): the shared dictionary, trained on the serialized id arrays of at most
  ``TRAIN_DOCS`` whole documents (those whose hashed id comes first, one for each id).
* ``blocks``: rows (shard, block, n_docs, n_ids, ids_before, first_id, last_id, payload), in ascending document id.

A payload is little-endian: magic ``SLTK``, version (1 byte), bytes an id (1 byte), 2 zero bytes, the dictionary's
sha256 (32 bytes), number of documents (4 bytes); then arrays of document ids (8 bytes each), whether the id is null
(1 byte each), numbers of ids (4 bytes each) and frame offsets (8 bytes each, one more than documents); then one
zstandard frame for each document. A short document is read with its frame alone.

A null text is empty. Each document ends with ``end_id``. Rows with one document id keep apart and are ordered by their
text; a null id comes first. Long texts make larger frames; a block closes at ``BLOCK_DOCS`` documents or
``BLOCK_BYTES`` bytes, whichever is first. An empty table gives a store without blocks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.pieces import split_pieces
from sensorloom.llm.text import in_slices
from sensorloom.session import shared_dir

TRAIN_DOCS = 256
DICTIONARY_BYTES = 16_384
BLOCK_DOCS = 1_000
BLOCK_BYTES = 2_000_000
SLICE_BYTES = 2_000_000
#: A table of so many shards (12 bytes each) is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_SHARDS = 200_000
#: Distinct pieces a Python worker keeps the ids of, and as many older ones, which come back when they are met.
CACHE = 400_000
_HEAD = struct.Struct("<4sBBH32sI")


def id_bytes(ids: list[int], width: int) -> bytes:
    """Ids as little-endian unsigned integers of 2 or 4 bytes."""
    out = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of the pre-tokenizer's pattern once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``width`` bytes."""
        pieces, bounds = split_pieces(texts)
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new = list(set(pieces).difference(self.known))
        if self.older:
            self.known |= {p: ids for p, ids in zip(new, map(self.older.get, new)) if ids is not None}
            new = [p for p in new if p not in self.known]
        for piece, got in zip(new, self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False), strict=True):
            self.known[piece] = id_bytes(got.ids, self.width)
        get = self.known.__getitem__
        return [b"".join(map(get, pieces[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.cache
def encoder_of(path: str) -> PieceEncoder:
    """One encoder for each Python worker, so that its tasks share what it has encoded."""
    return PieceEncoder(path)


def pack(rows: list[tuple[int | None, int, bytes]], width: int, sha: bytes) -> bytes:
    """A block of (document id, number of ids, frame)."""
    sizes = np.array([len(f) for _, _, f in rows], np.int64)
    return b"".join(
        [
            _HEAD.pack(b"SLTK", 1, width, 0, sha, len(rows)),
            np.array([i or 0 for i, _, _ in rows], "<i8").tobytes(),
            np.array([i is None for i, _, _ in rows], np.uint8).tobytes(),
            np.array([n for _, n, _ in rows], "<u4").tobytes(),
            np.r_[0, np.cumsum(sizes)].astype("<u8").tobytes(),
            *(f for _, _, f in rows),
        ]
    )


class Packed:
    """A block's index; frames are read one by one."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, version, self.width, _, sha, n = _HEAD.unpack_from(payload)
        if magic != b"SLTK" or version != 1:
            raise ValueError("not a block of token ids")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        self.ids = np.frombuffer(payload, "<i8", n, at)
        self.null = np.frombuffer(payload, np.uint8, n, at := at + 8 * n)
        self.counts = np.frombuffer(payload, "<u4", n, at := at + n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at := at + 4 * n)
        self.body, self.payload = at + 8 * (n + 1), payload
        self.reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))

    def tokens(self, k: int) -> np.ndarray:
        frame = self.payload[self.body + int(self.offsets[k]) : self.body + int(self.offsets[k + 1])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def sampled_texts(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """``text`` of the documents whose hashed id comes first, one for each id, without null and empty ones.

    Ids are chosen by themselves, so that no text moves but the chosen ones.
    """
    chosen = docs.select(F.col(id_col).alias("own")).distinct().orderBy(F.xxhash64("own"), "own").limit(count)
    met = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).where("text <> ''").join(F.broadcast(chosen), "own")
    return met.dropDuplicates(["own"]).select("text")


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str) -> bytes:
    """The shared dictionary from a bounded sample; raw content where there are too few ids to train on."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder_of(path).encode(batch["text"].to_pylist()), pa.binary())], ["ids"])

    rows = sampled_texts(docs, id_col, text_col, TRAIN_DOCS).mapInArrow(encode, "ids binary")
    samples = sorted(bytes(r.ids) for r in rows.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or bytes(8)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the store at ``out``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, id_col, text_col)
    sha = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(sha.hex(), bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{out}/dictionary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One exchange of texts: ranges of ids, a tie of many rows can still be divided by their texts.
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    schema = "shard int, block int, n_docs int, n_ids bigint, ids_before bigint, first_id bigint, last_id bigint, payload binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        writer = zstandard.ZstdCompressor(level=3, dict_data=as_dictionary(dictionary))
        shard, held, size, block, before = TaskContext.get().partitionId(), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            n = sum(x[1] for x in held)
            known = [x[0] for x in held if x[0] is not None]
            row = {"shard": shard, "block": block, "n_docs": len(held), "n_ids": n, "ids_before": before, "first_id": min(known, default=None), "last_id": max(known, default=None), "payload": pack(held, encoder.width, sha)}
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            for a, b in in_slices(texts, SLICE_BYTES):
                for i, tokens in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    tokens += end
                    frame = writer.compress(tokens)
                    held.append((i, len(tokens) // encoder.width, frame))
                    size += len(frame)
                    if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        done = close()
                        before += done["n_ids"][0].as_py()
                        yield done
                        held, size, block = [], 0, block + 1
        if held:
            yield close()

    rows.mapInArrow(encode, schema).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    return out


def _blocks(spark: SparkSession, out: str) -> tuple[DataFrame, bytes]:
    dictionary = spark.read.parquet(f"{out}/dictionary").head()
    schema = "shard int, block int, n_docs int, n_ids bigint, ids_before bigint, first_id bigint, last_id bigint, payload binary"
    return spark.read.schema(schema).parquet(f"{out}/blocks"), bytes(dictionary["bytes"])


def read_tokens(spark: SparkSession, out: str, arrays: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of a store; ``start`` is the number of ids before the document.

    ``ids_crc32`` is over little-endian unsigned 32-bit integers. Without ``arrays`` the ids stay packed in the file.
    """
    blocks, dictionary = _blocks(spark, out)
    # A row for each shard, which is one writing task: their number doesn't follow the documents in a shard.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    totals = totals.select("shard", "shard_start")
    if totals.count() <= BROADCAST_SHARDS:
        totals = F.broadcast(totals)
    placed = blocks.join(totals, "shard").select((F.col("shard_start") + F.col("ids_before")).alias("start"), "payload")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * arrays

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch["start"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                block = Packed(payload, dictionary)
                n = len(block.ids)
                tokens = [block.tokens(k) for k in range(n)]
                counts = np.array([len(t) for t in tokens], np.int64)
                data = {
                    "doc_id": pa.array(block.ids, pa.int64(), mask=block.null.astype(bool)),
                    "start": pa.array(start + np.r_[0, np.cumsum(counts)][:n], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                }
                if arrays:
                    data["ids"] = pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(data)

    return placed.mapInArrow(decode, schema)


def fetch_tokens(spark: SparkSession, out: str, low: int, high: int) -> DataFrame:
    """Ids of the documents low..high: only blocks whose id range meets it are read, only their frames unpacked."""
    blocks, dictionary = _blocks(spark, out)
    some = blocks.where((F.col("last_id") >= low) & (F.col("first_id") <= high)).select("payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                block = Packed(payload, dictionary)
                at = np.flatnonzero((block.ids >= low) & (block.ids <= high) & (block.null == 0)).tolist()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids[at], pa.int64()), "ids": pa.array([block.tokens(k).astype(np.int32) for k in at], pa.list_(pa.int32()))})

    return some.mapInArrow(decode, "doc_id bigint, ids array<int>")


def new_store(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
