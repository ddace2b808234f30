"""Benchmark decontamination with an FM-index for each shard of the training documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``WINDOW`` consecutive words of
an item; an item with fewer words, but not none, is one window. A shard is a bounded run of documents inside one
partition. Its symbols are the words of the searched items; any other word only separates, and so does the end of a
document. Runs of symbols shorter than the shortest window can hold no window and are left out of the index, so that
its size follows what could match and not the vocabulary of the corpus. All windows are then searched backwards at once
through the wavelet tree's ranks, occurrences are located by sampled suffix positions, and overlapping ones merge into
removal spans.

Items are a query set: they are taken in blocks of at most ``ITEM_WORDS`` words, each a bounded broadcast and one more
narrow pass over the documents; there is no shuffle. With several blocks each pass is written, so that one block at a
time is at the driver. Removal over several blocks goes on with the texts that were cut until no block finds a window. A null text has no words and matches nothing; an item without id
or words is ignored; several texts under one item id count as one item; a repeated document row is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.fm_index import FMIndex
from sensorloom.llm.memory import release, trim
from sensorloom.llm.text import ALNUM, alnum_words, byte_values, in_slices
from sensorloom.session import written

WINDOW = 10
ITEM_WORDS = 2_000_000
SHARD_BYTES = 16_000_000
_WORD = re.compile(rb"[^\x20]+")


class Block:
    """Windows of some items: their words numbered from 2 (1 separates), distinct windows by length, items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 2) for w in alnum_words(text)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.size = len(self.number) + 2
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            self.by_length[length] = np.array(own, np.int64), [sorted(owners[w]) for w in own]
        self.shortest = min(self.by_length, default=0)


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, words: int = ITEM_WORDS) -> Iterator[tuple[Block, bool]]:
    """Blocks of items that hold at most ``words`` words, and whether a block is the last; there is one at least.

    An item of more words comes in parts that overlap by a window less one word, so each window is whole in one of them.
    """
    held, count, words = [], 0, max(words, window)
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        own = alnum_words(text.encode())
        step = max(1, words - window + 1)
        for k in range(0, max(1, len(own) - window + 1), step) if len(own) > words else (0,):
            part = own[k : k + words] if len(own) > words else own
            if held and count + len(part) > words:
                yield Block(held, window), False
                held, count = [], 0
            held.append((item, b" ".join(part)))
            count += len(part)
    yield Block(held, window), True


def shard_hits(texts: list[bytes], block: Block) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """For each text: its number of words, the merged word spans (n x 2) inside windows, and the items found."""
    counts = np.zeros(len(texts), np.int64)
    spans = [np.empty((0, 2), np.int64)] * len(texts)
    found: list[set[str]] = [set() for _ in texts]
    pieces, get = [], block.number.get
    for k, text in enumerate(texts):
        words = alnum_words(text)
        counts[k] = len(words)
        pieces.append(np.fromiter((get(w, 1) for w in words), np.int64, len(words)))
    if not block.by_length or not counts.sum():
        return counts, spans, found
    symbols = np.concatenate(pieces)
    starts = np.r_[0, np.cumsum(counts)]
    # Runs of item words, cut where documents end; the short ones can't hold a window.
    inside = symbols > 1
    edge = np.zeros(len(symbols) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    last = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    long = last - first >= block.shortest
    first, last = first[long], last[long]
    if not len(first):
        return counts, spans, found
    lengths = last - first + 1  # and a separator behind each
    at = np.repeat(first - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    ends = np.cumsum(lengths) - 1
    text = symbols[np.minimum(at, len(symbols) - 1)]
    text[ends] = 1
    index = FMIndex(text, block.size)
    document = np.searchsorted(starts, at, "right") - 1
    change = np.zeros(len(text) + 1, np.int64)
    for length, (windows, owners) in block.by_length.items():
        low, high = index.search(windows)
        hits = np.flatnonzero(high > low)
        some = high[hits] - low[hits]
        for part in np.split(hits, np.flatnonzero(np.diff(np.cumsum(some) // 1_000_000)) + 1):
            many = high[part] - low[part]
            rows = np.repeat(low[part] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            places = index.locate(rows)
            np.add.at(change, places, 1)
            np.add.at(change, places + length, -1)
            pairs = np.unique(document[places] * len(owners) + np.repeat(part, many))
            for pair in pairs.tolist():
                found[pair // len(owners)].update(owners[pair % len(owners)])
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if len(hit):
        where = at[hit]
        cut = np.flatnonzero((np.diff(where) > 1) | (np.diff(document[hit]) > 0)) + 1
        begin, end = where[np.r_[0, cut]], where[np.r_[cut - 1, len(where) - 1]] + 1
        of = document[hit[np.r_[0, cut]]]
        for k in np.unique(of).tolist():
            own = of == k
            spans[k] = np.stack([begin[own], end[own]], 1) - starts[k]
    return counts, spans, found


def cut_words(text: bytes, spans: np.ndarray) -> bytes:
    """``text`` without the words of the spans and what stands between them; a line break marks each cut."""
    places = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, done = [], 0
    for begin, end in spans.tolist():
        out += [text[done : places[begin][0]], b"\n"]
        done = places[end - 1][1]
    return b"".join([*out, text[done:]])


def cleaned(texts: list[bytes], block: Block) -> list[bytes]:
    """Texts without their windows; a cut can bring words together, so what was cut is searched again."""
    todo = range(len(texts))
    texts = list(texts)
    while todo:
        _, spans, _ = shard_hits([texts[k] for k in todo], block)
        todo = [(k, s) for k, s in zip(todo, spans, strict=True) if len(s)]
        for k, s in todo:
            texts[k] = cut_words(texts[k], s)
        todo = [k for k, _ in todo]
    return texts


def _merged(a: list[dict] | None, b: np.ndarray) -> list[dict]:
    spans: list[list[int]] = []
    for s, e in sorted([(x["first"], x["last"]) for x in a or []] + [tuple(x) for x in b.tolist()]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [{"first": s, "last": e} for s, e in spans]


_SPANS = "array<struct<first:bigint,last:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _searched(docs: DataFrame, text_col: str, blocks: Iterator[tuple[Block, bool]]) -> DataFrame:
    """``docs`` and what all blocks find: ``benchmark words``, ``benchmark spans`` and ``benchmark items``.

    One block at a time is at the driver and at the tasks: before the next one comes, what was found is written.
    """
    sc, names = docs.sparkSession.sparkContext, docs.columns
    at = names.index(text_col)
    now = docs.withColumns({"benchmark words": F.lit(0).cast("bigint"), "benchmark spans": F.lit(None).cast(_SPANS), "benchmark items": F.lit(None).cast("array<string>")})
    schema = now.schema
    for block, last in blocks:
        shared = sc.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = byte_values(batch.column(at))
                for a, b in in_slices(texts, SHARD_BYTES):
                    counts, spans, found = shard_hits(texts[a:b], shared.value)
                    part = batch.slice(a, b - a)
                    seen, had = (part.column(len(names) + k).to_pylist() for k in (1, 2))
                    out = [
                        pa.array(counts, pa.int64()),
                        pa.array([_merged(x, y) for x, y in zip(seen, spans, strict=True)], _SPAN_TYPE),
                        pa.array([sorted({*(x or ()), *y}) for x, y in zip(had, found, strict=True)], pa.list_(pa.string())),
                    ]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *out], part.schema.names)
                release()
            trim()

        now = now.mapInArrow(search, schema)
        if not last:
            now = written(now, "searched")
            shared.destroy()
    return now


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, words: int = ITEM_WORDS) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans (words first..last-1 inside windows of items), items (sorted item ids)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _searched(rows, "text", item_blocks(items, item_id, item_text, window, words))
    return found.select(F.col("id").alias(id_col), F.col("benchmark words").alias("n_words"), F.col("benchmark spans").alias("spans"), F.col("benchmark items").alias("items"))


def _cut_once(docs: DataFrame, text_col: str, blocks: Iterator[tuple[Block, bool]]) -> DataFrame:
    """``docs``, the spans of all blocks on the same text cut at once, and ``was cut``."""
    found = _searched(docs, text_col, blocks).drop("benchmark words", "benchmark items")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.columns[:-1], batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if t is None else cut_words(t.encode(), np.array([(x["first"], x["last"]) for x in m])).decode() if m else t for t, m in zip(columns[at].to_pylist(), spans, strict=True)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(m) for m in spans], pa.bool_())], [*batch.schema.names[:-1], "was cut"])

    return found.mapInArrow(cut, docs.withColumn("was cut", F.lit(False)).schema)


def remove_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, words: int = ITEM_WORDS) -> DataFrame:
    """``docs`` with all columns, the words of every window of an item cut out of the text. A null text stays null.

    Blocks don't show in the result: the spans of all are cut at once, and texts that were cut are searched again by all
    until none changes. One block does that inside its tasks; several write each round."""
    sc = docs.sparkSession.sparkContext
    fields = docs.columns
    blocks = lambda: item_blocks(items, item_id, item_text, window, words)
    first, only = next(blocks())
    if not only:
        done = None
        while True:
            round_ = written(_cut_once(docs, text_col, blocks()), "cut")
            whole = round_.where("not `was cut`").select(*fields)
            done = whole if done is None else done.unionByName(whole)
            docs = round_.where("`was cut`").select(*fields)
            if docs.isEmpty():
                return done
    shared = sc.broadcast(first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, was = byte_values(batch.column(at)), batch.column(at).is_null().to_pylist()
            for a, b in in_slices(texts, SHARD_BYTES):
                new = cleaned(texts[a:b], shared.value)
                column = pa.array([None if w else x.decode() for x, w in zip(new, was[a:b], strict=True)], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([column if k == at else part.column(k) for k in range(part.num_columns)], part.schema.names)
            release()
        trim()

    return docs.mapInArrow(cut, docs.schema).select(*fields)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the item ids for each row of ``find_benchmark``."""
    width: Column = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        id_col,
        "n_words",
        width.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (width > 0).alias("contaminated"),
    )
