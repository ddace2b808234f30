"""Cross-tokenizer alignment of byte-level BPE (A) and SentencePiece (B) tokens.

Each text is encoded as space + text by A and as text by B, which puts the space there itself. Token bytes: the decoded
entry (A); the piece in UTF-8, U+2581 as space, <0xHH> as that byte (B). Byte offsets where tokens of both end cut them
into groups. A link is a pair of token occurrences whose bytes overlap; the count of an id pair is the number of documents
that hold it linked.

How it runs:

1. One narrow pass encodes and aligns. A text is cut into units before a blank that follows no white space: no token of
   either tokenizer goes over such a place, so each distinct unit is encoded once. Written are the packed ids of each
   slice, and for each task its distinct pairs with the number of its documents that hold them, dealt over shards by hash.
2. A task builds a minimal perfect hash of each shard's distinct pairs (``perfect_hash``) and keeps the pairs in the order
   of their numbers. Blocks of at most about ``BLOCK`` pairs are bounded broadcasts, one at a time.
3. The pairs of each task become dense count vectors indexed by the hash, which are added up as a tree.
4. A second narrow pass aligns the packed ids again and looks up each link's count; a pair counts where the key kept at its
   number is the pair. With several blocks their sums are added by row.

The highest count of each A id has at most as many rows as A has ids.

Null and empty texts have no tokens, nor has a text whose joined bytes of A or B differ from space + text (U+2581 inside):
all numbers are 0 and the groups empty. Repeated rows count as documents of their own. Ids are only passed on. Special
tokens' strings are plain text. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import perfect_hash
from sensorloom.llm.perfect_hash import Hashed, shard_of
from sensorloom.llm.pieces import _SPACE, _classes
from sensorloom.llm.slices import buckets_for, packed, trim, unpacked
from sensorloom.llm.token_table import slices_of
from sensorloom.llm.vectors import SCHEMA, pack, tree_sum, unpack
from sensorloom.llm.vectors import _ARROW as VECTOR
from sensorloom.session import written

SLICE_BYTES = 1_000_000
#: Distinct units a worker keeps the ids of.
CACHE = 200_000
#: Bytes of new units that are encoded as one text.
JOINED = 20_000
#: Distinct pairs a task holds before it passes them on.
PAIRS = 1_000_000
#: Pairs of a block: about 9 bytes each when it is sent.
BLOCK = 4_000_000


class Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        ranked = _ranked(path_a)
        #: Ids of A of a long text.
        self.encode_a = ranked.encode_ordinary if ranked else lambda text: self.a.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        entries, of_char = self.a.get_vocab(with_added_tokens=True), _bytes_of_chars()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(map(of_char.get, entry)) if all(c in of_char for c in entry) else entry.encode()
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank = [self.b.piece_to_id("▁")]
        self.forget()

    def forget(self) -> None:
        """Empties what is kept of units: their places, ids, numbers of ids, and which aren't what they spell."""
        self.known: dict[bytes, int] = {}
        self.ids: tuple[list[bytes], list[bytes]] = ([], [])
        self.sizes = np.zeros((0, 2), np.int32)
        self.bad: set[int] = set()

    def both(self, units: list[bytes]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and B for units that begin with a blank, and whether both spell the unit."""
        texts = [u.decode() for u in units]
        out = []
        for unit, a, b in zip(units, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            a, b = a.ids, b or (self.blank if unit == b" " else b)
            out.append((a, b, b"".join(map(self.bytes_a.__getitem__, a)) == unit == b"".join(map(self.bytes_b.__getitem__, b))))
        return out

    def _keep(self, units: list[bytes], a: list[bytes], b: list[bytes], sizes: np.ndarray) -> None:
        first = len(self.sizes)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.ids[0].extend(a)
        self.ids[1].extend(b)
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])

    def learn(self, units: list[bytes]) -> None:
        """Units that follow each other are encoded as one text, which no token crosses a unit of; what doesn't come out as it
        went in, or ends in white space, is encoded by itself."""
        if len(self.known) > CACHE:
            self.forget()
        new, alone = [], []
        for unit in set(units).difference(self.known):
            (alone if unit[-1:].isspace() or unit[-1] > 127 and unit.decode()[-1].isspace() else new).append(unit)
        ends = np.cumsum([len(u) for u in new]) if new else np.empty(0, np.int64)
        cuts = np.flatnonzero(np.diff(ends // JOINED)) + 1
        for part in np.split(np.arange(len(new)), cuts):
            if len(part) and not self._learn_joined(new[part[0] : part[-1] + 1]):
                alone += new[part[0] : part[-1] + 1]
        if alone:
            found = self.both(alone)
            self.bad.update(len(self.sizes) + k for k, (_, _, good) in enumerate(found) if not good)
            self._keep(alone, *([np.array(f[j], "<u4").tobytes() for f in found] for j in (0, 1)), np.array([(len(a), len(b)) for a, b, _ in found]))

    def _learn_joined(self, units: list[bytes]) -> bool:
        joined = b"".join(units)
        text = joined.decode()
        ends, ids, sizes = np.cumsum([len(u) for u in units]), [], []
        for got, spell, length in ((self.encode_a(text), self.bytes_a, self.length_a), (self.b.encode(text[1:]), self.bytes_b, self.length_b)):
            if b"".join(map(spell.__getitem__, got)) != joined:
                return False
            got = np.array(got, "<u4")
            places = np.cumsum(length[got])
            last = np.searchsorted(places, ends)
            if (places[last] != ends).any():
                return False
            bounds = np.r_[0, last + 1]
            data, at = got.tobytes(), (4 * bounds).tolist()
            ids.append([data[x:y] for x, y in zip(at, at[1:])])
            sizes.append(np.diff(bounds))
        self._keep(units, *ids, np.stack(sizes, 1))
        return True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts, and where each text's begin (with the end)."""
        units, bounds = split_units(texts)
        self.learn(units)
        at = list(map(self.known.__getitem__, units))
        if self.bad and not self.bad.isdisjoint(at):
            return self._one_by_one(texts, at, bounds)
        a, b = (np.frombuffer(b"".join(map(t.__getitem__, at)), "<u4").astype(np.int64) for t in self.ids)
        starts = np.r_[np.zeros((1, 2), np.int64), np.cumsum(self.sizes[np.array(at, np.int64)], 0, dtype=np.int64)][bounds]
        return a, b, starts[:, 0], starts[:, 1]

    def _one_by_one(self, texts: list[str], at: list[int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``; a text with a bad unit is encoded as a whole, and has no tokens if that is bad too."""
        out, starts = ([], []), ([0], [0])
        for k, text in enumerate(texts):
            own = at[bounds[k] : bounds[k + 1]]
            if self.bad.isdisjoint(own):
                ids = [b"".join(map(t.__getitem__, own)) for t in self.ids]
            else:
                a, b, good = self.both([b" " + text.encode()])[0]
                ids = [np.array(x if good else [], "<u4").tobytes() for x in (a, b)]
            for j in (0, 1):
                out[j].append(ids[j])
                starts[j].append(starts[j][-1] + len(ids[j]) // 4)
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in out)
        return a, b, np.array(starts[0]), np.array(starts[1])


@functools.cache
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """One pair of tokenizers for each Python worker."""
    return Tokenizers(path_a, path_b)


def _ranked(path: str):
    """The same tokenizer by tiktoken, which is several times faster on new words: where the file says that a merge's place
    tells its id, merges by least id are merges in order. Else none."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, of_char = model["vocab"], _bytes_of_chars()
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
    plain = len(of_char)
    if any(vocab.get(m.replace(" ", "")) != plain + k for k, m in enumerate(merges)):
        return None
    ranks = {bytes(map(of_char.get, entry)): k for entry, k in vocab.items() if k < plain + len(merges)}
    if len(ranks) != plain + len(merges):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level entries spell bytes as characters: printable Latin-1 as itself, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [k for k in range(256) if k not in set(plain)]
    return {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def split_units(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Units of the texts (none for an empty text) as UTF-8, each with its blank, and where each text's begin."""
    whole = [" " + t if t else "" for t in texts]
    begins = np.r_[0, np.cumsum([len(t) for t in whole])].astype(np.int64)
    joined = "".join(whole)
    if not joined:
        return [], np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cut = np.zeros(len(chars) + 1, bool)
    cut[1:-1] = (chars[1:] == 32) & (_classes()[chars[:-1]] != _SPACE)
    cut[begins] = True
    at = np.flatnonzero(cut[:-1])
    raw = np.frombuffer(joined.encode(), np.uint8)
    byte_at = at if len(raw) == len(chars) else np.flatnonzero((raw & 0xC0) != 0x80)[at]
    # Byte 255 isn't in UTF-8: one before each unit, and split there.
    out = np.full(len(raw) + len(at), 255, np.uint8)
    body = np.ones(len(out), bool)
    body[byte_at + np.arange(len(at))] = False
    out[body] = raw
    return out.tobytes().split(b"\xff")[1:], np.searchsorted(at, begins)


class Aligned:
    """Tokens of A and B of some documents side by side."""

    def __init__(self, a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b, self.starts_a, self.starts_b = a, b, starts_a, starts_b
        end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        begin_a, begin_b = end_a - length_a[a], end_b - length_b[b]
        #: Whether a token is the last of its group.
        self.last_a = end_b[np.searchsorted(end_b, end_a)] == end_a if len(a) else np.empty(0, bool)
        self.last_b = end_a[np.searchsorted(end_a, end_b)] == end_b if len(b) else np.empty(0, bool)
        first = np.searchsorted(end_b, begin_a, "right")
        many = np.searchsorted(begin_b, end_a, "left") - first
        ends = np.cumsum(many)
        #: Where the links of each document begin, with the end.
        self.link_bounds = np.r_[0, ends][starts_a]
        self.link_a = np.repeat(a, many)
        self.link_b = b[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(a) else 0)]

    def groups(self) -> np.ndarray:
        """Number of groups of each document."""
        return np.diff(np.r_[0, np.cumsum(self.last_a)][self.starts_a])

    def spelled(self) -> list[bytes]:
        """Each document's groups: ids of A by commas, a bar, ids of B by commas, a semicolon between groups."""
        group_a, group_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))
        # A's tokens of a group stand before B's, behind all of the groups before.
        before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=1))]
        before_a = np.r_[0, np.cumsum(np.bincount(group_a, minlength=1))]
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
        for token, place, last, end in ((self.a, np.arange(len(self.a)) + before_b[group_a], self.last_a, b"|"), (self.b, np.arange(len(self.b)) + before_a[group_b + 1], self.last_b, b";")):
            ids[place] = token
            mark[place] = np.where(last, end[0], b","[0])
        wide = len(str(int(ids.max(initial=0))))
        digits = np.empty((n, wide + 1), np.uint8)
        digits[:, wide] = mark
        there = np.ones((n, wide + 1), bool)
        rest, count = ids.astype(np.uint32), np.full(n, wide + 1)
        for k in range(wide - 1, -1, -1):
            if k < wide - 1:
                there[:, k] = rest > 0
                count -= rest == 0
            tens = rest // np.uint32(10)
            digits[:, k] = rest - tens * np.uint32(10) + np.uint32(48)
            rest = tens
        ends = np.r_[0, np.cumsum(count)][self.starts_a + self.starts_b]
        data = digits[there].tobytes()
        return [data[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _packed_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _encoded(path_a: str, path_b: str, shards: int):
    """Rows of slices (base, payload) and of pairs (shard, part, keys, counts)."""
    names = ["base", "payload", "shard", "part", "keys", "counts"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def rows(**data: list) -> pa.RecordBatch:
        n = len(next(iter(data.values())))
        return pa.RecordBatch.from_arrays([pa.array(data.get(c, [None] * n), t) for c, t in zip(names, types, strict=True)], names)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        heads = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0]) if len(keys) else np.empty(0, np.int64)
        return keys[order][heads], np.add.reduceat(counts[order], heads) if len(keys) else counts

    def dealt(keys: np.ndarray, counts: np.ndarray, part: int) -> pa.RecordBatch:
        shard = shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        full, first = np.unique(shard[order], return_index=True)
        cuts = list(zip(first.tolist(), np.r_[first, len(keys)][1:].tolist(), strict=True))
        return rows(shard=full.tolist(), part=[part] * len(full), keys=[keys[order[x:y]].astype("<u8").tobytes() for x, y in cuts], counts=[pack(counts[order[x:y]]) for x, y in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = tokenizers_of(path_a, path_b), TaskContext.get().partitionId()
        wide, base, held, size = len(both.bytes_b), part << 33, [], 0
        for batch in batches:
            for x, y, _, _ in slices_of(batch["text"], SLICE_BYTES):
                a, b, starts_a, starts_b = both.encode(batch["text"].slice(x, y - x).to_pylist())
                found = Aligned(a, b, starts_a, starts_b, both.length_a, both.length_b)
                of = np.repeat(np.arange(y - x), np.diff(found.link_bounds))
                # Each pair once a document.
                own = np.unique(of * (len(both.bytes_a) * wide) + found.link_a * wide + found.link_b)
                held.append(np.unique(own % (len(both.bytes_a) * wide), return_counts=True))
                size += len(held[-1][0])
                if size > PAIRS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > PAIRS // 2:
                        yield dealt(*held[0], part)
                        held, size = [], 0
                columns = [batch["id"].slice(x, y - x), pa.array(np.diff(starts_a)), pa.array(np.diff(starts_b))]
                ids = [pa.array([_packed_ids(t[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()) for t, at in ((a, starts_a), (b, starts_b))]
                yield rows(base=[base], payload=[packed(pa.RecordBatch.from_arrays([*columns, *ids], ["id", "n_a", "n_b", "a", "b"]))])
                base += 1
        if held:
            yield dealt(*merged(held), part)
        trim()

    return run, "base bigint, payload binary, shard bigint, part bigint, keys binary, counts binary"


def _shard(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's perfect hash, and its keys in the order of their numbers."""
    shard = key[0].as_py()
    keys = np.unique(np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8"))
    built = perfect_hash.build(keys)
    ordered = np.empty(len(keys), "<u8")
    alone = Hashed(0, 1, [built])
    ordered[alone.of(keys)] = keys
    return pa.Table.from_arrays([pa.array([shard], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([pickle.dumps(built)], pa.binary()), pa.array([ordered.tobytes()], pa.binary())], ["shard", "n", "built", "keys"])


def _vectors(shared):
    """A dense vector of its shard for each row of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for shard, part, keys, counts in zip(*(batch[c].to_pylist() for c in ("shard", "part", "keys", "counts")), strict=True):
                k = shard - table.first
                dense = np.zeros(table.bounds[k + 1] - table.bounds[k], np.int64)
                dense[table.of(np.frombuffer(keys, "<u8")) - table.bounds[k]] = unpack(counts)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([shard], pa.int64()), pa.array([part], pa.int64()), pa.array([pack(dense)], pa.binary())], schema=VECTOR)

    return run


def _best(wide: int):
    """(a, best) of each A id in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, payload in zip(batch["keys"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                a, counts = np.frombuffer(keys, "<u8").astype(np.int64) // wide, unpack(payload)
                order = np.lexsort((counts, a))
                last = np.flatnonzero(np.r_[a[order][1:] != a[order][:-1], True])
                yield pa.RecordBatch.from_arrays([pa.array(a[order][last]), pa.array(counts[order][last])], ["a", "best"])

    return run


class Block:
    """What the second pass looks up for the pairs of some shards."""

    def __init__(self, hashed: Hashed, keys: np.ndarray, counts: np.ndarray):
        narrow = keys.max(initial=0) < 1 << 32
        self.hashed, self.keys = hashed, keys.astype("<u4") if narrow else keys
        self.counts = counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair; 0 for those of other blocks."""
        at = self.hashed.of(keys)
        at[at >= 0] = np.where(self.keys[at[at >= 0]] == keys[at >= 0].astype(self.keys.dtype), at[at >= 0], -1)
        out = np.zeros(len(keys), np.int64)
        out[at >= 0] = self.counts[at[at >= 0]]
        return out


def _looked_up(path_a: str, path_b: str, shared, best, first: bool, spelled: bool):
    """Rows of documents from packed ids: the sums over this block's links and, in the ``first`` block, all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(path_a, path_b)
        block, most, wide = shared.value, best.value, len(both.bytes_b)
        for batch in batches:
            for base, payload in zip(batch["base"].to_pylist(), batch["payload"], strict=True):
                rows = unpacked(payload.as_buffer())
                ids = []
                for c in ("a", "b"):
                    n, packs = rows[f"n_{c}"].to_numpy(), rows[c].to_pylist()
                    parts = [np.frombuffer(p, "<u2" if len(p) == 2 * m else "<u4") for p, m in zip(packs, n.tolist(), strict=True)]
                    ids += [np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64), np.r_[0, np.cumsum(n)]]
                found = Aligned(ids[0], ids[2], ids[1], ids[3], both.length_a, both.length_b)
                counts = block.of(found.link_a * wide + found.link_b)
                sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][found.link_bounds])  # noqa: B023, E731
                n = rows.num_rows
                out = [pa.array(np.full(n, base)), pa.array(np.arange(n)), pa.array(sums((counts > 0) & (counts == most[found.link_a]))), pa.array(sums(counts))]
                if first:
                    texts = found.spelled()
                    out += [rows["id"], rows["n_a"], rows["n_b"], pa.array(found.groups()), pa.array(np.diff(found.link_bounds)), pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts])]
                    if spelled:
                        out.append(pa.array([t.decode() for t in texts]))
                names = ["base", "row", "n_best", "count_sum", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
                yield pa.RecordBatch.from_arrays(out, names[: len(out)])
        trim()

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spelled: bool = False, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id),
    count_sum (over links), groups_sha256, and with ``spelled`` groups."""
    spark = docs.sparkSession
    sc, kind = spark.sparkContext, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards, parts = buckets_for(rows), rows.rdd.getNumPartitions()
    run, schema = _encoded(path_a, path_b, shards)
    encoded = written(rows.mapInArrow(run, schema), "encoded")
    pairs = encoded.where("shard is not null").select("shard", "part", "keys", "counts")
    slices = encoded.where("base is not null").select("base", "payload")
    hashes = written(pairs.select("shard", "keys").groupBy("shard").applyInArrow(_shard, "shard bigint, n bigint, built binary, keys binary"), "hashes")
    # Runs of shards that hold a block's pairs at most (or are one shard).
    blocks: list[list[int]] = []
    sizes = {r["shard"]: r["n"] for r in hashes.select("shard", "n").toLocalIterator()}
    for shard in range(shards):
        if not blocks or sum(sizes.get(s, 0) for s in blocks[-1]) + sizes.get(shard, 0) > block:
            blocks.append([])
        blocks[-1].append(shard)
    wide = len(tokenizers_of(path_a, path_b).bytes_b)
    summed = None
    for own in blocks:
        shared = sc.broadcast(_hashed(hashes, own, shards))
        some = pairs.where(F.col("shard").between(own[0], own[-1]))
        vectors = written(tree_sum(some.mapInArrow(_vectors(shared), SCHEMA), parts).select(F.col("chunk").alias("shard"), "payload"), "counts")
        shared.destroy()
        summed = vectors if summed is None else summed.unionByName(vectors)
    tops = summed.join(hashes.select("shard", "keys"), "shard").select("keys", "payload").mapInArrow(_best(wide), "a bigint, best bigint").groupBy("a").agg(F.max("best").alias("best"))
    most = np.zeros(len(tokenizers_of(path_a, path_b).bytes_a), np.int64)
    for r in tops.collect():
        most[r["a"]] = r["best"]
    best = sc.broadcast(most)
    out, more = None, []
    for own in blocks:
        kept = {r["shard"]: (bytes(r["keys"]), bytes(r["payload"])) for r in summed.join(hashes.select("shard", "keys"), "shard").where(F.col("shard").between(own[0], own[-1])).toLocalIterator()}
        keys = np.frombuffer(b"".join(kept[s][0] for s in own if s in kept), "<u8")
        counts = np.concatenate([unpack(kept[s][1]) for s in own if s in kept]) if kept else np.empty(0, np.int64)
        shared = sc.broadcast(Block(_hashed(hashes, own, shards), keys, counts))
        del kept, keys, counts
        first = own is blocks[0]
        names = "base bigint, row bigint, n_best bigint, count_sum bigint"
        if first:
            names += f", id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string" + ", groups string" * spelled
        got = slices.mapInArrow(_looked_up(path_a, path_b, shared, best, first, spelled), names)
        if len(blocks) > 1:
            got = written(got, "links")
            shared.destroy()
        if first:
            out = got
        else:
            more.append(got)
    if more:
        sums = functools.reduce(DataFrame.unionByName, more).groupBy("base", "row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
        out = out.join(sums, ["base", "row"]).withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if spelled else []))


def _hashed(hashes: DataFrame, own: list[int], shards: int) -> Hashed:
    """The hash of the shards of one block."""
    built = {r["shard"]: pickle.loads(bytes(r["built"])) for r in hashes.where(F.col("shard").between(own[0], own[-1])).select("shard", "built").toLocalIterator()}
    return Hashed(own[0], shards, [built.get(s, ([], b"")) for s in own])
