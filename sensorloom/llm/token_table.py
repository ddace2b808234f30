"""Sets of word shingles for whole texts or for their lines, and which of their tokens other sets hold too.

A set holds the distinct shingles of ``k`` words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of a unit: a text, or a line
of it. With fewer words the whole sequence is its one shingle; without words the set is empty. Tokens are 64-bit hashes
of shingles, made for a whole slice of texts at once: a hash of a word is a sum over its bytes, so all words follow from
one running sum.

How tokens meet:

1. A task cuts its texts into slices of about ``SLICE_BYTES``, and sends the tokens of a slice packed by hash bucket.
   Equal sets of a slice are sent once. A token that ``HOT`` sets or more of a slice hold is summed up before it is sent,
   so what a bucket gets of one token grows with the slices, not with its holders.
2. Buckets count tokens and send those of two sets or more back to their slice.
3. A slice puts the tokens of each set in order of rarity and keeps prefixes. A set without enough shared tokens for any
   partner keeps none.

The number of buckets follows the input without a bound, so a bucket or slice holds as much at any size.
"""

from __future__ import annotations

import functools
import operator
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.memory import release, releasing, trim
from sensorloom.session import written

K = 5
NUM, DEN = 3, 4
SLICE_BYTES = 1_000_000
#: Holders in one slice from which on a token is summed up before it is sent.
HOT = 8
#: Buckets for each input partition.
BUCKETS = 8
_PACK, _PACKED = "<qI", 12
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: An odd number whose powers tell the places of a word's bytes.
_BASE = 0xA24BAED4963EE407


@functools.cache
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(SLICE_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** place, and its inverse, for n places."""
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salts: tuple[int, ...] = (1, 2), lower: bool = True) -> tuple[np.ndarray, ...]:
    """64-bit hashes of words, by default two that don't depend on each other: sums of value[byte] * base ** place over a
    word's bytes, mixed, for a table of values each."""
    up, down = _slice_powers() if len(raw) <= SLICE_BYTES else _powers(len(raw))
    up, down, later, out = up[: len(raw)], down[begin], begin > 0, []
    for salt in salts:
        # Upper case has the values of lower case, unless it counts.
        values = mix(np.arange(256, dtype=np.uint64), salt)
        sums = (values[_LOW] if lower else values)[raw]
        sums *= up
        np.cumsum(sums, out=sums)
        own = sums[end - 1]
        own[later] -= sums[begin[later] - 1]
        out.append(mix(own * down, salt))
    return tuple(out)


def line_starts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each line (split at x0A) and the text it is in; ``starts``: first byte of each text, and the end."""
    after = np.flatnonzero(raw == 10) + 1
    at = np.r_[after, starts[:-1]]
    of = np.r_[np.searchsorted(starts[:-1], after - 1, "right") - 1, np.arange(len(starts) - 1)]
    order = np.lexsort((at, of))
    return at[order], of[order]


class Sets:
    """The sets of the units of a slice: tokens in order of units, their unit, and for each unit size and two prints."""

    def __init__(self, raw: np.ndarray, texts: np.ndarray, units: np.ndarray, k: int):
        """``texts``: first byte of each text, and the end; ``units``: first byte of each unit, in order."""
        word = ~_WHITE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[texts] = True
        begin = np.flatnonzero(word & (cut[:-1] | ~np.r_[False, word[:-1]]))
        end = np.flatnonzero(word & (cut[1:] | ~np.r_[word[1:], False])) + 1
        bounds = np.r_[np.searchsorted(begin, units), len(begin)]
        counts = np.diff(bounds)
        first, second = word_hashes(raw, begin, end) if len(begin) else (np.empty(0, np.uint64),) * 2
        left = np.repeat(bounds[1:], counts) - np.arange(len(begin))
        valid = left >= k
        short = {c: bounds[:-1][counts == c] for c in range(1, k)}
        tokens, other = (self._shingles(x, k, short) for x in (first, second))
        for at in short.values():
            valid[at] = True
        owner = np.repeat(np.arange(len(units)), counts)[valid]
        tokens, other = tokens[valid], other[valid]
        self.order = np.argsort(tokens)
        again = self._again(tokens, owner)
        #: Whether a token is the first of its kind in its unit.
        self.distinct = ~again
        self.tokens, self.owner = tokens, owner
        self.sizes = np.bincount(owner[self.distinct], minlength=len(units))
        ends = np.searchsorted(owner, np.arange(len(units) + 1))
        prints = []
        for x, salt in ((tokens, 11), (other, 12)):
            sums = np.r_[np.uint64(0), np.cumsum(np.where(again, np.uint64(0), mix(x, salt)))]
            prints.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
        self.prints = prints
        self.ends = ends

    def sketch(self, words: int) -> list[np.ndarray]:
        """For each unit 64 * ``words`` bits: whether an odd number of its tokens falls on a bit. Two sets differ in at least
        as many tokens as their sketches differ in bits."""
        bit = mix(self.tokens[self.distinct], 31)
        starts = np.r_[0, np.cumsum(self.sizes)][:-1]
        full = np.flatnonzero(self.sizes)
        one, out = np.uint64(1) << (bit & np.uint64(63)), []
        for k in range(words):
            value = np.zeros(len(self.sizes), np.uint64)
            if len(full):
                value[full] = np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) % np.uint64(words) == np.uint64(k), one, np.uint64(0)), starts[full])
            out.append(value.view(np.int64))
        return out

    @staticmethod
    def _shingles(words: np.ndarray, k: int, short: dict[int, np.ndarray]) -> np.ndarray:
        """At each word the hash of the k words from there on; at the first word of a short unit that of all its words."""
        n, times = len(words), np.uint64(0xD1342543DE82EF95)
        rolled = words.copy()
        whole = {1: words[short[1]] if 1 in short else words[:0]}
        for j in range(1, k):
            if n > j:
                rolled[: n - j] = rolled[: n - j] * times + words[j:]
            if j + 1 < k:
                whole[j + 1] = rolled[short[j + 1]]
        rolled = mix(rolled, k)
        for c, at in short.items():
            rolled[at] = mix(whole[c], 100 + c)
        return rolled

    def _again(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Marks repeats of a token in its unit."""
        again = np.zeros(len(tokens), bool)
        ranked = tokens[self.order]
        equal = ranked[1:] == ranked[:-1]
        if equal.any():
            member = np.r_[False, equal] | np.r_[equal, False]
            at, group = self.order[member], np.cumsum(np.r_[True, ~equal])[member]
            by = np.lexsort((at, owner[at], group))
            at, group = at[by], group[by]
            again[at[1:][(group[1:] == group[:-1]) & (owner[at[1:]] == owner[at[:-1]])]] = True
        return again

    def new(self) -> np.ndarray:
        """Marks units whose set no earlier unit of the slice has."""
        _, first, which = np.unique(self.prints[0], return_index=True, return_inverse=True)
        like = first[which]
        return (like == np.arange(len(like))) | (self.prints[1] != self.prints[1][like]) | (self.sizes != self.sizes[like])


def _packed_counts(counts: np.ndarray) -> bytes:
    """Tokens of each unit in a bucket: mostly 0 and 1, so one byte each where they fit, and compressed."""
    width = 1 if counts.max(initial=0) < 256 else 4
    body = zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())
    return struct.pack("<BI", width, len(body)) + body


def _unpacked_counts(payload: bytes, at: int) -> tuple[np.ndarray, int]:
    """The counts that stand at that place, and where they end."""
    width, size = struct.unpack_from("<BI", payload, at)
    body = zstandard.ZstdDecompressor().decompress(payload[at + 5 : at + 5 + size])
    return np.frombuffer(body, f"<u{width}").astype(np.int64), at + 5 + size


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _low_bytes(tokens: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def _bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _low(tokens: np.ndarray, width: int) -> np.ndarray:
    return tokens & np.uint64((1 << 8 * width) - 1)


def _named(low: np.ndarray, part: int | np.ndarray) -> np.ndarray:
    """A token's name: its low bytes and its bucket (a hash of it where buckets are more than 16 bits tell)."""
    part = np.atleast_1d(np.asarray(part, np.uint64))
    return low | np.where(part < np.uint64(1 << 16), part, mix(part, 5) & np.uint64(0xFFFF)) << np.uint64(48)


_SENT = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def slices_of(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, first byte of each text and the end) of slices; null as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _send(buckets: int, k: int, num: int, den: int, lines: bool, width: int, sketch: int):
    """Map side: for each slice one row for its units and one for each bucket of tokens, ``width`` bytes a token."""

    def rows_of(base: int, head: pa.RecordBatch, sets: Sets) -> Iterator[tuple[int, int, int, bytes]]:
        n = head.num_rows
        # Sets that only equal sets can be similar to send nothing: prints tell those. A partner can have fewer or more tokens.
        sent = sets.new() & ((sets.sizes > -(-sets.sizes * num // den)) | (sets.sizes * den // num > sets.sizes))
        mask = sets.distinct & sent[sets.owner]
        ranked = sets.order[mask[sets.order]]
        values = sets.tokens[ranked]
        heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        many = np.diff(np.r_[heads, len(values)])
        hot = many >= HOT
        member = ranked[np.repeat(hot, many)]
        hot_tokens, hot_counts, hot_owners = values[heads[hot]], many[hot], sets.owner[member].astype("<u4")
        body = _stream(head)
        sizes = struct.pack("<QI", len(body), len(hot_tokens))
        yield base % buckets, base, -1, struct.pack(_PACK, base, n) + sizes + body + _named(_low(hot_tokens, width), _bucket_of(hot_tokens, buckets)).tobytes() + hot_counts.astype("<u4").tobytes() + hot_owners.tobytes()
        mask[member] = False
        tokens, owner = np.r_[sets.tokens[mask], hot_tokens], np.r_[sets.owner[mask], np.full(len(hot_tokens), n)]
        weights = np.r_[np.zeros(mask.sum(), np.int64), hot_counts]
        bucket = _bucket_of(tokens, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        tokens, owner, bucket, weights = tokens[order], owner[order], bucket[order], weights[order]
        full, first = np.unique(bucket, return_index=True)
        for j, a, b in zip(full.tolist(), first.tolist(), np.r_[first, len(tokens)][1:].tolist(), strict=True):
            counts = np.bincount(owner[a:b], minlength=n + 1)
            yield j, base, j, struct.pack(_PACK, base, n) + _packed_counts(counts) + _low_bytes(tokens[a:b], width) + weights[b - counts[n] : b].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            carried = [c for c in batch.schema.names if c != "text"]
            for a, b, raw, texts in slices_of(batch["text"]):
                units, of = line_starts(raw, texts) if lines else (texts[:-1], np.arange(b - a))
                sets = Sets(raw, texts, units, k)
                head = batch.select(carried).slice(a, b - a).take(pa.array(of))
                for name, column in (("n", sets.sizes.astype(np.int64)), ("f1", sets.prints[0]), ("f2", sets.prints[1]), *((f"s{j}", x) for j, x in enumerate(sets.sketch(sketch)))):
                    head = head.append_column(name, pa.array(column))
                if lines:
                    place = np.arange(len(of)) - np.searchsorted(of, of)
                    head = head.append_column("line", pa.array(place.astype(np.int32)))
                rows = list(rows_of(base, head, sets))
                base += len(of)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_SENT.types)], schema=_SENT)
                del head, rows, sets, units, of
            release()
        trim()

    return run


_COUNTED = pa.schema([("base", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def _reply(place: np.ndarray, many: np.ndarray, token: np.ndarray, width: int) -> bytes:
    """Places, frequencies (at most 65535: beyond, tokens count as equally frequent in every set) and tokens."""
    size = 2 if not len(place) or int(place.max()) < 1 << 16 else 4
    return bytes([size]) + place.astype(f"<u{size}").tobytes() + np.minimum(many, 65_535).astype("<u2").tobytes() + _low_bytes(token, width)


def _count(width: int):
    """One bucket: tokens held by two sets or more, back to their slices with frequencies; rows of units pass."""

    def run(table: pa.Table) -> pa.Table:
        rows, bases, places, tokens, weights, part_of = [], [], [], [], [], -1
        for base, part, payload in zip(*(table[c].to_pylist() for c in ("base", "part", "payload")), strict=True):
            if part < 0:
                rows.append((base, part, payload))
                continue
            counts, at = _unpacked_counts(payload, _PACKED)
            n, hot = int(counts.sum()), int(counts[-1])
            bases.append((base, n))
            places.append(np.repeat(np.arange(len(counts), dtype=np.uint32), counts))
            tokens.append(_from_low(payload, at, n, width))
            weights.append(np.r_[np.ones(n - hot, np.uint32), np.frombuffer(payload, "<u4", hot, at + width * n)])
            part_of = part
        if tokens:
            token, place, weight = np.concatenate(tokens), np.concatenate(places), np.concatenate(weights)
            del tokens, places, weights
            batch = np.repeat(np.arange(len(bases), dtype=np.uint32), [n for _, n in bases])
            order = np.argsort(token)
            token = token[order]
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            times = np.diff(np.r_[heads, len(token)])
            many = np.repeat(np.add.reduceat(weight[order].astype(np.int64), heads), times)
            keep = np.flatnonzero(many > 1)
            keep = keep[np.argsort(batch[order[keep]], kind="stable")]
            token, many, order = token[keep], many[keep], order[keep]
            place, batch = place[order], batch[order]
            bounds = np.searchsorted(batch, np.arange(len(bases) + 1))
            for j, (base, _) in enumerate(bases):
                a, b = bounds[j], bounds[j + 1]
                if b > a:
                    rows.append((base, part_of, struct.pack(_PACK, base, b - a) + _reply(place[a:b], many[a:b], token[a:b], width)))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_COUNTED.types)], schema=_COUNTED)

    return releasing(run)


def _orders(token: np.ndarray, many: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sort keys of three global orders, rare tokens first: by frequency; by its power of two; by its power of four."""
    bits = np.frexp(many.astype(float))[1]
    return [(mix(token, 21), many), (mix(token, 22), bits), (mix(token, 23), (bits + 1) // 2)]


def _lists(values: np.ndarray, sizes: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list for each row, null where ``there`` is false."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)), mask=pa.array(~there))


def _gather(num: int, den: int, width: int, orders: int, whole: bool):
    """One slice with all that came back: a row for each unit with words, tokens only where a partner can be."""

    def run(table: pa.Table) -> pa.Table:
        place, many, token, head = [], [], [], b""
        for part, payload in zip(table["part"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if part < 0:
                head = payload
                continue
            _, n = struct.unpack_from(_PACK, payload)
            at, size = _PACKED, payload[_PACKED]
            place.append(np.frombuffer(payload, f"<u{size}", n, at + 1).astype(np.int64))
            many.append(np.frombuffer(payload, "<u2", n, at + 1 + size * n).astype(np.int64))
            token.append(_named(_from_low(payload, at + 1 + (size + 2) * n, n, width), part))
        base, n = struct.unpack_from(_PACK, head)
        body, n_hot = struct.unpack_from("<QI", head, _PACKED)
        at = _PACKED + 12
        carried = pa.ipc.open_stream(pa.py_buffer(head)[at : at + body]).read_all()
        at += body
        hot_counts = np.frombuffer(head, "<u4", n_hot, at + 8 * n_hot).astype(np.int64)
        hot_owners = np.frombuffer(head, "<u4", int(hot_counts.sum()), at + 12 * n_hot).astype(np.int64)
        place, many, token = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((place, np.int64), (many, np.int64), (token, np.uint64)))
        if n_hot:
            # Hot tokens come back once for the slice; their holders are here.
            hot = np.flatnonzero(place == n)
            back = np.empty(n_hot, np.int64)
            back[np.argsort(np.frombuffer(head, "<u8", n_hot, at))] = hot[np.argsort(token[hot])]
            place = np.r_[place[place != n], hot_owners]
            many, token = (np.r_[np.delete(x, hot), np.repeat(x[back], hot_counts)] for x in (many, token))
        sizes = carried["n"].to_numpy()
        shared = np.bincount(place, minlength=n)
        slots = shared - -(-sizes * num // den) + 1
        there = (shared > 0) & (slots > 0)
        mine = there[place]
        place, many, token = place[mine], many[mine], token[mine]
        held, kept = np.where(there, shared, 0), np.where(there, slots, 0)
        first = np.r_[0, np.cumsum(held)]
        out = carried.add_column(0, "key", pa.array(base + np.arange(n), pa.int64()))
        out = out.append_column("m", pa.array(np.where(there, shared, 0), pa.int64()))
        for k, (tie, rarity) in enumerate(_orders(token, many)[:orders]):
            order = np.lexsort((tie, rarity, place))
            if whole and not k:
                out = out.append_column("tokens", _lists(token[order], held, there))
            prefix = np.arange(len(place)) - first[place[order]] < kept[place[order]]
            out = out.append_column(f"p{k + 1}", _lists(token[order][prefix], kept, there))
        return out.filter(pa.compute.greater(out["n"], 0)) if "line" in carried.schema.names else out

    return releasing(run)


def token_table(rows: DataFrame, k: int = K, num: int = NUM, den: int = DEN, lines: bool = False, width: int = 6, orders: int = 3, whole: bool = True, sketch: int = 4) -> DataFrame:
    """A written row for each row of ``rows`` (with ``lines``: for each line with words): a number of its own (key), all
    columns but ``text``, the size of its set (n), the set's prints (f1, f2: equal for equal sets, 128 bits of two
    hashes of each shingle), ``sketch`` words of 64 bits (s0, s1 ...), the number of its tokens that other sets hold (m) where a partner is possible, and then
    those tokens (with ``whole``) and their prefixes p1, p2 ... under so many orders; ``line``: its place from 0.

    A token that is sent is known by its bucket and ``width`` bytes: with 6 by 52 bits or more.
    """
    carried = [c for c in rows.columns if c != "text"]
    buckets = max(16, BUCKETS * rows.rdd.getNumPartitions())
    sent = rows.mapInArrow(_send(buckets, k, num, den, lines, width, sketch), "bucket bigint, base bigint, part bigint, payload binary")
    counted = sent.groupBy("bucket").applyInArrow(_count(width), "base bigint, part bigint, payload binary")
    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    lists = ", ".join(f"{c} array<bigint>" for c in [*(["tokens"] if whole else []), *(f"p{j + 1}" for j in range(orders))])
    bits = "".join(f"s{j} bigint, " for j in range(sketch))
    schema = f"key bigint, {types}n bigint, f1 bigint, f2 bigint, {bits}{'line int, ' if lines else ''}m bigint, {lists}"
    return written(counted.groupBy("base").applyInArrow(_gather(num, den, width, orders, whole), schema), "tokens")


def may_be_similar(a: str, b: str, num: int, den: int, sketch: int) -> Column:
    """What narrow rows (structs with n, left, s0 ...) tell of two sets: their sizes agree, enough tokens are left from
    their first common one on, and their sketches differ in no more bits than similar sets differ in tokens."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    enough = (num + den) * F.least(f"{a}.left", f"{b}.left") >= num * (n1 + n2)
    sizes = den * F.least(n1, n2) >= num * F.greatest(n1, n2)
    bits = functools.reduce(operator.add, (F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(sketch)))
    return enough & sizes & ((num + den) * bits <= (den - num) * (n1 + n2))
