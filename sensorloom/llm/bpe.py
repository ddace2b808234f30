"""Byte-level BPE by ranked merges, and its decoding.

A merge joins the two neighbours whose bytes together have the lowest rank, the leftmost first, until no pair has one. As
the rank of a piece is its id, the map from a pair of ids to the id of both is all that a merge needs.

``folded`` is that fold in Spark's higher-order functions: words are arrays of bytes, the rank map is a hash table without
collisions, as arrays of one row that ``with_tables`` broadcasts to the rows that have words (as literals the arrays would be
spelled out in each description of the plan, which the driver makes again at every stage and keeps), and ``aggregate`` folds the merges over a state that keeps each token with the rank
of its pair, so a merge looks up two pairs only. Every word of up to ``LONG`` bytes is encoded by it, in the stage that
reads the texts: a first step in Python cuts texts into words and numbers those that its task meets, each new word goes
through the fold once, and a second step puts the ids in the places of the numbers. The words most frequent in a bounded
sample are folded beforehand and sent to all tasks; which words these are changes the speed only. The fold's steps grow
with the square of a word's length, so words beyond ``LONG`` bytes are folded by ``fold``, with the same merges.

A null text is empty and has no ids. A null id passes, repeated rows repeat, an empty table gives none. Nothing is shuffled
but the sample's words.

Decoding is ``decoded``, also in higher-order functions: each word's ids become bytes once, beside its fold, and a text's
bytes are those of its words in order. Words beyond ``LONG`` are decoded where they are folded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.memory import release, trim
from sensorloom.llm.pieces import split_pieces
from sensorloom.llm.text import in_slices
from sensorloom.llm.token_store import sampled_texts

#: Words folded beforehand, and the documents they are taken from.
HEAD = 131_072
SAMPLE_DOCS = 4_096
SLICE_BYTES = 2_000_000
#: Distinct words a task keeps the numbers of; beyond it they are dropped but for the head.
CACHE = 250_000
#: Words of a text that are looked up at once.
PART = 100_000
#: Longest word in bytes that is folded by higher-order functions.
LONG = 4_096
#: Hash table of the pairs: a bucket's shift turns the low bits of its pairs into free places.
BUCKETS = 65_537
PLACES = 1 << 18
#: A token of the fold: rank of its pair with the next one (17 bits), place (29 bits), id (17 bits). No id and no rank: NONE.
NONE = (1 << 17) - 1
RANK, PLACE = 46, 17


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each piece: lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def id_pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = load_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


@functools.cache
def pair_ranks(path: str) -> tuple[list[int], dict[int, int], list[bytes]]:
    """Ids of the 256 bytes; (left id << 17 | right id) -> id of both; the bytes of each id."""
    ranks = load_ranks(path)
    pairs = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                pairs[a << 17 | b] = rank
    return [ranks[bytes([k])] for k in range(256)], pairs, id_pieces(path)


@functools.cache
def rank_arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the first byte of each two, tokens of a last byte, shifts of the buckets, entries (pair << 17 | both)."""
    # Not kept: the driver needs the arrays alone.
    first, pairs, _ = pair_ranks.__wrapped__(path)
    twos = [pairs.get(a << 17 | b, NONE) << RANK | a for a in first for b in first]
    keys, both = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    order = np.argsort(keys % BUCKETS, kind="stable")
    keys, both = keys[order], both[order]
    bounds = np.searchsorted(keys % BUCKETS, np.arange(BUCKETS + 1))
    shifts, entries = np.zeros(BUCKETS, np.int64), np.full(PLACES, -1, np.int64)
    rng = np.random.default_rng(0)
    for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
        own = keys[bounds[b] : bounds[b + 1]]
        if not len(own):
            break
        at = own & PLACES - 1
        while (entries[at ^ shifts[b]] >= 0).any():
            shifts[b] = rng.integers(PLACES)
        entries[at ^ shifts[b]] = own << 17 | both[bounds[b] : bounds[b + 1]]
    out = np.array(twos, np.int64), np.array([NONE << RANK | a for a in first], np.int64), shifts, entries
    del pairs, keys, both, order, bounds, twos
    trim()
    return out


def with_tables(rows: DataFrame, path: str, where: Column) -> DataFrame:
    """``rows`` with ``ranks``, the arrays that ``folded`` takes, and ``pieces``, the bytes of each id in hex, where ``where``
    holds; null elsewhere."""
    ranks = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in rank_arrays(path)], ["twos", "lasts", "shifts", "entries"])
    pieces = pa.array([[piece.hex() for piece in id_pieces(path)]], pa.list_(pa.string()))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({"ranks": ranks, "pieces": pieces}))), where, "left")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _with(value: Column, like: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once; the result has the type of ``like``."""
    return F.aggregate(F.array(value), like, lambda _, x: use(x))


def _if(true: Column, a: Column, b: Column) -> Column:
    return F.call_function("if", true, a, b)


def _folded(word: Column, twos: Column, lasts: Column, shifts: Column, entries: Column) -> Column:
    """Ids of one word. The state is an array of tokens; a token's place is that of its first byte, so no merge moves it."""
    n, low17, none = F.size(word), _long(NONE), _long(NONE << RANK)
    gone, end = _long(-1), _long(NONE << RANK | ((1 << 29) - 1) << PLACE | NONE)

    def ranked(pair: Column) -> Column:
        """Rank of the pair of two ids, in its place of a token."""

        def held(p: Column) -> Column:
            at = p.bitwiseAND(_long(PLACES - 1)).bitwiseXOR(F.get(shifts, (p % BUCKETS).cast("int"))).cast("int")
            return _with(F.get(entries, at), _long(0), lambda e: _if(F.shiftright(e, 17) == p, F.shiftleft(e.bitwiseAND(low17), RANK), none))

        return _with(pair, _long(0), held)

    def begun(b: Column, k: Column) -> Column:
        token = _if(k < n - 1, F.get(twos, F.shiftleft(b, 8).bitwiseOR(F.get(word, k + 1))), F.get(lasts, b))
        return token.bitwiseOR(F.shiftleft(k.cast("bigint"), PLACE))

    def merged(tokens: Column, low: Column) -> Column:
        both = F.shiftright(low, RANK)

        def at_place(at: Column) -> Column:
            left = lambda t: ranked(F.shiftleft(t.bitwiseAND(low17), 17).bitwiseOR(both)).bitwiseOR(t.bitwiseAND(_long((1 << RANK) - 1)))
            behind = F.coalesce(F.get(tokens, at + 1), end).bitwiseAND(low17)
            new = ranked(F.shiftleft(both, 17).bitwiseOR(behind)).bitwiseOR(low.bitwiseAND(_long((1 << RANK) - (1 << PLACE)))).bitwiseOR(both)
            one = lambda t, k: _if(k > at, t, _if(k < at - 2, t, _if(k == at - 1, new, _if(k == at, gone, left(t)))))
            return F.array_remove(F.transform(tokens, one), gone)

        return _with(F.array_position(tokens, low).cast("int"), tokens, at_place)

    step = lambda tokens, _: _with(F.array_min(tokens), tokens, lambda low: _if(low >= none, tokens, merged(tokens, low)))
    return F.aggregate(word, F.transform(word, begun), step, lambda tokens: F.transform(tokens, lambda t: t.bitwiseAND(low17).cast("int")))


def folded(words: Column, ranks: Column) -> Column:
    """The ids of each of an array of words, which are arrays of bytes (0 to 255); null for null."""
    names = ("twos", "lasts", "shifts", "entries")

    def use(held: list[Column]) -> Column:
        if len(held) == len(names):
            return F.transform(words, lambda w: _folded(w, *held))
        return F.get(F.transform(F.array(ranks[names[len(held)]]), lambda x: use([*held, x])), F.lit(0))

    return use([])


def decoded(words: Column, path: str, pieces: Column | None = None) -> Column:
    """The bytes of each of an array of words, which are arrays of ids; null for null. Without ``pieces`` they are a literal."""
    if pieces is None:
        pieces = F.split(F.lit(",".join(piece.hex() for piece in id_pieces(path))), ",")
    spelled = lambda ids, held: F.unhex(F.array_join(F.transform(ids, lambda k: F.get(held, k)), ""))
    return F.get(F.transform(F.array(pieces), lambda held: F.transform(words, lambda ids: spelled(ids, held))), F.lit(0))


def fold_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """``words`` with ``ids``: the ids of each binary word, folded by higher-order functions."""
    spelled = F.hex(F.col(word_col))
    code = lambda k: F.conv(F.substring(spelled, 2 * k - 1, F.lit(2)), 16, 10).cast("int")
    spread = F.when(F.length(word_col) > 0, F.transform(F.sequence(F.lit(1), F.length(word_col)), code)).otherwise(F.array().cast("array<int>"))
    held = with_tables(words.select(F.struct("*").alias("row"), F.array(spread).alias("spread")), path, F.lit(True))
    coded = held.select("row", F.get(folded(F.col("spread"), F.col("ranks")), F.lit(0)).alias("coded"))
    return coded.select(*(F.col("row")[c].alias(c) for c in words.columns if c != "ids"), F.col("coded").alias("ids"))


def fold(word: bytes, first: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one word. Short words look for the lowest pair each time; long ones keep the pairs in a heap."""
    ids = [first[b] for b in word]
    get = pairs.get
    if len(ids) <= 48:
        none = 1 << 30
        found = [get(a << 17 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (low := min(found)) < none:
            k = found.index(low)
            ids[k : k + 2] = [low]
            del found[k]
            if k:
                found[k - 1] = get(ids[k - 1] << 17 | low, none)
            if k < len(found):
                found[k] = get(low << 17 | ids[k + 1], none)
        return ids
    n = len(ids)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 17 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j < 0 or ids[j] != b:
            continue
        ids[k], ids[j], after[k] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] >= 0 and (r := get(ids[left] << 17 | ids[after[left]])) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
    return [x for x in ids if x >= 0]


def spread_words(words: list[bytes]) -> pa.Array:
    """Words as arrays of their bytes; null for words beyond ``LONG``."""
    bounds = np.r_[0, np.cumsum(np.fromiter((len(w) if len(w) <= LONG else 0 for w in words), np.int64, len(words)))].astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(bounds, mask=np.r_[[len(w) > LONG for w in words], False].astype(bool)), values)


class Numbering:
    """Numbers the distinct words that a task meets, the head's first."""

    def __init__(self, head: list[bytes]):
        self.head = head
        self.known = {word: k for k, word in enumerate(head)}

    def number(self, words: list[bytes]) -> tuple[int, list[bytes], np.ndarray]:
        """The first new number, the new words in order, and the number of every word."""
        if len(self.known) > len(self.head) + CACHE:
            self.known = {word: k for k, word in enumerate(self.head)}
        first = len(self.known)
        fresh = list(set(words).difference(self.known))
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        return first, fresh, np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))


class IdTable:
    """The ids of numbered words, or the bytes that they decode to, in one array."""

    def __init__(self, kind: type = np.int32):
        self.ids, self.bounds, self.count = np.zeros(1 << 16, kind), np.zeros(1 << 15, np.int64), 0

    def add(self, first: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Words from number ``first`` on; what was there goes."""
        held, self.count = int(self.bounds[first]), first + len(lengths)
        while held + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while self.count >= len(self.bounds):
            self.bounds = np.r_[self.bounds, np.zeros_like(self.bounds)]
        self.ids[held : held + len(ids)] = ids
        self.bounds[first + 1 : self.count + 1] = held + np.cumsum(lengths)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """What the words with these numbers have, joined."""
        if len(numbers) > PART:
            return np.concatenate([self.of(numbers[k : k + PART]) for k in range(0, len(numbers), PART)])
        begin = self.bounds[numbers]
        lengths = self.bounds[numbers + 1] - begin
        ends = np.cumsum(lengths)
        if not len(ends):
            return self.ids[:0]
        return self.ids[np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1])]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, joined, and how many each value has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return raw[bounds[0] : bounds[-1]], np.diff(bounds)


def head_words(docs: DataFrame, path: str, id_col: str, text_col: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words of a bounded sample of documents, their ids joined and how many each has, the bytes that
    these decode to joined and how many; folded and decoded in Spark."""
    sample = sampled_texts(docs, id_col, text_col, SAMPLE_DOCS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in in_slices(texts, SLICE_BYTES):
                words = [w for w in split_pieces(texts[a:b])[0] if len(w) <= 64]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), spread_words(words))], ["words", "spread"])

    counted = sample.mapInArrow(split, "word binary").groupBy("word").count().orderBy(F.desc("count"), "word").limit(HEAD)
    dealt = counted.select("word").repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "word")
    held = with_tables(dealt.mapInArrow(gather, "words array<binary>, spread array<array<int>>"), path, F.size("spread") > 0)
    coded = held.select("words", folded(F.col("spread"), F.col("ranks")).alias("ids"), "pieces")
    rows = coded.select("words", "ids", decoded(F.col("ids"), path, F.col("pieces")).alias("plain")).toArrow()
    words, ids, lengths, plain, sizes = [], [], [], [], []
    for batch in rows.to_batches():
        words += batch["words"].flatten().to_pylist()
        own = batch["ids"].flatten()
        ids.append(own.flatten().to_numpy())
        lengths.append(own.value_lengths().to_numpy())
        raw, size = flat_bytes(batch["plain"].flatten())
        plain.append(raw)
        sizes.append(size)
    joined = lambda parts, kind: np.concatenate(parts or [np.zeros(0, kind)])
    return words, joined(ids, np.int32), joined(lengths, np.int32), joined(plain, np.uint8), joined(sizes, np.int32)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """Per row: id, n_tokens, digests of the ids (little-endian unsigned 32-bit) and of the bytes decoded from them; with
    ``arrays`` also the ids and the decoded bytes."""
    head = docs.sparkSession.sparkContext.broadcast(head_words(docs, path, id_col, text_col))
    trim()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of each text's words; the new words of a slice of texts stand with its first text."""
        numbering = Numbering(head.value[0])

        def numbered(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            words, bounds = split_pieces(texts)
            first, fresh, numbers = numbering.number(words)
            new = pa.ListArray.from_arrays(pa.array([0, len(fresh)] + [len(fresh)] * (len(texts) - 1), pa.int32()), spread_words(fresh))
            long = pa.array([[w for w in fresh if len(w) > LONG]] + [[]] * (len(texts) - 1), pa.list_(pa.binary()))
            places = pa.array([numbers[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            return pa.RecordBatch.from_arrays([ids, places, pa.array([first] * len(texts), pa.int32()), new, long], ["id", "numbers", "first", "fresh", "long"])

        for batch in batches:
            ids, texts = batch["id"], batch["text"].to_pylist()
            for a, b in in_slices(texts, SLICE_BYTES):
                # The words of a slice are gone before the next one is split.
                yield numbered(ids.slice(a, b - a), texts[a:b])
            release()
        trim()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids in the places of the numbers, and what they decode to."""
        table, spelled = IdTable(), IdTable(np.uint8)
        table.add(0, head.value[1], head.value[2])
        spelled.add(0, head.value[3], head.value[4])
        for batch in batches:
            outer, firsts = batch["fresh"], batch["first"].to_numpy()
            lists, cuts, shown, coded, plain = outer.values, outer.offsets.to_numpy(), batch["plain"].values, [], []
            for k, numbers in enumerate(batch["numbers"]):
                new, out = (x.slice(cuts[k], cuts[k + 1] - cuts[k]) for x in (lists, shown))
                if len(new) and new.null_count:
                    start, pairs, pieces = pair_ranks(path)
                    long = iter(batch["long"][k].as_py())
                    own = [fold(next(long), start, pairs) if x is None else x for x in new.to_pylist()]
                    out = pa.array([b"".join(map(pieces.__getitem__, x)) if o is None else o for x, o in zip(own, out.to_pylist(), strict=True)], pa.binary())
                    new = pa.array(own, pa.list_(pa.int32()))
                if len(new):
                    table.add(int(firsts[k]), new.flatten().to_numpy(), new.value_lengths().to_numpy())
                    spelled.add(int(firsts[k]), *flat_bytes(out))
                at = np.frombuffer(numbers.as_buffer(), np.int32)
                coded.append(table.of(at))
                plain.append(spelled.of(at))
            out = [batch["id"], pa.array(list(map(len, coded)), pa.int64()), pa.array([hashlib.sha256(c.astype("<u4")).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if arrays:
                out += [pa.array(coded, pa.list_(pa.int32())), pa.array([p.tobytes() for p in plain], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)
        trim()

    numbered = rows.mapInArrow(number, f"id {id_type}, numbers binary, first int, fresh array<array<int>>, long array<binary>")
    held = with_tables(numbered, path, F.size("fresh") > 0)
    coded = held.withColumn("fresh", folded(F.col("fresh"), F.col("ranks"))).withColumn("plain", decoded(F.col("fresh"), path, F.col("pieces"))).drop("ranks", "pieces")
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * arrays
    return coded.mapInArrow(join, schema).withColumnRenamed("id", id_col)
