"""Phrase collocation mining by level-wise candidates and double-array tries.

Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words ``[^\\x20\\x09]+``. All counts are
per language (null: ``und``). A phrase of 2 or 3 words that occurs ``LEAST`` times or more, inside pieces, is a candidate.

1. Candidates, level by level: pairs of neighbours whose hash comes to ``LEAST`` (``slices.frequent``); then triples, looked
   for only where both pairs of a place are candidates, as no triple is more frequent than its pairs. Hashes only propose:
   too many candidates do no harm, and none is lost. Each candidate is spelled out by one of the slices that have it.
2. Exact counts: candidates, their words and their pairs are dealt into blocks of at most about ``BLOCK`` phrases. A task
   builds a block's double-array trie over numbered words; it is sent to all tasks (a bounded broadcast, one block at a
   time), which take all places of a slice through it at once, word by word, and count where they end. The dense counts of
   the tasks are added up as a tree.
3. Scores, cuts, parts of longer candidates and ranks are DataFrame operations on candidates; arithmetic is decimal.

A phrase that is in a third of all texts is one number a slice and a task. A null or empty text has no words. Repeated rows
count again. Ids aren't looked at. Equal scores and counts are ranked by the bytes of the phrase. Texts longer than a slice
are a slice of their own. An empty table gives no phrases.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import double_array
from sensorloom.llm.slices import bits_of, buckets_for, bytes_of, frequent, hashes_of, joined, packed, slice_table, trim, unpacked, words_of
from sensorloom.llm.token_table import mix
from sensorloom.llm.vectors import SCHEMA, entries, rows_of, tree_sum
from sensorloom.session import discard, written

LEAST = 10
TOP = 2_000
#: Phrases of one trie: at most about 100 bytes each when it is sent.
BLOCK = 1_000_000
#: Parts that a language's phrases are ranked in before the last ranking.
SALTS = 32
#: What ends a piece, and what stands between words.
_END = np.zeros(256, bool)
_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _END.copy()
_BETWEEN[[9, 32]] = True
_TIMES = np.uint64(0xD1342543DE82EF95)


class Text:
    """The words of a payload: their hashes, which differ by language, and whether the next word follows in the piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.raw, starts = bytes_of(texts)
        self.begin, self.end, self.bounds = words_of(self.raw, starts, _BETWEEN)
        coded = langs.dictionary_encode()
        self.langs, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        names = [x.encode() for x in self.langs]
        ends = np.cumsum([len(x) + 1 for x in names]) if names else np.empty(0, np.int64)
        salts = hashes_of(np.frombuffer(b"".join(x + b" " for x in names), np.uint8), ends - np.array([len(x) + 1 for x in names], np.int64), ends, lower=False) if names else np.empty(0, np.uint64)
        self.lang = np.repeat(of, np.diff(self.bounds))
        self.words = mix(hashes_of(self.raw, self.begin, self.end, lower=True) ^ salts[self.lang], 41) if len(self.begin) else np.empty(0, np.uint64)
        n = len(self.begin)
        self.next = np.zeros(n, bool)
        if n > 1:
            breaks = np.cumsum(_END[self.raw], dtype=np.int32)
            self.next[:-1] = breaks[self.begin[1:]] == breaks[self.end[:-1] - 1]
            inner = self.bounds[1:-1]
            self.next[inner[(inner > 0) & (inner < n)] - 1] = False

    def places(self, k: int) -> np.ndarray:
        """First words of all phrases of k words."""
        good = self.next.copy()
        for j in range(1, k - 1):
            good[:-j] &= self.next[j:]
            good[len(good) - j :] = False
        return np.flatnonzero(good)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        out = self.words[at]
        for j in range(1, k):
            out = mix(out * _TIMES + self.words[at + j], j)
        return out

    def spelled(self, at: np.ndarray, k: int) -> list[bytes]:
        """The phrases of k words at these places, one space between words."""
        data = self.raw.tobytes().lower()
        begin, end = self.begin, self.end
        parts = [[data[a:b] for a, b in zip(begin[at + j].tolist(), end[at + j].tolist(), strict=True)] for j in range(k)]
        return [b" ".join(x) for x in zip(*parts, strict=True)]


def _text(payload: bytes) -> Text:
    batch = unpacked(payload)
    return Text(batch["lang"], batch["text"])


def _tokens(k: int):
    def of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = _text(payload)
        return np.unique(text.hashes(text.places(k), k), return_counts=True)

    return of


_FOUND = pa.schema([("base", pa.int64()), ("k", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("payload", pa.binary())])
_FOUND_DDL = "base bigint, k int, lang string, phrase string, n bigint, payload binary"


def _found(base: int, k: int, langs: list[str], phrases: list | None = None, n: list | None = None, payload: list | None = None) -> pa.Table:
    none = [None] * len(langs)
    columns = [[base] * len(langs), [k] * len(langs), langs, phrases or none, n or none, payload or none]
    return pa.Table.from_arrays([pa.array(c, f.type) if f.name != "phrase" or not phrases else pa.array(c, pa.binary()).cast(pa.string()) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _level(k: int, buckets: int, last: bool):
    """Candidates of k words that this slice spells out (rows k); words a language (rows 0, at pairs); runs of words that
    hold longer candidates (a row -1, unless ``last``)."""

    def run(base: int, payload: bytes, found: pa.Table) -> pa.Table:
        text = _text(payload)
        out = []
        if k == 2:
            counts = np.bincount(text.lang, minlength=len(text.langs))
            out.append(_found(base, 0, text.langs, n=counts.tolist()))
        places = text.places(k)
        tokens, first, which = np.unique(text.hashes(places, k), return_index=True, return_inverse=True)
        often = bits_of(found, tokens, buckets)
        own = places[first[often & bits_of(found, tokens, buckets, "firsts")]]
        if len(own):
            out.append(_found(base, k, [text.langs[x] for x in text.lang[own].tolist()], phrases=text.spelled(own, k)))
        if not last and len(places):
            good = np.zeros(len(text.words) + 1, bool)
            good[places[often[which]]] = True
            # Runs of k words or more: places that follow each other; one place alone has no longer phrase.
            begin = np.flatnonzero(good & ~np.r_[False, good[:-1]])
            end = np.flatnonzero(good[:-1] & ~good[1:]) + 1
            some = end - begin > 1
            begin, end = begin[some], end[some] + k - 2
            if len(begin):
                a, b = text.begin[begin], text.end[end]
                sizes = b - a
                at = np.repeat(a - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(text.raw[at])])
                langs = pa.DictionaryArray.from_arrays(pa.array(text.lang[begin].astype(np.int32)), pa.array(text.langs)).cast(pa.string())
                out.append(_found(base, -1, [None], payload=[packed(pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"]))]))
        out = pa.concat_tables(out) if out else _FOUND.empty_table()
        del text, tokens, first, which
        trim()
        return out

    return run


def _candidates(slices: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase) of all candidates and (lang, n) words; each written."""
    pairs = written(joined(slices, frequent(slices, _tokens(2), least, buckets, 7, True), _level(2, buckets, False), _FOUND_DDL), "pairs")
    runs = pairs.where("k = -1").select("base", "payload")
    triples = written(joined(runs, frequent(runs, _tokens(3), least, buckets, 7, True), _level(3, buckets, True), _FOUND_DDL).select("k", "lang", "phrase"), "triples")
    both = pairs.where("k = 2").select("lang", "phrase").unionByName(triples.select("lang", "phrase"))
    # Words of pairs are needed for scores; each triple's pairs are candidates by themselves.
    words = pairs.where("k = 2").select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    found = written(both.unionByName(words), "candidates")
    sizes = written(pairs.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    discard(pairs, triples)
    return found, sizes


def _trie(key: tuple, table: pa.Table) -> pa.Table:
    """A block's phrases with their numbers, and a row (number -1) with the packed trie."""
    block, n = key[0].as_py(), table.num_rows
    langs, phrases = (table[c].combine_chunks() for c in ("lang", "phrase"))
    text = Text(langs, phrases)
    known, which = np.unique(text.words, return_inverse=True)
    lengths, bounds = np.diff(text.bounds), text.bounds
    del text
    words = np.zeros((n, 3), np.int32)
    for j in range(3):
        some = np.flatnonzero(lengths > j)
        words[some, j] = which[bounds[some] + j]
    del which, bounds
    trie = double_array.build(words, lengths)
    del words, lengths
    head = struct.pack("<QQQ", n, len(known), len(trie.base))
    body = zstandard.ZstdCompressor(level=1).compress(b"".join([head, known.tobytes(), *(x.astype("<i4").tobytes() for x in (trie.base, trie.check, trie.number))]))
    last = lambda column: pa.concat_arrays([column, pa.nulls(1, column.type)])
    numbers = np.arange(n + 1)
    numbers[n] = -1
    tries = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([body], pa.binary())])
    del trie, known
    trim()
    return pa.Table.from_arrays([pa.array(np.full(n + 1, block)), pa.array(numbers), last(langs), last(phrases), tries], ["block", "number", "lang", "phrase", "trie"])


class Counter:
    """A block's trie in a task, and what was counted so far. Its arrays are views of one buffer."""

    def __init__(self, body: bytes):
        data = zstandard.ZstdDecompressor().decompress(body)
        n, known, slots = struct.unpack_from("<QQQ", data)
        arrays = [np.frombuffer(data, "<i4", slots, 24 + 8 * known + 4 * slots * k) for k in range(3)]
        self.numbers, self.trie = double_array.Numbers(np.frombuffer(data, "<u8", known, 24)), double_array.DoubleArray(*arrays)
        self.counts = np.zeros(n, np.int64)

    def add(self, text: Text) -> None:
        """All places of a text go through the trie together, a word at each level."""
        word = self.numbers.of(text.words).astype(np.int64)
        at, state = np.flatnonzero(word >= 0), None
        while len(at):
            good, state = self.trie.follow(np.zeros(len(at), np.int64) if state is None else state, word[at])
            at = at[good]
            ends = self.trie.number[state]
            self.counts += np.bincount(ends[ends >= 0], minlength=len(self.counts))
            # The next word, where one follows in the piece and any phrase has it.
            goes = text.next[at]
            at, state = at[goes] + 1, state[goes]
            held = word[at] >= 0
            at, state = at[held], state[held]


def _counted(slices: DataFrame, tries: DataFrame) -> DataFrame:
    """(block, number, f) of all blocks' phrases."""
    sc, out = slices.sparkSession.sparkContext, None
    parts = slices.rdd.getNumPartitions()
    for row in tries.where("number = -1").select("block", "trie").toLocalIterator():
        block, shared = row["block"], sc.broadcast(bytes(row["trie"]))

        def count(batches: Iterator[pa.RecordBatch], block=block, shared=shared) -> Iterator[pa.RecordBatch]:
            counter = Counter(shared.value)
            for batch in batches:
                for payload in batch["payload"]:
                    counter.add(_text(payload.as_buffer()))
            counts, counter = counter.counts, None
            trim()
            yield rows_of(counts, block, TaskContext.get().partitionId())

        summed = written(entries(tree_sum(slices.select("payload").mapInArrow(count, SCHEMA), parts)), "counts")
        shared.destroy()
        out = summed if out is None else out.unionByName(summed)
    return out


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f): all phrases of 2 to 3 words with f >= ``least`` and the words in them, with exact counts; and
    (lang, n): all word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    slices, buckets = slice_table(rows, "text", "slices"), 2 * buckets_for(rows)
    found, sizes = _candidates(slices, least, buckets)
    blocks = 1 + found.count() // block
    dealt = found.withColumn("block", F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)))
    tries = written(dealt.groupBy("block").applyInArrow(_trie, "block bigint, number bigint, lang string, phrase string, trie binary"), "tries")
    counts = _counted(slices, tries)
    spelled = tries.where("number >= 0").select("block", "number", "lang", "phrase", (F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1).alias("k"))
    if counts is None:
        return spelled.select("lang", "phrase", "k", F.lit(None).cast("bigint").alias("f")), sizes
    phrases = written(spelled.join(counts, ["block", "number"]).where(f"k = 1 or f >= {least}").select("lang", "phrase", "k", "f"), "phrases")
    discard(found, slices)
    return phrases, sizes


def scored(phrases: DataFrame, share: tuple[int, int] = (50, 100)) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate takes ``share`` of: floor(10^6 a^2 / (l r))
    of the cut that scores least, the first of equal ones."""
    some = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    parts = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = some.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", parts(F.lit(1), F.col("cut")).alias("left"), parts(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda part, f: phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = "cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    best = met.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    # A candidate's longest parts; pairs are the only candidates inside a longer one.
    inside = some.where("k = 3").select("lang", "a", F.explode(F.array(parts(F.lit(1), F.lit(2)), parts(F.lit(2), F.lit(2)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or {share[1]} * longer < {share[0]} * a").drop("longer")


def top_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and bytes: lang, rank, phrase, a, l, r, n, score."""
    phrases, sizes = count_phrases(docs, lang_col, text_col, least, block)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored(phrases).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
