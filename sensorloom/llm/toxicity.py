"""Toxicity scores from a counterfactual-regularised classifier.

Features are the lower-cased words of a text and their beginnings of 4 to 7 letters, hashed to ``BUCKETS``; each says
that a word or beginning occurs at least once, or twice, or four times (``LEVELS``). Of them, those most tied to the label in the training rows are kept (``FEATURES``), and those of the identity terms always.
A logistic model is fitted to these, with a penalty on the squared change of the score's log-odds when identity terms of a
labelled text are swapped for others (a text without any gets a neutral mention, which is swapped). So a mention of a
group by itself moves the score little, whatever company it keeps in the training rows.

``FEATURES`` and ``LEAST_TIE`` bound the model: it holds at most so many weights, and none that chance could explain.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those whose hashed id comes first; feature counts and
the model come from them by Spark aggregation and a bounded fit. Scoring covers every whole text in one narrow pass.

A null or empty text has no features and gets the score of the bias. Conflicting labels of an id count as toxic; null
labels and ids are not learned from. With one class or no rows to learn from, all scores are the share of that class,
smoothed. Repeated rows repeat their score; of several rows under one id one is learned from (the smallest text). A null
id is not held out.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.memory import trim
from sensorloom.llm.text import alnum_words, byte_values
from sensorloom.session import written

TRAIN_ROWS = 20_000
BUCKETS = 1 << 18
LEVELS = (1, 2, 4)
FEATURES = 1_024
#: Ties to the label that chance makes among so many features stay below this many standard deviations.
LEAST_TIE = 5.0
PENALTY = 1.0
RIDGE = 2e-4
STEPS = 400
#: Words that a task keeps the buckets of; dropped at its end.
CACHE = 100_000

#: Words that name groups of people, by kind; a swap stays inside a kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "chrétiens", "musulmans", "juifs", "muslime", "juden", "cristianos", "musulmanes", "judíos"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "noirs", "blancs", "schwarze", "weiße", "negros", "blancos"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "homosexuels", "schwule", "lesben", "homosexuales"),
    ("immigrants", "refugees", "foreigners", "natives", "immigrés", "réfugiés", "ausländer", "flüchtlinge", "inmigrantes", "refugiados"),
    ("disabled", "blind", "deaf", "elderly", "young", "handicapés", "behinderte", "discapacitados"),
)
_OTHERS = {t.encode(): [x.encode() for x in kind if x != t] for kind in IDENTITY for t in kind}


@functools.cache
def _known() -> dict[bytes, tuple[int, ...]]:
    return {}


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    text = word.decode("utf-8", "replace").lower()
    names = [text, *(text[:k] + "*" for k in range(4, min(8, len(text))))]
    return tuple(sorted({xxhash.xxh32_intdigest(x) % BUCKETS for x in names}))


def word_features(word: bytes) -> tuple[int, ...]:
    """``buckets_of``, kept for the words a fitting task meets again."""
    known = _known()
    own = known.get(word)
    if own is None:
        if len(known) > CACHE:
            known.clear()
        own = known[word] = buckets_of(word)
    return own


def features(words: Counter) -> set[int]:
    """Feature numbers: bucket + level * BUCKETS."""
    held: Counter = Counter()
    for word, times in words.items():
        for b in word_features(word):
            held[b] += times
    return {b + k * BUCKETS for b, n in held.items() for k, least in enumerate(LEVELS) if n >= least}


def swapped(words: Counter, key: int) -> tuple[Counter, Counter]:
    """A text's words and those of its counterfactual: identity terms swapped, or a mention added to both and swapped."""
    own = {t: words[t] for t in words.keys() & _OTHERS.keys()} or {sorted(_OTHERS)[key % len(_OTHERS)]: 1}
    rest = Counter({w: n for w, n in words.items() if w not in own})
    other: Counter = Counter()
    for t, n in own.items():
        other[_OTHERS[t][key % len(_OTHERS[t])]] += n
    return rest + Counter(own), rest + other


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Weights by bucket, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.used = frozenset(f % BUCKETS for f in weights)
        self.met: dict[bytes, tuple[int, ...]] = {}

    def _buckets(self, word: bytes) -> tuple[int, ...]:
        """The word's buckets that have a weight, kept for the words a worker meets again."""
        own = self.met.get(word)
        if own is None:
            own = tuple(b for b in buckets_of(word) if b in self.used)
            if len(self.met) > CACHE:
                self.met.clear()
            self.met[word] = own
        return own

    def score(self, text: bytes) -> float:
        held: dict[int, int] = {}
        for b in itertools.chain.from_iterable(map(self._buckets, alnum_words(text))):
            held[b] = held.get(b, 0) + 1
        weight = self.weights.get
        z = self.bias + math.fsum(weight(b + k * BUCKETS, 0.0) for b, n in held.items() for k, least in enumerate(LEVELS) if n >= least)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold a bucket, summed over the task."""
    total = np.zeros((2, len(LEVELS) * BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(byte_values(batch["text"]), batch["label"].to_pylist(), strict=True):
            total[label, list(features(Counter(alnum_words(text))))] += 1
    _known().clear()
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "clean", "toxic"])
    del total
    trim()


def _strength(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Signed root of the chi-square of a bucket and the label (Yates), so that rare chance ties don't lead."""
    n = float(n_clean + n_toxic)
    held = clean + toxic
    over = toxic - held * (n_toxic / n)
    spread = held * (n - held) / n * (n_clean / n) * (n_toxic / n)
    return (over - 0.5) / F.sqrt(spread + 1e-9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None, rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> Model:
    """Fit on labelled rows where ``train`` (a condition on the labels' id column) holds, at most ``rows`` of them."""
    spark = docs.sparkSession
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if train is not None:
        named = named.where(train)
    named = named.groupBy(F.col(id_col).alias("own")).agg(F.max(F.col(label_col).cast("int")).alias("label")).where("label in (0, 1)")
    named = named.orderBy(F.xxhash64("own"), "own").limit(rows)
    # The limit bounds what is broadcast.
    chosen = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(named), "own")
    # Of the rows under one id one is learned from, so that ``rows`` bounds rows.
    chosen = written(chosen.groupBy("own", "label").agg(F.min("text").alias("text")), "toxicity")
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Model({}, math.log((n_toxic + 0.5) / (n_clean + 0.5)))
    counted = chosen.select("text", "label").mapInArrow(_counts, "bucket int, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strength = F.abs(_strength(F.col("clean"), F.col("toxic"), n_clean, n_toxic))
    kept = {r["bucket"] for r in counted.where("clean + toxic >= 3").where(strength >= LEAST_TIE).orderBy(strength.desc(), "bucket").limit(FEATURES).collect()}
    kept |= features(Counter(_OTHERS.keys()))
    shared = spark.sparkContext.broadcast(kept)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, one, two = [], [], []
            for text in byte_values(batch["text"]):
                words = Counter(alnum_words(text))
                a, b = swapped(words, xxhash.xxh32_intdigest(text))
                for out, w in ((plain, words), (one, a), (two, b)):
                    out.append(sorted(features(w) & shared.value))
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(x, pa.list_(pa.int32())) for x in (plain, one, two))], ["label", "plain", "one", "two"])
        _known().clear()
        trim()

    got = chosen.select("label", "text").mapInArrow(sparse, "label int, plain array<int>, one array<int>, two array<int>").toArrow()
    model = _descend(got, sorted(kept), penalty)
    del got
    trim()
    return model


def _matrix(column: pa.ChunkedArray, place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    lists = column.to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.array([place[b] for x in lists for b in x], np.int64)


def _descend(got: pa.Table, kept: list[int], penalty: float) -> Model:
    """Logistic loss with a ridge and the counterfactual penalty, by Adam over all rows; deterministic."""
    place = {b: k for k, b in enumerate(kept)}
    y = got["label"].to_numpy().astype(float)
    n, d = len(y), len(kept)
    plain, one, two = (_matrix(got[c], place) for c in ("plain", "one", "two"))
    w, bias = np.zeros(d), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    dot = lambda x: np.bincount(x[0], w[x[1]], n)
    back = lambda x, g: np.bincount(x[1], g[x[0]], d)
    for step in range(1, STEPS + 1):
        error = (1 / (1 + np.exp(-np.clip(bias + dot(plain), -30, 30))) - y) / n
        change = 2 * penalty * (dot(one) - dot(two)) / n
        grad = back(plain, error) + back(one, change) - back(two, change) + RIDGE * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    return Model({b: float(x) for b, x in zip(kept, w, strict=True) if x}, float(bias))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shared.value.score(t) for t in byte_values(batch["text"])], pa.float64())], ["id", "score"])
        shared.value.met.clear()
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with every column, without the rows that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([shared.value.score(t) < least for t in texts], pa.bool_()))
        shared.value.met.clear()
        trim()

    return docs.mapInArrow(run, docs.schema)
