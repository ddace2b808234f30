"""Decision trees of many runs in the same passes: forests with true out-of-bag rows, and multiclass boosting.

Features are cut into at most ``BINS`` ranges between quantiles and stored once as bytes. A level of all trees is one pass:
tasks add up what each bin of each feature holds at every open node (``replicates.Spread``), the sums of a tree come together
in a group of their own, where the best cut of each node is chosen, and only the cuts come to the driver: trees times open
nodes, whatever the number of rows. A row's node follows from walking its bytes down the trees so far; nothing is kept of it.

A forest's tree draws rows by Poisson(1) weights from a hash of the row's key and the tree, so which rows a tree has not
seen is known of every tree. Boosting has a run for each repeat, fold and leaf size, with a tree for each class and step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import replicates, stats
from sensorloom.session import written

BINS = 64
#: Bytes of histograms that a task adds up at once: trees of a level beyond that are further passes.
HELD = 128 << 20
#: Levels below the root.
DEPTH = 10


class Tree:
    """Nodes in order of making: feature (-1: a leaf), last bin that goes left, first child (the second is next), values."""

    def __init__(self, width: int):
        self.feature, self.cut, self.child = (np.full(1, v, np.int32) for v in (-1, 0, 0))
        self.value = np.zeros((1, width))
        self.open = np.zeros(1, np.int64)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        node = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(going):
            at = node[going]
            node[going] = self.child[at] + (bins[going, self.feature[at]] > self.cut[at])
            going = going[self.feature[node[going]] >= 0]
        return node

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Gives the nodes two children each, with their values; they are open next."""
        first = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.child[nodes] = feature, cut, first
        more = 2 * len(nodes)
        self.feature = np.r_[self.feature, np.full(more, -1, np.int32)]
        self.cut, self.child = (np.r_[x, np.zeros(more, np.int32)] for x in (self.cut, self.child))
        self.value = np.r_[self.value, np.stack([left, right], 1).reshape(more, -1)]
        self.open = np.arange(len(self.feature) - more, len(self.feature))


def binned(df: DataFrame, key: str, columns: Sequence[str], label: str, bins: int = BINS) -> tuple[DataFrame, int]:
    """A written table (key, b: a byte for each feature, y) of the rows without nulls, and the number of classes."""
    d = df.select(F.col(key).cast("bigint").alias("key"), *(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("int").alias("y")).dropna()
    edges = stats.quantiles(d, columns, [k / bins for k in range(1, bins)])
    cuts = [np.unique(np.array([v for v in edges[c] if v is not None], float)) for c in columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([np.searchsorted(own, batch[c].to_numpy(), "left") for c, own in zip(columns, cuts, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([row.tobytes() for row in at], pa.binary()), batch["y"]], ["key", "b", "y"])

    rows = written(d.mapInArrow(cut, "key bigint, b binary, y int").hint("rebalance"), "binned")
    return rows, 1 + (rows.agg(F.max("y")).head()[0] if rows.head() else -1)


def _bytes(column: pa.Array) -> np.ndarray:
    """A row of bytes for each value."""
    n = len(column)
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, np.uint8).reshape(n, -1)


def _histogram(slot: np.ndarray, bins: np.ndarray, features: np.ndarray, what: np.ndarray, nodes: int, most: int) -> np.ndarray:
    """Sums of ``what`` (rows x values) by node (``slot``), one of its ``features`` (nodes x chosen) and bin."""
    chosen, values = features.shape[1], what.shape[1]
    at = (slot[:, None] * chosen + np.arange(chosen)) * most + bins[np.arange(len(slot))[:, None], features[slot]]
    out = np.stack([np.bincount(at.ravel(), np.repeat(what[:, v], chosen), nodes * chosen * most) for v in range(values)], 1)
    return out.reshape(nodes, chosen, most, values)


def _best(sums: np.ndarray, score: Callable[[np.ndarray], np.ndarray], least: float) -> tuple[np.ndarray, ...]:
    """Of each node (nodes x features x bins x values; the last value counts rows) the best cut: gain, chosen feature, bin,
    and the sums to its left and right. A side needs ``least`` rows."""
    left = np.cumsum(sums, 2)
    whole = left[:, :, -1:]
    right = whole - left
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., -1] < least) | (right[..., -1] < least)] = -np.inf
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(1)
    feature, cut = np.divmod(at, sums.shape[2])
    n = np.arange(len(sums))
    return flat[n, at], feature, cut, left[n, feature, cut], right[n, feature, cut]


def _purity(sums: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over the weight: what Gini impurity leaves."""
    w = sums[..., :-1]
    return (w * w).sum(-1) / np.maximum(w.sum(-1), 1e-300)


def _newton(sums: np.ndarray) -> np.ndarray:
    """Squared slope over curvature."""
    return sums[..., 0] ** 2 / (sums[..., 1] + 1e-3)


class Forest(NamedTuple):
    """Trees, the weight of each class, and the seed of their draws."""

    trees: list[Tree]
    weights: np.ndarray
    seed: int


def _waves(runs: Sequence[int], sizes: Sequence[int], most: int) -> Iterator[list[int]]:
    """The runs in order, in parts whose sizes come to ``most`` bytes; a larger one is a part of its own."""
    part, held = [], 0
    for run, size in zip(runs, sizes, strict=True):
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(run)
        held += size
    if part:
        yield part


def grow_forest(rows: DataFrame, classes: int, trees: int = 500, balanced: bool = True, depth: int = DEPTH, least: int = 1, seed: int = 0, bins: int = BINS) -> Forest:
    """A forest on ``binned`` rows: each tree on Poisson draws of the rows, each node on about the square root of the
    features, drawn by tree and node. ``balanced`` weighs a row by n / (classes * rows of its class)."""
    counts = np.zeros(classes)
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():
        counts[r["y"]] = r["n"]
    weights = np.where(counts > 0, counts.sum() / (np.maximum((counts > 0).sum(), 1) * np.maximum(counts, 1)), 0.0) if balanced else np.ones(classes)
    grown, first = [Tree(classes) for _ in range(trees)], rows.head()
    if first is None:
        return Forest(grown, weights, seed)
    width, spread = len(first["b"]), replicates.Spread.of(rows, trees)
    some, draws = max(1, round(math.sqrt(width))), replicates.poisson_draws(seed)

    def chosen(tree: int, nodes: np.ndarray) -> np.ndarray:
        """Features of each node."""
        return np.stack([np.random.default_rng([seed, tree, int(n)]).permutation(width)[:some] for n in nodes])

    for _ in range(depth):
        active = [t for t, tree in enumerate(grown) if len(tree.open)]
        if not active:
            break

        def step(batch: pa.RecordBatch, mine: Sequence[int], grown=grown) -> Iterator[tuple[int, np.ndarray]]:
            b, y, keys = _bytes(batch["b"]), batch["y"].to_numpy(), batch["key"].to_numpy()
            for t in mine:
                tree, times = grown[t], draws(keys, t)
                slot_of = np.full(len(tree.feature), -1)
                slot_of[tree.open] = np.arange(len(tree.open))
                at = np.flatnonzero(times > 0)
                slot = slot_of[tree.walk(b[at])]
                at, slot = at[slot >= 0], slot[slot >= 0]
                what = np.zeros((len(at), classes + 1))
                what[np.arange(len(at)), y[at]] = times[at] * weights[y[at]]
                what[:, -1] = 1.0
                yield t, _histogram(slot, b[at], chosen(t, tree.open), what, len(tree.open), bins).ravel()

        def finish(t: int, total: np.ndarray, grown=grown) -> np.ndarray:
            n = len(grown[t].open)
            gain, feature, cut, left, right = _best(total.reshape(n, some, bins, classes + 1), _purity, least)
            return np.c_[gain, chosen(t, grown[t].open)[np.arange(n), feature], cut, left[:, :-1], right[:, :-1]].ravel()

        sizes = [8 * len(grown[t].open) * some * bins * (classes + 1) for t in active]
        found = {t: got for wave in _waves(active, sizes, HELD * spread.groups) for t, got in spread.sums(wave, step, finish).items()}
        for t, got in found.items():
            tree = grown[t]
            got = got.reshape(len(tree.open), -1)
            good = got[:, 0] > 1e-9
            if len(tree.feature) == 1:
                tree.value[0] = got[0, 3 : 3 + classes] + got[0, 3 + classes :]
            nodes, got = tree.open[good], got[good]
            tree.open = np.empty(0, np.int64)
            if len(nodes):
                tree.split(nodes, got[:, 1].astype(np.int32), got[:, 2].astype(np.int32), got[:, 3 : 3 + classes], got[:, 3 + classes :])
                # A child of one class is done.
                tree.open = tree.open[(tree.value[tree.open] > 0).sum(1) > 1]
    return Forest(grown, weights, seed)


def forest_votes(rows: DataFrame, forest: Forest, classes: int, out_of_bag: bool = True) -> DataFrame:
    """(key, actual, predicted, probability, votes): the mean class shares of the leaves of the trees that didn't draw the
    row (or of all). Rows that every tree drew have no vote: null."""
    draws = replicates.poisson_draws(forest.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, keys = _bytes(batch["b"]), batch["key"].to_numpy()
            total, votes = np.zeros((len(b), classes)), np.zeros(len(b), np.int64)
            for t, tree in enumerate(forest.trees):
                at = np.flatnonzero(draws(keys, t) == 0) if out_of_bag else np.arange(len(b))
                value = tree.value[tree.walk(b[at])]
                total[at] += value / np.maximum(value.sum(1, keepdims=True), 1e-300)
                votes[at] += 1
            shares = total / np.maximum(votes, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, classes, np.int32)), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["y"], pa.array(shares.argmax(1).astype(np.int32), mask=votes == 0), lists, pa.array(votes)], ["key", "actual", "predicted", "probability", "votes"])

    return rows.mapInArrow(run, "key bigint, actual int, predicted int, probability array<double>, votes bigint")


class Boosted(NamedTuple):
    """For each run the starting scores and, step by step, a tree for each class; and the runs' folds left out."""

    start: dict[int, np.ndarray]
    trees: dict[int, list[list[Tree]]]
    runs: dict[int, tuple[int, int, int]]

    def scores(self, run: int, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start[run], (len(bins), 1))
        for step in self.trees[run]:
            for c, tree in enumerate(step):
                out[:, c] += tree.value[tree.walk(bins), 0]
        return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def boost(rows: DataFrame, classes: int, folds: replicates.Folds, repeats: int, n_folds: int, leaves: Sequence[int], iterations: int = 20, depth: int = 5, rate: float = 0.1, bins: int = BINS) -> Boosted:
    """Boosted trees of every repeat, fold left out and leaf size (least rows of a leaf) in shared passes.

    Softmax loss; a tree for each class and step on the slopes and curvatures of all training rows of the run.
    """
    every = [(rep, fold, leaf) for rep in range(repeats) for fold in range(n_folds) for leaf in leaves]
    runs = dict(enumerate(every))
    spread = replicates.Spread.of(rows, len(runs))
    # A repeat's folds are those of its (negative) run, as labels are the rows' own.
    fold_of = lambda keys, y, run: folds.of(keys, y, -1 - runs[run][0])

    def sizes(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        keys, y = batch["key"].to_numpy(), batch["y"].to_numpy()
        for r in mine:
            yield r, np.bincount(y[fold_of(keys, y, r) != runs[r][1]], minlength=classes).astype(float)

    start = {r: np.log(np.maximum(v, 0.5) / max(v.sum(), 1.0)) for r, v in spread.sums(list(runs), sizes).items()}
    model = Boosted(start, {r: [] for r in start}, runs)
    for _ in range(iterations):
        new = {r: [Tree(1) for _ in range(classes)] for r in start}
        for _ in range(depth):
            active = [r for r in new if any(len(t.open) for t in new[r])]
            if not active:
                break

            def step(batch: pa.RecordBatch, mine: Sequence[int], new=new) -> Iterator[tuple[int, np.ndarray]]:
                b, y, keys = _bytes(batch["b"]), batch["y"].to_numpy(), batch["key"].to_numpy()
                width = b.shape[1]
                for r in mine:
                    at = np.flatnonzero(fold_of(keys, y, r) != runs[r][1])
                    own = b[at]
                    p = _softmax(model.scores(r, own))
                    out = []
                    for c, tree in enumerate(new[r]):
                        n = len(tree.open)
                        slot_of = np.full(len(tree.feature), -1)
                        slot_of[tree.open] = np.arange(n)
                        slot = slot_of[tree.walk(own)]
                        held = np.flatnonzero(slot >= 0)
                        what = np.stack([(y[at[held]] == c) - p[held, c], p[held, c] * (1 - p[held, c]), np.ones(len(held))], 1)
                        out.append(_histogram(slot[held], own[held], np.tile(np.arange(width), (n, 1)), what, n, bins).ravel() if n else np.empty(0))
                    yield r, np.concatenate(out)

            def finish(r: int, total: np.ndarray, new=new) -> np.ndarray:
                out, at = [], 0
                per = len(total) // max(1, sum(len(t.open) for t in new[r]))
                for tree in new[r]:
                    n = len(tree.open)
                    own = total[at : at + n * per]
                    at += n * per
                    if n:
                        sums = own.reshape(n, -1, bins, 3)
                        gain, feature, cut, left, right = _best(sums, _newton, runs[r][2])
                        leaf = lambda s: rate * s[:, 0] / (s[:, 1] + 1e-3)
                        out.append(np.c_[gain, feature, cut, leaf(left), leaf(right), leaf(left + right)].ravel())
                return np.concatenate(out)

            for r, got in spread.sums(active, step, finish).items():
                got, at = got.reshape(-1, 6), 0
                for tree in new[r]:
                    n = len(tree.open)
                    own = got[at : at + n]
                    at += n
                    if n and len(tree.feature) == 1:
                        tree.value[0] = own[0, 5]
                    good = own[:, 0] > 1e-9
                    nodes, own = tree.open[good], own[good]
                    tree.open = np.empty(0, np.int64)
                    if len(nodes):
                        tree.split(nodes, own[:, 1].astype(np.int32), own[:, 2].astype(np.int32), own[:, 3:4], own[:, 4:5])
        for r, made in new.items():
            model.trees[r].append(made)
    return model


def boosted_shares(rows: DataFrame, model: Boosted, folds: replicates.Folds) -> DataFrame:
    """(rep, fold, leaf, key, actual, predicted, probability): each row by the runs that left its fold out."""
    runs, k = model.runs, len(next(iter(model.start.values()), ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, y, keys = _bytes(batch["b"]), batch["y"].to_numpy(), batch["key"].to_numpy()
            for r, (rep, fold, leaf) in runs.items():
                at = np.flatnonzero(folds.of(keys, y, -1 - rep) == fold)
                if r in model.start and len(at):
                    p = _softmax(model.scores(r, b[at]))
                    shares = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, np.int32)), pa.array(p.ravel()))
                    same = [pa.array(np.full(len(at), v, np.int32)) for v in (rep, fold, leaf)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(keys[at]), pa.array(y[at]), pa.array(p.argmax(1).astype(np.int32)), shares], ["rep", "fold", "leaf", "key", "actual", "predicted", "probability"])

    return rows.mapInArrow(run, "rep int, fold int, leaf int, key bigint, actual int, predicted int, probability array<double>")
