"""Many fits in the same passes: k-means and logistic regression for hundreds of replicates of one table.

Resamples, permutations and nulls need a fit for each replicate. A job for each would read the rows as often; here every
pass over the rows serves all runs. Tasks add up small arrays for each run (sizes and sums of clusters, gradients), Spark
sums them by run, and only these sums come to the driver: runs times features, whatever the number of rows. What differs
between runs is a weight from a hash of the row's key, a mask of features, a start, labels or column values dealt anew, or
a ``run`` column of the rows.

Features are stored once. Labels of a run follow from the hash of a row's key and the run's cut points (``dealt_labels``:
a few numbers a run), shuffled columns from a seed and the block of rows (``in_blocks``), so neither is ever written. A
small table is scanned by several tasks at once, each for some of the runs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import written

#: Rows of a run that starting centres are picked from, and rows of a block.
SAMPLE, TASK_ROWS = 256, 50_000
#: Rows whose distances to all centres of a run are held at once.
CHUNK = 4_096
#: Bytes of sums that leave a task in one batch.
SENT = 8 << 20
#: The distribution function of Poisson(1), in millionths and a little.
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406)

Weight = Callable[[np.ndarray, int], np.ndarray]
#: Features of a run, from keys, features and the run.
Deal = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
#: What one batch adds to the runs given.
Step = Callable[[pa.RecordBatch, Sequence[int]], Iterator[tuple[int, np.ndarray]]]


def hashes(keys: np.ndarray, rep: int, seed: int = 0) -> np.ndarray:
    """``portable_hash`` of keys in a task."""
    x = ((keys.astype(np.int64) % 1_000_003) * 7_919 + rep * 104_729 + seed * 15_485_863 + 12_345) % 1_000_003
    x = (x * x + 31 * x + 17) % 1_000_003
    return (x * x + 97 * x + 5) % 1_000_003


def poisson_draws(seed: int = 0) -> Weight:
    """How often a row is drawn in a run: Poisson(1)."""
    times = np.searchsorted(POISSON, np.arange(1_000_003), side="right").astype(float)
    return lambda keys, run: times[hashes(keys, run, seed)]


def halves(seed: int = 0, second: bool = False) -> Weight:
    """One half of the rows of a run, or the other."""
    return lambda keys, run: ((hashes(keys, run, seed) < 500_001) != second).astype(float)


def points(df: DataFrame, key: str, columns: Sequence[str], run: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """A written table (key, x, extra and run if given), dealt evenly. Rows with a null are left out."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    d = df.select(F.col(key).cast("bigint").alias("key"), x.alias("x"), *([F.col(run).cast("int").alias("run")] if run else []), *extra)
    return written(d.where(~F.exists("x", lambda v: v.isNull())).hint("rebalance"), "points")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _parts(batch: pa.RecordBatch, runs: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(run, places of its rows in the batch) of the runs given: all rows for each, or those that name it."""
    if "run" not in batch.schema.names:
        every = np.arange(batch.num_rows)
        yield from ((r, every) for r in runs)
        return
    own, runs = batch["run"].to_numpy(), set(runs)
    if len(own) and (own == own[0]).all():
        if int(own[0]) in runs:
            yield int(own[0]), np.arange(len(own))
        return
    order = np.argsort(own, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        if len(part) and int(own[part[0]]) in runs:
            yield int(own[part[0]]), part


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def in_blocks(rows: DataFrame) -> DataFrame:
    """A written row for each block of about ``TASK_ROWS`` random rows of ``points``, ordered by key."""
    blocks = max(1, math.ceil(rows.count() / TASK_ROWS))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["key", "x"]).sort_by("key").combine_chunks()
        return pa.Table.from_arrays([pa.array([_ipc(table.to_batches()[0])], pa.binary())], ["packed"])

    dealt = rows.select("key", "x", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    return written(dealt.groupBy("block").applyInArrow(pack, "packed binary"), "blocks")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows; of a table ``in_blocks`` or of drawn blocks (run, first, rows, values), its blocks."""
    for batch in batches:
        if "values" in batch.schema.names:
            for k, (run, first, rows, held) in enumerate(zip(*(batch[c] for c in ("run", "first", "rows", "values")), strict=True)):
                x = pa.array(np.frombuffer(held.as_buffer(), "<f4"))
                n = rows.as_py()
                columns = [pa.array(np.arange(first.as_py(), first.as_py() + n)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, len(x) // n, np.int32)), x), pa.array(np.full(n, run.as_py(), np.int32))]
                if "_g" in batch.schema.names:
                    columns.append(pa.array(np.full(n, batch["_g"][k].as_py(), np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "x", "run", "_g"][: len(columns)])
            continue
        if "packed" not in batch.schema.names:
            yield batch
            continue
        for k, packed in enumerate(batch["packed"]):
            block = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            yield block.append_column("_g", batch["_g"].slice(k, 1).take(pa.array(np.zeros(block.num_rows, np.int32)))) if "_g" in batch.schema.names else block


def shuffled_columns(seed: int = 0) -> Deal:
    """Each column's values are dealt anew to the rows of a block, by themselves; any arrangement can come up."""

    def deal(keys: np.ndarray, x: np.ndarray, run: int) -> np.ndarray:
        out = np.empty_like(x)
        for j in range(x.shape[1]):
            out[:, j] = np.random.default_rng([seed, run, j, int(keys[0]) % (1 << 32)]).permutation(x[:, j])
        return out

    return deal


def standard_scores(rows: DataFrame, runs: Sequence[int]) -> Deal:
    """Features of each run less their mean, over their population deviation (0 where they are all alike)."""

    def step(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix(batch["x"])
        for r, at in _parts(batch, mine):
            yield r, np.r_[len(at), x[at].sum(0), (x[at] ** 2).sum(0)]

    scale = {r: _scale(v) for r, v in sums_by_run(rows, runs, step).items()}
    return lambda keys, x, r: (x - scale[r][0]) / scale[r][1]


def _scale(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (1 where values are all alike) from the number of rows, their sums and sums of squares."""
    mean, square = np.split(total[1:] / max(total[0], 1.0), 2)
    var = square - mean**2
    return mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 0.0)), 1.0)


def to_standard_scores(x: np.ndarray) -> None:
    """``standard_scores`` of a table that is all in memory, in place."""
    mean, deviation = _scale(np.r_[len(x), x.sum(0), np.einsum("ij,ij->j", x, x)])
    x -= mean
    x /= deviation


class Spread(NamedTuple):
    """Rows to scan for runs: ``groups`` scans side by side, each for the runs of its turn."""

    rows: DataFrame
    groups: int
    alone: bool

    @classmethod
    def of(cls, rows: DataFrame, runs: int) -> Spread:
        """As many scans as there are tasks free, where the rows are fewer tasks than that. Nothing is copied."""
        parts = max(1, rows.rdd.getNumPartitions())
        groups = max(1, min(runs, rows.sparkSession.sparkContext.defaultParallelism // parts))
        scans = [rows.withColumn("_g", F.lit(g)) for g in range(groups)]
        return cls(functools.reduce(DataFrame.union, scans), groups, parts == 1)

    def sums(self, runs: Sequence[int], step: Step, finish: Callable[[int, np.ndarray], np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """The sum of ``step``'s arrays for each run, or what ``finish`` makes of it: inside tasks, then by run as whole
        arrays. Rows of a single task need no second sum."""
        alone = self.alone
        turns = [list(runs)[g :: self.groups] for g in range(self.groups)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in _pieces(batches):
                turn = batch["_g"].to_numpy()
                for g in np.unique(turn).tolist():
                    own = batch if (turn == g).all() else batch.filter(pa.array(turn == g))
                    for run, values in step(own, turns[g]):
                        total[run] = total[run] + values if run in total else values
            if alone and finish:
                total = {run: finish(run, v) for run, v in total.items()}
            while total:
                part, held = {}, 0
                while total and held < SENT:
                    run, values = total.popitem()
                    part[run] = values.astype("<f8").tobytes()
                    held += len(part[run])
                yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.int32()), pa.array(list(part.values()), pa.binary())], ["run", "sums"])

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), "<f8") for v in table["sums"])
            total = finish(key[0].as_py(), total) if finish else total
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["run", "sums"])

        parts = self.rows.mapInArrow(partial, "run int, sums binary")
        got = (parts if alone else parts.groupBy("run").applyInArrow(whole, "run int, sums binary")).toArrow()
        return {run: np.frombuffer(v, "<f8") for run, v in sorted(zip(got["run"].to_pylist(), got["sums"].to_pylist(), strict=True))}


def sums_by_run(rows: DataFrame, runs: Sequence[int], step: Step) -> dict[int, np.ndarray]:
    """One pass of ``Spread.sums``."""
    return Spread.of(rows, len(runs)).sums(runs, step)


class Cuts(NamedTuple):
    """Where the order of rows by (hash, key) is cut: hashes and keys of the last rows before each cut."""

    hashes: np.ndarray
    keys: np.ndarray

    def part(self, h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """How many cuts each row lies behind."""
        out = np.zeros(len(h), np.int64)
        for at, key in zip(self.hashes.tolist(), self.keys.tolist(), strict=True):
            out += (h > at) | ((h == at) & (keys > key))
        return out


#: A hash of keys, a group's number of keys and their labels, for a run.
HashOf = Callable[[np.ndarray, int], np.ndarray]
GroupOf = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
_ALL = np.iinfo(np.int64).max


def order_cuts(rows: DataFrame, runs: Sequence[int], hash_of: HashOf, group_of: GroupOf, groups: int, wanted: dict[int, list[int]]) -> dict[tuple[int, int], Cuts]:
    """Cuts of each run's order inside each group: after the places ``wanted`` of the group (from 1; 0: before all).

    ``rows``: key and y. Three passes count hashes by ever smaller ranges, so a few counts a run come to the driver and no
    rank is made of any row. Rows of one hash at a cut are ordered by key: those keys are looked for only where a cut falls
    between them.
    """
    spread = Spread.of(rows.select("key", "y"), len(runs))
    cells = [(g, p) for g in range(groups) for p in wanted.get(g, ())]
    low = {r: np.zeros(len(cells), np.int64) for r in runs}
    left = {r: np.array([p for _, p in cells], np.int64) for r in runs}
    many = {r: np.zeros(len(cells), np.int64) for r in runs}
    for wide in (10_000, 100, 1):

        def step(batch: pa.RecordBatch, mine: Sequence[int], wide=wide, low=low) -> Iterator[tuple[int, np.ndarray]]:
            keys, y = batch["key"].to_numpy(), batch["y"].to_numpy()
            for r in mine:
                h, g = hash_of(keys, r), group_of(keys, y, r)
                if wide == 10_000:
                    by = np.bincount(g * 101 + h // wide, minlength=groups * 101).reshape(groups, 101)
                    yield r, np.stack([by[group] for group, _ in cells]).astype(float).ravel()
                else:
                    out = np.zeros((len(cells), 101))
                    for k, (group, _) in enumerate(cells):
                        at = (h - low[r][k]) // wide
                        out[k, :100] = np.bincount(at[(g == group) & (at >= 0) & (at < 100)], minlength=100)
                    yield r, out.ravel()

        for r, v in spread.sums(runs, step).items():
            counts = v.reshape(len(cells), -1).astype(np.int64)
            ends = np.cumsum(counts, 1)
            for k in range(len(cells)):
                at = int(np.searchsorted(ends[k], max(left[r][k], 1)))
                low[r][k] += at * wide
                left[r][k] -= ends[k][at - 1] if at else 0
                many[r][k] = counts[k][min(at, counts.shape[1] - 1)]
    tied = {(r, k): int(left[r][k]) for r in runs for k in range(len(cells)) if 0 < left[r][k] < many[r][k]}
    keys_at = _tied_keys(rows, low, tied, hash_of, group_of, cells) if tied else {}
    out = {}
    for r in runs:
        for g in range(groups):
            own = [k for k, (group, _) in enumerate(cells) if group == g]
            hs = np.array([low[r][k] if cells[k][1] else -1 for k in own], np.int64)
            out[r, g] = Cuts(hs, np.array([keys_at.get((r, k), _ALL) for k in own], np.int64))
    return out


def _tied_keys(rows: DataFrame, low: dict[int, np.ndarray], tied: dict[tuple[int, int], int], hash_of: HashOf, group_of: GroupOf, cells: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The key at a place among the rows of one hash, for each cut that falls between them."""
    by_run: dict[int, list[int]] = {}
    for r, k in tied:
        by_run.setdefault(r, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, y = batch["key"].to_numpy(), batch["y"].to_numpy()
            for r, own in by_run.items():
                h, g = hash_of(keys, r), group_of(keys, y, r)
                for k in own:
                    met = keys[(h == low[r][k]) & (g == cells[k][0])]
                    if len(met):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), r, np.int32)), pa.array(np.full(len(met), k, np.int32)), pa.array(met), pa.array(np.full(len(met), tied[r, k]))], ["run", "k", "key", "place"])

    met = rows.select("key", "y").mapInArrow(run, "run int, k int, key bigint, place bigint")
    ranked = met.withColumn("at", F.row_number().over(Window.partitionBy("run", "k").orderBy("key"))).where("at = place")
    return {(r["run"], r["k"]): r["key"] for r in ranked.toLocalIterator()}


class Labels(NamedTuple):
    """Labels of each run from keys and own labels (of run -1)."""

    cuts: dict[tuple[int, int], Cuts]
    seed: int

    def of(self, keys: np.ndarray, y: np.ndarray, run: int) -> np.ndarray:
        return y if run < 0 else self.cuts[run, 0].part(hashes(keys, run, self.seed), keys)


class Folds(NamedTuple):
    """Folds of each run: equal parts of the rows of each label, in the order of a hash."""

    cuts: dict[tuple[int, int], Cuts]
    seed: int

    def of(self, keys: np.ndarray, label: np.ndarray, run: int) -> np.ndarray:
        h, out = hashes(keys, run + 1, self.seed), np.zeros(len(keys), np.int64)
        for c in np.unique(label).tolist():
            own = label == c
            out[own] = self.cuts[run, c].part(h[own], keys[own])
        return out


def dealt_labels(rows: DataFrame, sizes: Sequence[int], reps: int, seed: int = 0) -> Labels:
    """Labels of runs 0 .. reps - 1 dealt anew to all rows, by the order of a hash: the first places get the least label, as
    many as have it, and so on, so every arrangement can come up. ``rows``: key and y (codes of ``sizes`` rows each)."""
    places = np.cumsum(sizes)[:-1].tolist()
    return Labels(order_cuts(rows, range(reps), lambda keys, r: hashes(keys, r, seed), lambda keys, y, r: np.zeros(len(keys), np.int64), 1, {0: places}) if places else {(r, 0): Cuts(np.empty(0, np.int64), np.empty(0, np.int64)) for r in range(reps)}, seed)


def dealt_folds(rows: DataFrame, labels: Labels, runs: Sequence[int], sizes: Sequence[int], folds: int, seed: int = 0) -> Folds:
    """Folds of the runs, stratified by their labels."""
    wanted = {c: [n * f // folds for f in range(1, folds)] for c, n in enumerate(sizes)}
    return Folds(order_cuts(rows, runs, lambda keys, r: hashes(keys, r + 1, seed), labels.of, len(sizes), wanted), seed)


class Fit(NamedTuple):
    """Centres and cost of a run, and the features it used (all where None)."""

    centres: np.ndarray
    cost: float
    mask: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centres
        if self.mask is not None:
            x, c = x[:, self.mask], c[:, self.mask]
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0.0)


def _starts(sample: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a sample, each far from those before it with a chance that grows with the squared distance."""
    rng = np.random.default_rng(seed)
    chance = weights / weights.sum()
    picked = [sample[rng.choice(len(sample), p=chance)]]
    near = ((sample - picked[0]) ** 2).sum(1)
    for _ in range(k - 1):
        far = near * weights
        p = far / far.sum() if far.sum() > 0 else chance
        picked.append(sample[rng.choice(len(sample), p=p)])
        near = np.minimum(near, ((sample - picked[-1]) ** 2).sum(1))
    return np.array(picked)


def _start_seed(seed: int, run: int, start: int) -> int:
    return hash((seed, run, start)) % (1 << 32)


def _nearest_sums(x: np.ndarray, w: np.ndarray | None, fits: Sequence[Fit]) -> list[np.ndarray]:
    """Of each fit (all of one run, so of one mask and number of centres): cost, and sizes and sums of the rows nearest to
    each centre (the first of equals). All fits share a product of the rows with their centres, a few rows at a time."""
    mask, k = fits[0].mask, len(fits[0].centres)
    every = np.concatenate([f.centres for f in fits])
    c = every if mask is None else every[:, mask]
    cost, sizes, sums = np.zeros(len(fits)), np.zeros(len(every)), np.zeros(every.shape)
    for a in range(0, len(x), CHUNK):
        own = x[a : a + CHUNK]
        seen = own if mask is None else own[:, mask]
        far = (c * c).sum(1)[:, None] - 2 * (c @ seen.T)
        norm, held = np.einsum("ij,ij->i", seen, seen), np.empty_like(far)
        times = 1.0 if w is None else w[a : a + CHUNK]
        for f in range(len(fits)):
            least, near = far[f * k].copy(), np.zeros(len(own), np.int16)
            for j in range(1, k):
                other = far[f * k + j]
                near[other < least] = j
                np.minimum(least, other, out=least)
            held[f * k : (f + 1) * k] = (near == np.arange(k, dtype=np.int16)[:, None]) * times
            cost[f] += (np.maximum(least + norm, 0.0) * times).sum()
        sizes += held.sum(1)
        sums += held @ own
    return [np.r_[cost[f], sizes[f * k : (f + 1) * k], sums[f * k : (f + 1) * k].ravel()] for f in range(len(fits))]


def fit_runs(rows: DataFrame, runs: Sequence[int], k: int | dict[int, int], starts: int = 1, weight: Weight | None = None, masks: dict[int, np.ndarray] | None = None, iterations: int = 50, seed: int = 0, deal: Deal | None = None) -> dict[int, Fit]:
    """K-means of every run, the best of several starts by cost, all runs and starts in the same passes.

    ``rows`` is what ``points`` makes, ``in_blocks`` with ``deal``, or blocks of drawn rows; ``k`` may differ between runs. A cluster that gets no
    row keeps its centre.
    """
    masks, number = masks or {}, k if isinstance(k, dict) else dict.fromkeys(runs, k)
    d = rows if {"packed", "values"} & set(rows.columns) else rows.select("key", "x", *(["run"] if "run" in rows.columns else []))
    if "values" in rows.columns:
        # Drawn rows are in no order: the first of each run will do, whatever order their blocks are read in.
        heads = lambda batches: (b.slice(0, max(0, SAMPLE - b["key"][0].as_py())) for b in _pieces(batches))
        sample = d.where(F.col("first") < SAMPLE).mapInArrow(heads, "key bigint, x array<float>, run int").toArrow().sort_by([("run", "ascending"), ("key", "ascending")])
    elif "packed" in rows.columns:
        sample = d.mapInArrow(_pieces, "key bigint, x array<double>").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    elif "run" in rows.columns:
        ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(F.xxhash64("key"), "key"))).where(F.col("_r") <= SAMPLE)
        sample = ranked.drop("_r").toArrow()
    else:
        sample = d.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return {}
    x, keys = matrix(sample["x"].combine_chunks()), sample["key"].to_numpy()
    of = sample["run"].to_numpy() if "run" in rows.columns else None
    now: dict[tuple[int, int], np.ndarray] = {}
    for r in runs:
        own = np.ones(len(keys), bool) if of is None else of == r
        w = np.ones(own.sum()) if weight is None else weight(keys[own], r)
        m, of_run = masks.get(r), x[own] if deal is None else deal(keys[own], x[own], r)
        for s in range(starts):
            now[r, s] = _starts(of_run * (1.0 if m is None else m), w if w.sum() > 0 else np.ones(len(w)), number[r], _start_seed(seed, r, s))
    cost = dict.fromkeys(now, math.inf)
    active, spread = set(now), Spread.of(d, len(now))
    for _ in range(iterations):
        fits = {r * starts + s: Fit(now[r, s], 0.0, masks.get(r)) for r, s in sorted(active)}

        def step(batch: pa.RecordBatch, mine: Sequence[int], fits=fits) -> Iterator[tuple[int, np.ndarray]]:
            whole, keys = matrix(batch["x"]), batch["key"].to_numpy()
            by_run: dict[int, list[int]] = {}
            for one in mine:
                by_run.setdefault(one // starts, []).append(one)
            for r, at in _parts(batch, list(by_run)):
                own = whole[at] if deal is None else deal(keys[at], whole[at], r)
                w = None if weight is None else weight(keys[at], r)
                yield from zip(by_run[r], _nearest_sums(own, w, [fits[one] for one in by_run[r]]), strict=True)

        for run, got in spread.sums(list(fits), step).items():
            at = divmod(run, starts)
            n = len(now[at])
            sizes, sums = got[1 : n + 1], got[n + 1 :].reshape(n, -1)
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], now[at])
            moved = np.abs(new - now[at]).max()
            cost[at], now[at] = got[0], new
            if moved < 1e-9:
                active.discard(at)
        if not active:
            break
    best = {r: min(range(starts), key=lambda s: (cost[r, s], s)) for r in runs}
    return {r: Fit(now[r, s], float(cost[r, s]), masks.get(r)) for r, s in best.items()}


def _nearest(x: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre (the first of equals) of rows with the squared lengths given, and how much farther the next one is."""
    far = (-2 * centres) @ x.T
    far += (centres * centres).sum(1)[:, None]
    near, first, second = np.zeros(len(x), np.int16), far[0], np.full(len(x), np.inf)
    for j in range(1, len(centres)):
        np.copyto(near, j, where=far[j] < first)
        np.minimum(second, np.maximum(first, far[j]), out=second)
        first = np.minimum(first, far[j])
    return near, np.sqrt(np.maximum(second + norm, 0.0)) - np.sqrt(np.maximum(first + norm, 0.0))


def fit_held(x: np.ndarray, k: int, starts: int, run: int, iterations: int = 50, seed: int = 0) -> Fit:
    """What ``fit_runs`` finds for a run whose rows are all in memory, in random order.

    A row is looked at again only when centres have moved so far since that another one may be nearer: by the triangle
    inequality not before they moved by what the next centre was farther than the nearest. So late steps see few rows, and
    sums of clusters change by the rows that left and came.
    """
    norm, sample, buffer = np.einsum("ij,ij->i", x, x), x[:SAMPLE], np.empty((min(CHUNK, len(x)), x.shape[1]))
    whole = norm.sum()
    # More than distances and their sums are off by rounding.
    doubt = 1e-7 * (1 + x.shape[1]) * (1 + math.sqrt(norm.max()))
    best = None
    for s in range(starts):
        centres, cost = _starts(sample, np.ones(len(sample)), k, _start_seed(seed, run, s)), math.inf
        # The way that centres may have gone before a row has to be looked at, and the way they went.
        near, until, gone = np.full(len(x), -1, np.int16), np.full(len(x), -np.inf), 0.0
        sizes, sums = np.zeros(k), np.zeros(centres.shape)
        for _ in range(iterations):
            again = np.flatnonzero(until < gone)
            for a in range(0, len(again), CHUNK):
                at = again[a : a + CHUNK]
                rows = np.take(x, at, 0, buffer[: len(at)], "clip")
                own, farther = _nearest(rows, norm.take(at), centres)
                until[at] = farther + (gone - doubt)
                old = near.take(at)
                moved = np.flatnonzero(own != old)
                if len(moved):
                    to = np.arange(k, dtype=np.int16)[:, None]
                    turn = (own[moved] == to).astype(float) - (old[moved] == to)
                    sizes += turn.sum(1)
                    sums += turn @ (rows if len(moved) == len(rows) else rows[moved])
                    near[at] = own
            cost = whole - 2 * (centres * sums).sum() + (sizes * (centres * centres).sum(1)).sum()
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centres)
            moves, centres = new - centres, new
            # The nearest centre may have come off by the greatest move, another one nearer by the next.
            gone += np.sort(np.sqrt((moves**2).sum(1)))[-2:].sum()
            if np.abs(moves).max() < 1e-9:
                break
        if best is None or cost < best.cost:
            best = Fit(centres, float(cost))
    return best


def assigned(rows: DataFrame, fits: dict[int, Fit], extra: Sequence[str] = ()) -> DataFrame:
    """(run, key, cluster, extra): each row's nearest centre in every run; the first of equals."""
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch["x"])
            for r, at in _parts(batch, list(fits)):
                if r in fits:
                    near = fits[r].distances(whole[at]).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r, np.int32)), batch["key"].take(pa.array(at)), pa.array(near.astype(np.int32)), *(batch[c].take(pa.array(at)) for c in extra)], ["run", "key", "cluster", *extra])

    return rows.mapInArrow(run, f"run int, key bigint, cluster int{kinds}")


class Quality(NamedTuple):
    """Of one run: mean squared-Euclidean silhouette, Calinski-Harabasz, Davies-Bouldin, rows of each cluster."""

    silhouette: float
    calinski_harabasz: float
    davies_bouldin: float
    sizes: list[int]


def quality(rows: DataFrame, fits: dict[int, Fit], deal: Deal | None = None) -> dict[int, Quality]:
    """Validity of every run: sums by cluster in one pass, what is averaged over rows in another."""

    def labelled(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        whole = matrix(batch["x"])
        for r, at in _parts(batch, mine):
            x = whole[at] if deal is None else deal(batch["key"].to_numpy()[at], whole[at], r)
            yield r, x if fits[r].mask is None else x[:, fits[r].mask], fits[r].distances(x).argmin(1)

    return validity(rows, {r: len(f.centres) for r, f in fits.items()}, labelled)


def _hot(near: np.ndarray, k: int) -> np.ndarray:
    return (near == np.arange(k)[:, None]).astype(float)


def _cluster_sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """For each cluster its number of rows, the sum of their squared lengths and of their features."""
    held = _hot(near, k)
    return np.c_[held.sum(1), held @ (x * x).sum(1), held @ x]


def _silhouettes(x: np.ndarray, near: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Squared-Euclidean silhouettes of rows from the ``_cluster_sums`` of all rows."""
    n, q, s = sums[:, 0], sums[:, 1], sums[:, 2:]
    total = n * (x * x).sum(1)[:, None] + q - 2 * x @ s.T
    at = np.arange(len(x))
    own = total[at, near] / np.maximum(n[near] - 1, 1)
    far = np.where(n > 0, total / np.maximum(n, 1), np.inf)
    far[at, near] = np.inf
    other = far.min(1)
    return np.where((n[near] > 1) & np.isfinite(other), (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)


def held_silhouette(x: np.ndarray, fit: Fit) -> float:
    """The silhouette of ``quality`` for a run whose rows are all in memory."""
    parts = [x[a : a + CHUNK] for a in range(0, len(x), CHUNK)]
    near = [fit.distances(own).argmin(1) for own in parts]
    sums = sum(_cluster_sums(own, at, len(fit.centres)) for own, at in zip(parts, near, strict=True))
    return float(sum(_silhouettes(own, at, sums).sum() for own, at in zip(parts, near, strict=True)) / len(x))


def validity(rows: DataFrame, sizes: dict[int, int], labelled: Callable[[pa.RecordBatch, Sequence[int]], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, Quality]:
    """The same for any labels below ``sizes``: (run, x, labels) of a batch."""
    spread, runs = Spread.of(rows, len(sizes)), list(sizes)

    def sums(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        for r, x, near in labelled(batch, mine):
            yield r, _cluster_sums(x, near, sizes[r]).ravel()

    by = {r: v.reshape(sizes[r], -1) for r, v in spread.sums(runs, sums).items()}

    def mean(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        for r, x, near in labelled(batch, mine):
            middle = by[r][:, 2:] / np.maximum(by[r][:, 0], 1)[:, None]
            yield r, np.r_[_silhouettes(x, near, by[r]).sum(), _hot(near, sizes[r]) @ np.sqrt(((x - middle[near]) ** 2).sum(1))]

    out = {}
    for r, v in spread.sums(runs, mean).items():
        there = by[r][:, 0] > 0
        n, q, s = by[r][there, 0], by[r][there, 1], by[r][there, 2:]
        middle, k, total = s / n[:, None], len(n), n.sum()
        within = (q - (s * middle).sum(1)).sum()
        between = (n * ((middle - s.sum(0) / total) ** 2).sum(1)).sum()
        spread, apart = v[1:][there] / n, np.sqrt(((middle[:, None] - middle) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        ch = between / (k - 1) / (within / (total - k)) if k > 1 and total > k and within > 0 else math.nan
        out[r] = Quality(float(v[0] / total), float(ch), float(((spread[:, None] + spread) / apart).max(1).mean()) if k > 1 else math.nan, n.astype(int).tolist())
    return out


def rand_index(cells: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts."""
    two = lambda c: float((c * (c - 1) / 2).sum())
    i, j, n = two(cells.sum(1)), two(cells.sum(0)), cells.sum()
    chance = i * j / max(n * (n - 1) / 2, 1e-300)
    top = (i + j) / 2 - chance
    return 1.0 if top == 0 else float((two(cells) - chance) / top)


def agreement(rows: DataFrame, fits: dict[int, Fit], base: Fit, weight: Weight | None = None) -> dict[int, float]:
    """Adjusted Rand index of every run's clusters and those of ``base``, over the rows that have a weight."""

    def cells(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        x, keys = matrix(batch["x"]), batch["key"].to_numpy()
        first = base.distances(x).argmin(1)
        for r in mine:
            fit = fits[r]
            there = np.ones(len(x), bool) if weight is None else weight(keys, r) > 0
            k = len(fit.centres)
            yield r, np.bincount(first[there] * k + fit.distances(x[there]).argmin(1), minlength=len(base.centres) * k).astype(float)

    return {r: rand_index(v.reshape(len(base.centres), -1)) for r, v in sums_by_run(rows, list(fits), cells).items()}


def places(df: DataFrame, key: str, by: Sequence[str], order: Column) -> DataFrame:
    """``df`` with ``place``: from 1, in the order of a hash in 0..1000002 and the key, inside ``by``.

    Counts of ranges of the hash come first, so no task ranks more than the rows of one range.
    """
    d = df.withColumn("_h", order).withColumn("_b", (F.col("_h") / 10_000).cast("int"))
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_s", F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_c")).drop("_c")
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return d.join(before, [*by, "_b"]).withColumn("place", F.col("_s") + own).drop("_h", "_b", "_s")


class Logistic(NamedTuple):
    """Weights (classes x features, and intercept) and scales of each (run, fold)."""

    weights: dict[tuple[int, int], np.ndarray]
    mean: dict[tuple[int, int], np.ndarray]
    spread: dict[tuple[int, int], np.ndarray]
    classes: int

    def shares(self, run: int, fold: int, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean[run, fold]) / self.spread[run, fold], np.ones(len(x))]
        score = z @ self.weights[run, fold].T
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


#: (run, features, labels, folds) of a batch for the runs given.
Cases = Callable[[pa.RecordBatch, Sequence[int]], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def own_cases(batch: pa.RecordBatch, runs: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that name their run, label and fold."""
    x, y, fold = matrix(batch["x"]), batch["y"].to_numpy(), batch["fold"].to_numpy()
    for r, at in _parts(batch, runs):
        yield r, x[at], y[at], fold[at]


def dealt_cases(labels: Labels, folds: Folds) -> Cases:
    """All rows in each run, with the labels and folds of the run."""

    def of(batch: pa.RecordBatch, runs: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x, keys, own = matrix(batch["x"]), batch["key"].to_numpy(), batch["y"].to_numpy()
        for r in runs:
            y = labels.of(keys, own, r)
            yield r, x, y, folds.of(keys, y, r)

    return of


class _Curved:
    """Slope and curvature of the multinomial loss, as what tasks have to send: shares of a row add up to one, so the last
    class follows from the others, and each block of the rest is symmetric, as is their order."""

    def __init__(self, classes: int, width: int):
        self.classes, self.width, self.free = classes, width, max(1, classes - 1)
        self.blocks = [(a, b) for a in range(self.free) for b in range(a + 1)]
        self.upper = np.triu_indices(width)

    def sums(self, z: np.ndarray, p: np.ndarray, hot: np.ndarray, w: np.ndarray) -> np.ndarray:
        k = self.free
        slope = ((p[:, :k] - hot[:, :k]) * w[:, None]).T @ z
        bend = [(z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]))[self.upper] for a, b in self.blocks]
        return np.concatenate([slope.ravel(), *bend])

    def whole(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature over the weights of all classes."""
        k, n, wide = self.free, self.classes, self.width
        slope = np.zeros((n, wide))
        slope[:k] = sums[: k * wide].reshape(k, wide)
        bend = np.zeros((n, n, wide, wide))
        for (a, b), own in zip(self.blocks, sums[k * wide :].reshape(len(self.blocks), -1), strict=True):
            block = np.zeros((wide, wide))
            block[self.upper] = own
            bend[a, b] = bend[b, a] = block + np.triu(block, 1).T
        if n > 1:
            slope[-1] = -slope[:k].sum(0)
            bend[-1, :k] = bend[:k, -1] = -bend[:k, :k].sum(0)
            bend[-1, -1] = -bend[-1, :k].sum(0)
        return slope.ravel(), bend.transpose(0, 2, 1, 3).reshape(n * wide, n * wide)


def logistic_runs(rows: DataFrame, classes: int, folds: int, balanced: bool = False, ridge: float = 1.0, iterations: int = 25, runs: Sequence[int] | None = None, cases: Cases | None = None) -> Logistic:
    """Multinomial logistic regression for every run and fold left out, by Newton steps in shared passes.

    ``rows``: key, x, run, y (0 .. classes - 1) and fold; or key, x and y, where ``cases`` makes each run's labels and folds.
    Features are standardised by the rows of the other folds; the loss
    is the sum over rows plus ``ridge`` / 2 times the squared weights without intercepts. ``balanced`` weighs a row by
    n / (classes * rows of its class). A step that doesn't lower the loss is halved.
    """
    cases = cases or own_cases
    runs = [r["run"] for r in rows.select("run").distinct().toLocalIterator()] if runs is None else list(runs)
    spread = Spread.of(rows, len(runs))

    def moments(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        for r, x, y, fold in cases(batch, mine):
            out = np.zeros((folds, classes + 2 * x.shape[1]))
            for f in range(folds):
                own = fold == f
                out[f] = np.r_[np.bincount(y[own], minlength=classes), x[own].sum(0), (x[own] ** 2).sum(0)]
            yield r, out.ravel()

    model, counts = Logistic({}, {}, {}, classes), {}
    for r, v in spread.sums(runs, moments).items():
        own = v.reshape(folds, -1)
        for f in range(folds):
            rest = own.sum(0) - own[f]
            n, (s, q) = rest[:classes].sum(), np.split(rest[classes:], 2)
            mean = s / max(n, 1.0)
            var = q / max(n, 1.0) - mean**2
            model.mean[r, f], model.spread[r, f] = mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)
            counts[r, f] = rest[:classes]
            model.weights[r, f] = np.zeros((classes, len(mean) + 1))
    width = len(next(iter(model.mean.values()), ())) + 1
    packed = _Curved(classes, width)
    size, keep = classes * width, np.tile(np.r_[np.ones(width - 1), 0.0], classes)
    last, back, active = {}, {}, set(model.weights)
    for _ in range(iterations):
        if not active:
            break

        def step(batch: pa.RecordBatch, mine: Sequence[int], model=model, active=frozenset(active)) -> Iterator[tuple[int, np.ndarray]]:
            for r, x, y, fold in cases(batch, mine):
                for f in range(folds):
                    own = np.flatnonzero(fold != f)
                    if (r, f) in active:
                        p = model.shares(r, f, x[own])
                        z = np.c_[(x[own] - model.mean[r, f]) / model.spread[r, f], np.ones(len(own))]
                        n = counts[r, f]
                        w = (n.sum() / (classes * np.maximum(n, 1)))[y[own]] if balanced else np.ones(len(own))
                        hot = (y[own][:, None] == np.arange(classes)).astype(float)
                        loss = -(w * np.log(np.maximum(p[np.arange(len(own)), y[own]], 1e-300))).sum()
                        yield r * folds + f, np.r_[loss, packed.sums(z, p, hot, w)]

        for run, got in spread.sums(sorted({r for r, _ in active}), step).items():
            at = divmod(run, folds)
            w = model.weights[at].ravel()
            loss = got[0] + ridge / 2 * (keep * w * w).sum()
            if at in last and loss > last[at] + 1e-9 * abs(last[at]):
                model.weights[at] = ((w + back[at]) / 2).reshape(classes, width)
                continue
            if at in last and last[at] - loss <= 1e-10 * (1 + abs(loss)):
                active.discard(at)
                continue
            last[at], back[at] = loss, w
            slope, bend = packed.whole(got[1:])
            slope, bend = slope + ridge * keep * w, bend + np.diag(ridge * keep + 1e-9)
            move = np.linalg.lstsq(bend, slope, rcond=1e-12)[0]
            model.weights[at] = (w - move).reshape(classes, width)
            if np.abs(move).max() < 1e-7:
                active.discard(at)
    return model


def confusions(rows: DataFrame, model: Logistic, runs: Sequence[int], cases: Cases) -> dict[int, np.ndarray]:
    """Counts (actual, predicted) of every run out of fold; predictions are not kept."""
    k = model.classes

    def step(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        for r, x, y, fold in cases(batch, mine):
            said = np.empty(len(y), np.int64)
            for f in np.unique(fold).tolist():
                said[fold == f] = model.shares(r, f, x[fold == f]).argmax(1)
            yield r, np.bincount(y * k + said, minlength=k * k).astype(float)

    return {r: v.reshape(k, k) for r, v in sums_by_run(rows, runs, step).items()}


def out_of_fold_shares(rows: DataFrame, model: Logistic, extra: Sequence[str] = ()) -> DataFrame:
    """(run, key, fold, actual, predicted, probability, extra): each row by the model of the other folds of its run."""
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = matrix(batch["x"]), batch["fold"].to_numpy()
            p = np.empty((len(x), model.classes))
            for r, at in _parts(batch, np.unique(batch["run"].to_numpy()).tolist()):
                for f in np.unique(fold[at]).tolist():
                    own = at[fold[at] == f]
                    p[own] = model.shares(r, f, x[own])
            shares = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, model.classes, np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch["run"], batch["key"], batch["fold"], batch["y"], pa.array(p.argmax(1).astype(np.int32)), shares, *(batch[c] for c in extra)], ["run", "key", "fold", "actual", "predicted", "probability", *extra])

    return rows.mapInArrow(run, f"run int, key bigint, fold int, actual int, predicted int, probability array<double>{kinds}")
