"""Cross-validated classification, its metrics, resampled intervals and graded verdicts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import portable_hash
from sensorloom.operators import replicates, stats, trees
from sensorloom.session import written


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(…, rep, fold): each repeat deals the rows of each class evenly over folds, in the order of a hash."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = replicates.places(d, key, ["rep", label], portable_hash(F.col(key), F.col("rep"), seed))
    return d.withColumn("fold", ((F.col("place") - 1) % folds).cast("int")).drop("place")


def fold_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("rep",), fold: str = "fold") -> DataFrame:
    """Columns standardised by mean and population deviation of the other folds: sums of all less those of the own fold."""
    sums = [x for c in columns for x in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"))]
    own = df.groupBy(*keys, fold).agg(*sums)
    whole = own.groupBy(*keys).agg(*(F.sum(f"{c}_{k}").alias(f"{c}_{k}t") for c in columns for k in "nsq"))
    s = own.join(whole, list(keys))
    d = df.join(s, [*keys, fold])
    out = {}
    for c in columns:
        n = F.col(f"{c}_nt") - F.col(f"{c}_n")
        mean = (F.col(f"{c}_st") - F.col(f"{c}_s")) / n
        var = (F.col(f"{c}_qt") - F.col(f"{c}_q")) / n - mean * mean
        out[c] = ((F.col(c) - mean) / F.when(var > 1e-12, F.sqrt(var)).otherwise(1.0)).alias(c)
    return d.select(*(out.get(c, F.col(c)) for c in df.columns))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (k * n_c) for each row of class c."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).collect()
    n, k = sum(r["_n"] for r in counts), len(counts)
    weight = F.coalesce(*(F.when(F.col(label) == r[label], n / (k * r["_n"])) for r in counts))
    return df.withColumn(name, weight)


def logistic_out_of_fold(df: DataFrame, key: str, columns: Sequence[str], label: str, folds: int, balanced: bool = False) -> DataFrame:
    """(key, rep, fold, actual, predicted, probability) by multinomial logistic regression of unit inverse strength, all
    repeats and folds in shared passes; ``df`` has rep and fold. Labels are codes 0..k-1."""
    d = df.select(key, "rep", "fold", F.col(label).cast("int").alias("y"), *columns)
    classes = 1 + (d.agg(F.max("y")).head()[0] or 0)
    rows = replicates.points(d, key, columns, "rep", ["y", "fold"])
    out = replicates.out_of_fold_shares(rows, replicates.logistic_runs(rows, classes, folds, balanced))
    return out.select(F.col("key").alias(key), F.col("run").alias("rep"), "fold", "actual", "predicted", "probability")


def forest_out_of_bag(df: DataFrame, key: str, columns: Sequence[str], label: str, n_trees: int = 500, depth: int = trees.DEPTH, balanced: bool = True, seed: int = 0) -> DataFrame:
    """(key, actual, predicted, probability, votes): each row by the trees of a forest that didn't draw it. Rows with a
    missing feature are left out; a row that all trees drew has no prediction."""
    rows, classes = trees.binned(df, key, columns, label)
    forest = trees.grow_forest(rows, classes, n_trees, balanced, depth, seed=seed)
    return trees.forest_votes(rows, forest, classes).withColumnRenamed("key", key)


def boosted_out_of_fold(df: DataFrame, key: str, columns: Sequence[str], label: str, leaves: Sequence[int], folds: int = 5, repeats: int = 1, iterations: int = 20, seed: int = 0) -> DataFrame:
    """(rep, fold, leaf, key, actual, predicted, probability) by boosted trees of the other folds, for each leaf size; all
    repeats, folds and leaf sizes share their passes."""
    rows, classes = trees.binned(df, key, columns, label)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own = replicates.Labels({}, seed)
    dealt = replicates.dealt_folds(rows, own, [-1 - rep for rep in range(repeats)], [counts.get(c, 0) for c in range(classes)], folds, seed)
    model = trees.boost(rows, classes, dealt, repeats, folds, leaves, iterations)
    return trees.boosted_shares(rows, model, dealt).withColumnRenamed("key", key)


def class_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(keys, class, support, predicted, hits, recall, precision); 0 where a class is never predicted or absent."""
    w = F.lit(1) if weight is None else weight
    d = df.withColumn("_w", w)
    side = lambda c, name: d.groupBy(*keys, F.col(c).alias("class")).agg(F.sum("_w").alias(name))
    hits = d.where(F.col(actual) == F.col(predicted)).groupBy(*keys, F.col(actual).alias("class")).agg(F.sum("_w").alias("hits"))
    on = [*keys, "class"]
    out = side(actual, "support").join(side(predicted, "n_predicted"), on, "full_outer").join(hits, on, "left").fillna(0, ["support", "n_predicted", "hits"])
    ratio = lambda b: F.coalesce(F.col("hits") / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.select(*on, "support", "n_predicted", "hits", ratio("support").alias("recall"), ratio("n_predicted").alias("precision"))


def balanced_accuracy(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and least recall over classes that are present, and accuracy."""
    there = metrics.where("support > 0")
    return there.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"), F.min("recall").alias("min_recall"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.min("support").alias("smallest"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by mid-ranks: no thresholds, ties count half. Null with one class only."""
    keys = list(by) or ["_all"]
    d = df.where(F.col(score).isNotNull()).withColumns({"_all": F.lit(1), "_pos": positive})
    d = stats.mid_ranks(d.select(*keys, score, "_pos"), keys, score)
    g = d.groupBy(*keys).agg(F.count_if("_pos").alias("n_pos"), F.count_if(~F.col("_pos")).alias("n_neg"), F.sum(F.when(F.col("_pos"), F.col("rank"))).alias("r"))
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = (F.col("r") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n2, F.lit(0.0))
    return g.select(*(k for k in keys if k != "_all"), "n_pos", "n_neg", auc.alias("auc"))


def macro_auc(df: DataFrame, actual: str, share: str, classes: int) -> DataFrame:
    """One row: the mean over classes of the area of each against the rest, and how many classes have one."""
    d = df.select(F.col(actual).alias("_a"), F.posexplode(share).alias("_c", "_p")).where(F.col("_c") < classes)
    each = roc_auc(d.withColumn("_is", F.col("_a") == F.col("_c")), "_p", F.col("_is"), ["_c"])
    return each.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))


def poisson_weight(key: Column, rep: Column, seed: int = 0) -> Column:
    """Poisson(1) by the inverse of its distribution function from a portable hash."""
    h = portable_hash(key, rep, seed)
    out = F.lit(len(replicates.POISSON))
    for k, cut in reversed(list(enumerate(replicates.POISSON))):
        out = F.when(h < cut, k).otherwise(out)
    return out


def bootstrap_interval(df: DataFrame, key: str, actual: str, predicted: str, reps: int, seed: int = 0) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles of balanced accuracy over Poisson-weighted replicates.

    Tasks sum weights to cells (replicate, class); rows aren't repeated for the replicates.
    """
    classes = [r[0] for r in df.select(actual).where(F.col(actual).isNotNull()).distinct().orderBy(actual).collect()]
    code = F.array_position(F.array(*map(F.lit, classes)), F.col(actual)) - 1
    rows = df.where(F.col(actual).isNotNull()).select(F.col(key).cast("bigint").alias("key"), code.cast("int").alias("c"), F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)).alias("hit"))
    rows = written(rows.hint("rebalance"), "hits")
    draws, k = replicates.poisson_draws(seed), len(classes)

    def step(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        keys, c, hit = (batch[n].to_numpy(zero_copy_only=False) for n in ("key", "c", "hit"))
        cell = c * 2 + hit
        for r in mine:
            missed, met = np.bincount(cell, draws(keys, r), 2 * k).reshape(k, 2).T
            yield r, np.r_[met, met + missed]

    each = [(r, float(np.mean(v[:k][v[k:] > 0] / v[k:][v[k:] > 0]))) for r, v in replicates.sums_by_run(rows, range(reps), step).items() if v[k:].any()]
    out = df.sparkSession.createDataFrame(each, "b int, acc double")
    return out.agg(F.percentile("acc", F.lit(0.025)).alias("ci_low"), F.percentile("acc", F.lit(0.975)).alias("ci_high"), F.count("*").alias("reps"))


def empirical_p(null: DataFrame, value: str, observed: float, plus_one: bool = True) -> DataFrame:
    """Share of replicates that reach the observed value, with or without one added to the numerator."""
    n = F.count_if(F.col(value) >= observed)
    return null.agg(((n + (1 if plus_one else 0)) / (F.count("*") + 1)).alias("p"), F.count("*").alias("reps"))


def permutation_test(df: DataFrame, key: str, columns: Sequence[str], label: str, reps: int = 1_000, folds: int = 5, balanced: bool = False, baseline: float | None = None, seed: int = 0) -> DataFrame:
    """One row: cross-validated balanced accuracy with its bootstrap interval, p by refits on permuted labels (one added
    to both), the grade, and whether the classes are large enough to judge. All refits share their passes.

    Rows with a missing feature are left out. The baseline is one over the number of classes where none is given. Features
    are written once, whatever ``reps`` is; each run's labels and folds follow from hashes, and only its counts of labels
    and predictions come back.
    """
    d = df.select(key, F.col(label).cast("int").alias("y"), *columns).dropna()
    rows = replicates.points(d, key, columns, extra=["y"])
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    classes, runs = 1 + max(counts, default=0), range(-1, reps)
    sizes = [counts.get(c, 0) for c in range(classes)]
    labels = replicates.dealt_labels(rows, sizes, reps, seed)
    cases = replicates.dealt_cases(labels, replicates.dealt_folds(rows, labels, runs, sizes, folds, seed + 1))
    model = replicates.logistic_runs(rows, classes, folds, balanced, runs=runs, cases=cases)
    cells = replicates.confusions(rows, model, runs, cases)
    recalls = {r: np.diag(v)[v.sum(1) > 0] / v.sum(1)[v.sum(1) > 0] for r, v in cells.items()}
    accuracy = {r: float(v.mean()) for r, v in recalls.items()}
    reached = sum(accuracy[r] >= accuracy[-1] - 1e-12 for r in range(reps))
    # The rows of the labels' own run, for its interval.
    said = written(rows.mapInArrow(_said(model, cases), "key bigint, actual int, predicted int"), "oof")
    ci = bootstrap_interval(said, "key", "actual", "predicted", 2_000, seed).head()
    own = df.sparkSession.createDataFrame([(accuracy[-1], float(recalls[-1].min()), float(np.trace(cells[-1]) / cells[-1].sum()), min(n for n in sizes if n))], "balanced_accuracy double, min_recall double, accuracy double, smallest bigint")
    base = F.lit(1 / classes if baseline is None else baseline)
    out = own.select("balanced_accuracy", "min_recall", "accuracy", "smallest", F.lit(ci["ci_low"]).alias("ci_low"), F.lit(ci["ci_high"]).alias("ci_high"), F.lit((reached + 1) / (reps + 1)).alias("p"), F.lit(reps).cast("bigint").alias("reps"))
    return out.select("*", evaluable(F.col("smallest")).alias("status"), verdict(F.col("balanced_accuracy"), F.col("ci_low"), F.col("p"), F.col("min_recall"), base).alias("verdict"))


def _said(model: replicates.Logistic, cases: replicates.Cases) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, actual, predicted) of run -1 out of fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, x, y, fold in cases(batch, [-1]):
                said = np.empty(len(y), np.int32)
                for f in np.unique(fold).tolist():
                    said[fold == f] = model.shares(r, f, x[fold == f]).argmax(1)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(y.astype(np.int32)), pa.array(said)], ["key", "actual", "predicted"])

    return run


def arms(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> list[tuple[str, DataFrame, list[str]]]:
    """(arm, rows, columns): each set of features and all together on the rows that are complete in all of them; and, as a
    control, the first set on every row that is complete in its own."""
    every = list(dict.fromkeys(c for own in sets.values() for c in own))
    same = df.dropna(subset=every)
    first = next(iter(sets))
    return [*((name, same, list(own)) for name, own in sets.items()), ("both", same, every), (f"{first}, all rows", df.dropna(subset=list(sets[first])), list(sets[first]))]


class Rung(NamedTuple):
    """An arm of a ladder: its features, and which rows it is for (all where None)."""

    arm: str
    columns: Sequence[str]
    where: Column | None = None


def ladder(df: DataFrame, key: str, label: str, rungs: Sequence[Rung], least: int = 25) -> DataFrame:
    """(rung, arm, n, n_classes, smallest, status, chosen) of arms in order: rows that are of the arm and complete in its
    features, the smallest of the classes that ``df`` has, and whether it is large enough. The first that is, is chosen; a
    skipped arm says why. All arms are counted in one aggregation."""
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(*(F.count_if(_in_rung(r)).alias(f"r{k}") for k, r in enumerate(rungs)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rung"), F.lit(r.arm).alias("arm"), F.col(f"r{k}").alias("c")) for k, r in enumerate(rungs))))
    d = counted.select(each.alias("e")).select("e.*").groupBy("rung", "arm").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("n_classes"), F.min("c").alias("smallest"))
    d = d.withColumn("status", evaluable(F.col("smallest"), least))
    first = F.min(F.when(F.col("status") == "ok", F.col("rung"))).over(Window.partitionBy(F.lit(0)))
    return d.withColumn("chosen", F.coalesce(F.col("rung") == first, F.lit(False)))


def _in_rung(rung: Rung) -> Column:
    whole = functools.reduce(operator.and_, (F.col(c).isNotNull() for c in rung.columns))
    return whole if rung.where is None else whole & F.coalesce(rung.where, F.lit(False))


def fit_ladder(df: DataFrame, key: str, label: str, rungs: Sequence[Rung], least: int = 25, reps: int = 200, folds: int = 5, seed: int = 0) -> DataFrame:
    """``ladder`` with the graded accuracy of the chosen arm; the other arms have none. No arm is fitted where none is large
    enough."""
    steps = written(ladder(df, key, label, rungs, least), "ladder")
    chosen = [r["rung"] for r in steps.where("chosen").collect()]
    if not chosen:
        return steps.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("balanced_accuracy", "double"), ("p", "double"), ("verdict", "string"))))
    own = rungs[chosen[0]]
    got = permutation_test(df.where(_in_rung(own)), key, list(own.columns), label, reps, folds, seed=seed)
    found = got.select(F.lit(chosen[0]).alias("rung"), "balanced_accuracy", "p", "verdict")
    return steps.join(found, "rung", "left")


def compare_arms(df: DataFrame, key: str, sets: Mapping[str, Sequence[str]], label: str, reps: int = 39, folds: int = 5, seed: int = 0) -> DataFrame:
    """A row for each arm of ``arms``: its graded accuracy, the branch of its interval against the first arm's, whether all
    together beats each arm by itself, and which arm leads."""
    rows = [{"arm": name, "n_features": len(columns), **permutation_test(d, key, columns, label, reps, folds, seed=seed).head().asDict()} for name, d, columns in arms(df, sets)]
    spark = df.sparkSession
    d = spark.createDataFrame(rows)
    by = {r["arm"]: r for r in rows}
    first = by[next(iter(sets))]
    beats = all(by["both"]["ci_low"] > by[name]["ci_high"] for name in sets)
    lead = max(sets.keys() | {"both"}, key=lambda name: (by[name]["balanced_accuracy"], name))
    return d.withColumns({"branch": branch(F.lit(first["ci_low"]), F.lit(first["ci_high"]), F.col("ci_low"), F.col("ci_high")), "beats_each": (F.col("arm") == "both") & F.lit(beats), "leads": F.col("arm") == lead})


# The grades and their limits.
def verdict(bacc: Column, low: Column, p: Column, min_recall: Column, baseline: Column) -> Column:
    """Grade of a test: above chance needs both its interval and its p; claims on individuals need every class recalled."""
    above = (low > baseline) & (p < 0.05)
    strength = F.when(bacc < 0.60, "weak").when(bacc < 0.75, "moderate").otherwise("strong")
    return F.when(~above, "at chance").when(min_recall < 0.10, "association only").when(min_recall < 0.50, "association, no assignment").otherwise(F.concat(F.lit("separable: "), strength))


def branch(base_low: Column, base_high: Column, low: Column, high: Column) -> Column:
    """B: the combined interval lies above the base's; C: below; A: they meet."""
    return F.when(low > base_high, "B").when(high < base_low, "C").otherwise("A")


def evaluable(smallest: Column, least: int = 25) -> Column:
    return F.when(smallest >= least, "ok").otherwise(F.concat(F.lit("skipped: smallest class "), smallest.cast("string")))


def leaf_sizes(per_fold: Column, least: int = 25) -> Column:
    """Leaf sizes to report: both where the rare class is small in a training fold."""
    return F.when(per_fold < least, F.array(F.lit(2), F.lit(20))).otherwise(F.array(F.lit(20)))
