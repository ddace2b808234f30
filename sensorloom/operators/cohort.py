"""Cohort tables: joins with guards, imputation, standard scores, coverage, eligibility and prevalence."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import stats


class GuardError(ValueError):
    """A table breaks a rule that later steps rely on."""


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as it is, if its keys are unique; one aggregate decides."""
    many = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if many:
        raise GuardError(f"{keys} is not unique: {many[0].asDict()}")
    return df


def right_wins(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on the key; columns of both tables come from the right one, even where it has null."""
    both = [c for c in left.columns if c in right.columns and c != key]
    return left.drop(*both).join(right, key, how)


def lookup(column: str, pairs: Mapping) -> Column:
    """The value of each code, null for unknown codes."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.element_at(F.create_map(*flat), F.col(column))


def last_wins(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order; as a dictionary keeps the last of repeated keys."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attribute(eav: DataFrame, entity: str, concept: str, value: str, wanted: object, name: str, tie: Sequence[str]) -> DataFrame:
    """One concept of an entity-attribute-value table as a column: the first row of each entity by ``tie``."""
    w = Window.partitionBy(entity).orderBy(*tie)
    one = eav.where(F.col(concept) == wanted).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.select(entity, F.col(value).alias(name))


def not_preceded(events: DataFrame, others: DataFrame, key: str, at: str, other_at: str, before: int, until: int) -> DataFrame:
    """Events without another one of the same key in [at - before, at - until] (both ends count).

    The join is on key and a bucket as long as that interval: another one counts for its own bucket and the next.
    """
    long = max(1, before - until)
    bucket = lambda c: F.floor(c / long)
    e = events.withColumn("_bucket", bucket(F.col(at) - until)).alias("e")
    o = others.withColumn("_bucket", F.explode(F.array(bucket(F.col(other_at)), bucket(F.col(other_at)) + 1))).alias("o")
    near = (F.col(f"e.{key}") == F.col(f"o.{key}")) & (F.col("e._bucket") == F.col("o._bucket")) & F.col(f"o.{other_at}").between(F.col(f"e.{at}") - before, F.col(f"e.{at}") - until)
    return e.join(o, near, "left_anti").drop("_bucket")


def count_with_zero(everyone: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias(name))
    return everyone.select(key).distinct().join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def statistics(df: DataFrame, columns: Sequence[str], functions: Mapping[str, object]) -> dict[tuple[str, str], Column]:
    """One aggregation of the columns; its single row comes back as literals by (column, name)."""
    row = df.agg(*(f(c).alias(f"{k}_{name}") for k, c in enumerate(columns) for name, f in functions.items())).head()
    return {(c, name): F.lit(row[f"{k}_{name}"]) for k, c in enumerate(columns) for name in functions}


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of each column become its exact median, which is selected by rank; a column of nulls stays."""
    middle = stats.quantiles(df, columns, [0.5])
    return df.select(*(F.coalesce(c, F.lit(middle[c][0]).cast("double")).alias(c) if c in columns else c for c in df.columns))


def standard_scores(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Each column less its mean, over its population standard deviation (a constant column: 0)."""
    s = statistics(df, columns, {"mean": F.avg, "sd": F.stddev_pop})
    z = {c: ((F.col(c) - s[c, "mean"]) / F.when(s[c, "sd"] == 0, 1.0).otherwise(s[c, "sd"])).alias(c + suffix) for c in columns}
    if suffix:
        return df.select(*df.columns, *z.values())
    return df.select(*(z.get(c, c) for c in df.columns))


def severity(df: DataFrame, columns: Sequence[str], name: str = "severity") -> DataFrame:
    """Mean of the columns' standard scores."""
    d = standard_scores(df, columns, "_z")
    mean = functools.reduce(operator.add, (F.col(f"{c}_z") for c in columns)) / len(columns)
    return d.select(*df.columns, mean.alias(name))


def extreme_levels(df: DataFrame, key: str, score: str, few: Column, share: float = 0.03) -> DataFrame:
    """Adds ``level``: 'few' for the rare class; of the rest 'extreme' for those among the n highest scores of all, where
    n is the size of the rare class or the share of all rows (half to even), whichever is more; else 'mild'.

    The n-th score comes from a partial top-n, not from a ranking of all rows in one task.
    """
    sizes = df.agg(F.count("*").alias("n"), F.count_if(few).alias("f")).head()
    n = max(sizes["f"], int(round(share * sizes["n"])))
    top = df.select(key, score).orderBy(F.desc(score), key).limit(n).withColumn("_top", F.lit(True))
    d = df.join(top.select(key, "_top"), key, "left")
    return d.withColumn("level", F.when(few, "few").when(F.col("_top"), "extreme").otherwise("mild")).drop("_top")


def label_sets(df: DataFrame, key: str, code: str, level: str) -> DataFrame:
    """(labels, key, label) of the tasks that classes are told apart in: classes 0 and 1; all three; extreme and mild rows;
    the rare class, extreme, mild and class 1 as four; the rare class against the rest. Rows that a task leaves out are none
    of its."""
    c, x = F.col(code), F.col(level)
    sets = {
        "pair": F.when(c < 2, c),
        "three": c,
        "extremes": F.when(x == "extreme", 1).when(x == "mild", 0),
        "four": F.when(x == "few", 3).when(x == "extreme", 2).when(c == 1, 1).otherwise(0),
        "rare": (x == "few").cast("int"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("labels"), v.cast("int").alias("label")) for name, v in sets.items())))
    return df.select(key, each.alias("s")).where("s.label is not null").select("s.labels", key, "s.label")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts by row and column value, with the share of each in its row."""
    d = df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))
    total = functools.reduce(operator.add, (F.col(f"n_{v}") for v in values))
    return d.select("*", *((F.col(f"n_{v}") / F.nullif(total, F.lit(0))).alias(f"share_{v}") for v in values))


def composition(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share, baseline, difference): the share of each value in each row against its share of all."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    base = F.sum("n").over(Window.partitionBy(column)) / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return cells.select(row, column, "n", (F.col("n") / total).alias("share"), base.alias("baseline")).withColumn("difference", F.col("share") - F.col("baseline"))


def daily_coverage(df: DataFrame, pid: str, ts: str, value: Column) -> DataFrame:
    """Per participant and date of the timestamp: rows, hours with rows, usable (over 0), zero and hundred values."""
    return df.groupBy(pid, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct(F.hour(ts)).alias("hours_worn"), F.count_if(value > 0).alias("n_usable"), F.count_if(value == 0).alias("n_zero"), F.count_if(value == 100).alias("n_hundred")
    )


def activity_totals(df: DataFrame, pid: str, start: str, end: str, name: str, amount: str, active: Sequence[str], sedentary: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """Per participant and date: steps, active and sedentary minutes; durations below zero count as zero."""
    minutes = F.greatest(F.lit(0.0), (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 60e6)
    part = lambda names, v: F.sum(F.when(F.col(name).isin(*names), v).otherwise(0.0))
    return df.groupBy(pid, F.to_date(start).alias("day")).agg(part(steps, F.col(amount)).alias("steps"), part(active, minutes).alias("active_min"), part(sedentary, minutes).alias("sedentary_min"))


def overlay_days(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of both tables; what one of them lacks is 0."""
    d = a.join(b, list(keys), "full_outer")
    return d.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in d.columns if c not in keys))


def eligibility(days: DataFrame, pid: str, rules: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Per participant: days that meet each condition, whether every count reaches its minimum, and what falls short."""
    d = days.groupBy(pid).agg(*(F.count_if(cond).alias(f"{name}_days") for name, (cond, _) in rules.items()))
    short = [F.when(F.col(f"{name}_days") < least, F.lit(f"{name}_days<{least}")) for name, (_, least) in rules.items()]
    reason = F.concat_ws(";", *short)
    return d.select("*", (reason == "").alias("included"), reason.alias("reason"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Pairs of columns with the greatest absolute correlation; all of them in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("p")).select("p.*").orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov) of every pair, sample covariance, in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("p")).select("p.*")


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of both sets of ids, of their intersection and union, and the ratio."""
    d = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return d.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), both.alias("n_both"), F.count("*").alias("n_any"), (both / F.nullif(F.count("*"), F.lit(0))).alias("jaccard"))


def artifact_flags(df: DataFrame, step: float = 40.0, minutes: float = 60.0, flat: float = 8.0) -> DataFrame:
    """Low runs that look like sensor faults: a single-step drop and recovery, or a long flat night run."""
    square = (F.col("step_down") >= step) & (F.col("step_up") >= step)
    compression = F.col("nocturnal") & (F.col("dur_min") >= minutes) & (F.col("within_range") <= flat)
    return df.withColumns({"square_wave": square, "compression": compression, "artifact": square | compression})


def matched_medians(a: DataFrame, b: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, variable, rows and median in either cohort, gap): how a group's features correspond between two cohorts."""
    side = lambda d, n, m: stats.group_quantiles(d, by, columns, [0.5]).select(by, "variable", F.col("n").alias(n), F.col("value").alias(m))
    d = side(a, "n_first", "first").join(side(b, "n_second", "second"), [by, "variable"])
    return d.withColumn("gap", F.col("second") - F.col("first"))


def agreement(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(variable, n, r, mad, least): correlation and median absolute difference of each feature by two extractors, and
    which correlates least."""
    side = lambda d, name: d.unpivot([key], list(columns), "variable", name)
    d = side(a, "x").join(side(b, "y"), [key, "variable"]).where("x is not null and y is not null")
    d = d.groupBy("variable").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.median(F.abs(F.col("x") - F.col("y"))).alias("mad"))
    return d.withColumn("least", F.col("r") == F.min("r").over(Window.partitionBy(F.lit(0))))


def against_published(row: DataFrame, published: Mapping[str, float], tolerance: float) -> DataFrame:
    """(what, value, published, gap, within_tolerance) of a one-row table's columns."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value"), F.lit(float(v)).alias("published")) for c, v in published.items())))
    gap = F.abs(F.col("value") - F.col("published"))
    return row.select(rows.alias("r")).select("r.*").withColumns({"gap": gap, "within_tolerance": gap <= tolerance})
