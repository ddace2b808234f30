"""Rank statistics, effect sizes, false-discovery control, regressions.

Ranks come from counts of distinct values and running sums over them: values are dealt to tasks by ranges, each sums its
own range, and the totals of the ranges before are added. A statistic is an aggregate over those counts. Only the last
step, from statistic to p, is Python, on summary rows.
"""

import functools
import math
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import chances
from sensorloom.session import written


def unpivot(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """(ids, variable, value) of non-null values."""
    return df.unpivot(list(ids), list(variables), "variable", "value").where(F.col("value").isNotNull())


def running_sums(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` (a row for each value inside ``by``) with ``<sum>_upto``: the sum over it and all values before it.

    Ranges of values are written, so that their numbers stay; only a row for each range, and each ``by`` in it, is summed
    in order as a whole.
    """
    order = F.desc(value) if descending else F.asc(value)
    ranged = written(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = ranged.groupBy("_range", *by).agg(*(F.sum(c).alias(f"{c}_t") for c in sums))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_range", *by, *(F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0)).alias(f"{c}_b") for c in sums))
    inside = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = ranged.withColumns({f"{c}_o": F.sum(c).over(inside) for c in sums}).join(offsets, ["_range", *by])
    return d.select(*df.columns, *((F.col(f"{c}_o") + F.col(f"{c}_b")).alias(f"{c}_upto") for c in sums))


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per ``by`` and distinct value: its count (ties) and mid-rank."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running_sums(counted, by, value, ["ties"]).withColumn("rank", F.col("ties_upto") - (F.col("ties") - 1) / 2).drop("ties_upto")


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """``df`` with the mid-rank of its value (average of ties) inside ``by``."""
    return df.join(value_ranks(df, by, value).select(*by, value, F.col("rank").alias(name)), [*by, value])


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, linear between two values: the same as ``percentile``'s, null for a column of nulls.

    Places are running sums over distinct values, so no task holds a column; two values for each share come to the driver.
    """
    found = group_quantiles(df.withColumn("_all", F.lit(0)), "_all", columns, shares)
    got = {(r["variable"], r["k"]): r["value"] for r in found.collect()}
    return {c: [got.get((c, k)) for k in range(len(shares))] for c in columns}


def group_quantiles(df: DataFrame, by: str, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, variable, n, k, value): the quantile of each share (k: its place among them) of each column in each group, by
    selection of ranks. Runs until it returns, as ``running_sums`` writes its ranges."""
    long = unpivot(df.select(by, *(F.col(c).cast("double").alias(c) for c in columns)), [by], columns)
    placed = running_sums(long.groupBy(by, "variable", "value").agg(F.count("*").alias("ties")), [by, "variable"], "value", ["ties"])
    total = placed.groupBy(by, "variable").agg(F.max("ties_upto").alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for k, q in enumerate(shares))))
    wanted = total.select(by, "variable", "n", asked.alias("w")).select(by, "variable", "n", "w.k", "w.at")
    # Groups, columns and shares are few: all their places as one list for each group and column.
    lists = wanted.groupBy(by, "variable", "n").agg(F.collect_list(F.struct("k", "at")).alias("all"))
    inside = lambda place: (place >= F.col("ties_upto") - F.col("ties")) & (place < F.col("ties_upto"))
    low = lambda x: F.floor(x["at"])
    high = lambda x: F.least(F.floor(x["at"]) + 1, F.col("n") - 1)
    share = lambda x: x["at"] - F.floor(x["at"])
    met = placed.join(lists, [by, "variable"]).withColumn("hit", F.filter("all", lambda x: inside(low(x)) | inside(high(x)))).where(F.size("hit") > 0)
    parts = F.transform("hit", lambda x: F.struct(x["k"].alias("k"), F.when(inside(low(x)), 1 - share(x)).otherwise(0.0).alias("a"), F.when(inside(high(x)), share(x)).otherwise(0.0).alias("b")))
    each = met.select(by, "variable", "n", "value", F.explode(parts).alias("p"))
    return each.groupBy(by, "variable", "n", "p.k").agg(F.sum(F.col("value") * (F.col("p.a") + F.col("p.b"))).alias("value")).select(by, "variable", "n", "k", "value")


def _ranked(df: DataFrame, by: Sequence[str], value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Rank sums by group, and total and tie term by variable."""
    ranks = value_ranks(df, by, value)
    sums = df.groupBy(*by, value, group).agg(F.count("*").alias("_c")).join(ranks, [*by, value]).groupBy(*by, group).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("rank")).alias("rank_sum"))
    t = F.col("ties").cast("double")
    total = ranks.groupBy(*by).agg(F.sum("ties").alias("total"), F.sum(t * t * t - t).alias("tie"))
    return sums, total


def kruskal_wallis(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """H with tie correction, number of groups and rows, eta squared, and p by chi-squared with one degree less than groups.

    All values tied: H is null. One group: p is null.
    """
    sums, total = _ranked(df, by, value, group)
    n = F.col("total").cast("double")
    d = sums.groupBy(*by).agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count("*").alias("k")).join(total, list(by))
    correction = 1 - F.col("tie") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.when(correction > 0, correction)
    d = d.withColumn("h", h)
    eta = F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k")))
    p = F.when(F.col("k") > 1, chances.chi_squared_p(F.greatest("h", F.lit(0.0)), F.col("k") - 1))
    return d.select(*by, F.col("total").alias("n"), "k", "h", eta.alias("eta2"), p.alias("p"))


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, group: str, first: object, second: object, p: bool = False) -> DataFrame:
    """U of the first group, rank-biserial 1 - 2U/(n1 n2), Cliff's delta (its negative) and z with tie and continuity
    correction (null when all values are tied); with ``p`` also p: ``mann_whitney_p``."""
    d = df.where(F.col(group).isin(first, second))
    sums, total = _ranked(d, by, value, group)
    part = lambda g, c: F.sum(F.when(F.col(group) == g, F.col(c)))
    d = sums.groupBy(*by).agg(part(first, "n").alias("n1"), part(second, "n").alias("n2"), part(first, "rank_sum").alias("r1")).dropna().join(total, list(by))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("total").cast("double")
    d = d.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.when(sd > 0, sd)
    d = d.select(*by, "n1", "n2", "u", (1 - 2 * F.col("u") / (n1 * n2)).alias("rank_biserial"), (2 * F.col("u") / (n1 * n2) - 1).alias("cliffs_delta"), z.alias("z"), "tie")
    return mann_whitney_p(d).drop("tie") if p else d.drop("tie")


#: Groups up to which U without ties has its exact distribution: the smaller and the larger one.
SMALL, LARGE = 8, 200


def mann_whitney_p(rows: DataFrame) -> DataFrame:
    """Adds the two-sided p of rows (n1, n2, u, z, tie): exact where no values are tied, the smaller group has ``SMALL`` rows
    at most and the larger ``LARGE``, else normal.

    The exact distributions are a small table: of each pair of sizes that comes up, a row for each U up to the middle.
    """
    exact = (F.col("tie") == 0) & (F.least("n1", "n2") <= SMALL) & (F.greatest("n1", "n2") <= LARGE)
    d = rows.withColumn("_exact", exact)
    sizes = [(a, b) for a in range(1, SMALL + 1) for b in range(a, LARGE + 1)]
    there = {(r["a"], r["b"]) for r in d.where("_exact").select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct().limit(len(sizes)).collect()}
    table = [(a, b, u, min(1.0, 2 * c)) for a, b in sorted(there) for u, c in enumerate(exact_u(a, b)[: a * b // 2 + 1])]
    known = rows.sparkSession.createDataFrame(table, "_a bigint, _b bigint, _u bigint, _p double")
    low = F.least(F.col("u"), F.col("n1") * F.col("n2") - F.col("u")).cast("bigint")
    met = d.join(F.broadcast(known), F.col("_exact") & (F.least("n1", "n2") == F.col("_a")) & (F.greatest("n1", "n2") == F.col("_b")) & (low == F.col("_u")), "left")
    return met.select(*rows.columns, F.coalesce("_p", chances.normal_p(F.col("z"))).alias("p"), F.coalesce("_exact", F.lit(False)).alias("exact"))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function of df / (df + t * t) at (df / 2, 1 / 2), by
    Simpson's rule after a substitution that leaves a smooth integrand."""
    if df <= 0 or math.isnan(t):
        return math.nan
    # With x = sqrt(df) * tan(u) the density is a constant times cos(u) ** (df - 1), on [0, pi / 2).
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    end = math.atan(abs(t) / math.sqrt(df))
    u = np.linspace(end, math.pi / 2, 4_001)
    f = np.maximum(np.cos(u), 0.0) ** (df - 1)
    step = (math.pi / 2 - end) / 4_000
    return min(1.0, float(2 * const * step / 3 * (f[0] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum() + f[-1])))


def student_quantile(p: float, df: float) -> float:
    """The t that leaves p in both tails together."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_p(middle, df) > p else (low, middle)
    return low


def with_p(rows: DataFrame, p: Callable[..., float], inputs: Sequence[str], name: str = "p") -> DataFrame:
    """Adds p of a summary table's columns; null where one is null. For summary rows only: each calls a Python function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            own = d[list(inputs)].astype(float)
            yield d.assign(**{name: [None if any(math.isnan(v) for v in r) else p(*r) for r in own.itertuples(index=False)]})

    return rows.mapInPandas(run, rows.withColumn(name, F.lit(None).cast("double")).schema)


def exact_u(n1: int, n2: int) -> list[float]:
    """Cumulative probabilities of U without ties, for small groups: counts of the partitions of each U."""
    ways = [1] + [0] * (n1 * n2)
    for k in range(1, n1 + 1):
        for u in range(len(ways) - 1, n2 + k - 1, -1):
            ways[u] -= ways[u - n2 - k]
        for u in range(k, len(ways)):
            ways[u] += ways[u - k]
    total = math.comb(n1 + n2, n1)
    return [sum(ways[: k + 1]) / total for k in range(len(ways))]


def benjamini_hochberg(df: DataFrame, p: str = "p", family: Sequence[str] = (), missing_is_one: bool = False) -> DataFrame:
    """Adds ``q``: least over larger p of p * m / rank, at most 1, inside each family of summary rows."""
    d = df.withColumn("_p", F.coalesce(p, F.lit(1.0)) if missing_is_one else F.col(p))
    fam = [F.col(c) for c in family] or [F.lit(1)]
    own = Window.partitionBy(*fam)
    ranked = d.withColumn("_r", F.count("_p").over(own.orderBy("_p").rangeBetween(Window.unboundedPreceding, 0))).withColumn("_m", F.count("_p").over(own))
    q = F.min(F.col("_p") * F.col("_m") / F.col("_r")).over(own.orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), q))).drop("_p", "_r", "_m")


def bonferroni(p: Column, times: int) -> Column:
    return F.least(F.lit(1.0), times * p)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rho and n of rows where both are present."""
    keys = list(by) or ["_all"]
    d = df.dropna(subset=[a, b]).withColumn("_all", F.lit(1))
    d = mid_ranks(mid_ranks(d, keys, a, "_ra"), keys, b, "_rb")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho")).drop("_all")


def spearman_p(rho: DataFrame) -> DataFrame:
    """Adds t and its two-sided p to rows (n, rho); null where rho is 1 or -1 but for rounding."""
    rest = 1 - F.col("rho") * F.col("rho")
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(rest > 1e-12, rest))
    return rho.withColumns({"t": t, "df": F.col("n") - 2}).withColumn("p", chances.student_p(F.col("t"), F.col("df")))


def cohens_d(value: str, group: Column) -> Column:
    """Difference of means of both sides of a condition over the pooled standard deviation; null below two rows a side."""
    v = F.col(value)
    a, b = F.when(group, v), F.when(~group, v)
    n1, n2 = F.count(a), F.count(b)
    pooled = F.sqrt(((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b)) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (F.avg(a) - F.avg(b)) / pooled)


def welch(value: str, group: Column) -> dict[str, Column]:
    """Gap of means, Welch's t and degrees of freedom, and the normal 95 % interval of the gap."""
    v = F.col(value)
    a, b = F.when(group, v), F.when(~group, v)
    s1, s2 = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    gap, se = F.avg(a) - F.avg(b), F.sqrt(s1 + s2)
    df = (s1 + s2) * (s1 + s2) / (s1 * s1 / (F.count(a) - 1) + s2 * s2 / (F.count(b) - 1))
    return {"gap": gap, "t": gap / se, "df": df, "low": gap - 1.96 * se, "high": gap + 1.96 * se}


def odds_ratio(a: Column, b: Column) -> dict[str, Column]:
    """Cells and sample odds ratio of two conditions (null with an empty cell in the denominator)."""
    cell = lambda x, y: F.count_if(x & y)
    n11, n10, n01, n00 = cell(a, b), cell(a, ~b), cell(~a, b), cell(~a, ~b)
    return {"n11": n11, "n10": n10, "n01": n01, "n00": n00, "odds_ratio": n11 * n00 / F.nullif(n10 * n01, F.lit(0))}


def fisher_exact(n11: int, n10: int, n01: int, n00: int) -> float:
    """Two-sided p: the probability of all tables with the same margins that are at most as likely.

    From the most likely table outwards to both sides, each chance from its neighbour's; a side ends where what follows
    adds nothing, so the work grows with the spread of the cell and not with the margins.
    """
    n11, n10, n01, n00 = map(int, (n11, n10, n01, n00))
    row, col, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    low, high = max(0, row + col - n), min(row, col)
    top = min(max((row + 1) * (col + 1) // (n + 2), low), high)
    up = lambda k: (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
    log = lambda k: math.lgamma(k + 1)
    chance = lambda k: log(row) + log(n - row) + log(col) + log(n - col) - log(n) - log(k) - log(row - k) - log(col - k) - log(n - row - col + k)
    own, first = math.exp(chance(n11) - chance(top)) * (1 + 1e-7), math.exp(chance(top))
    total = 1.0 if own >= 1.0 else 0.0
    for way, end in ((1, high), (-1, low)):
        k, share = top, 1.0
        while k != end:
            share *= up(k) if way > 0 else 1 / up(k - 1)
            k += way
            total += share if share <= own else 0.0
            if share < 1e-18 * max(total, own):
                break
    return min(1.0, total * first)


def least_squares(df: DataFrame, y: str, terms: dict[str, Column]) -> dict[str, tuple[float, float, int]]:
    """Coefficient, standard error and degrees of freedom of an intercept and each term, from one aggregation of
    cross-products.

    Rows with a null in any term are left out. The terms are few, so the system solved on the driver is small.
    """
    names = ["intercept", *terms]
    d = df.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("t0"), *(c.cast("double").alias(f"t{k + 1}") for k, c in enumerate(terms.values()))).dropna()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = d.agg(F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"x{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"t{i}") * F.col("_y")).alias(f"y{i}") for i in range(k))).head()
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = row[f"x{i}_{j}"]
    xy = np.array([row[f"y{i}"] for i in range(k)])
    beta = np.linalg.solve(xx, xy)
    rest = max(0.0, row["yy"] - beta @ xy) / max(1, row["n"] - k)
    error = np.sqrt(np.diag(np.linalg.inv(xx)) * rest)
    return {name: (float(b), float(e), row["n"] - k) for name, b, e in zip(names, beta, error, strict=True)}


def coefficients(df: DataFrame, y: str, terms: dict[str, Column]) -> DataFrame:
    """(term, beta, se, t, p, low, high) of ``least_squares``, with the 95 % interval."""
    rows = []
    for name, (beta, se, free) in least_squares(df, y, terms).items():
        half = student_quantile(0.05, free) * se
        rows.append((name, beta, se, beta / se if se else None, student_p(beta / se, free) if se else None, beta - half, beta + half))
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double, p double, low double, high double")


def threshold_sweep(df: DataFrame, value: str, label: Column) -> DataFrame:
    """For each distinct cutoff (>= selects): number selected, hits, Jaccard, precision, recall against a label, by running
    sums over distinct values from the top."""
    each = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"), F.count_if(label).alias("h"))
    positives = df.agg(F.count_if(label)).head()[0]
    d = running_sums(each, [], value, ["c", "h"], descending=True)
    d = d.select(F.col(value).alias("cutoff"), F.col("c_upto").alias("n_selected"), F.col("h_upto").alias("hits"))
    any_ = F.col("n_selected") + positives - F.col("hits")
    return d.select("*", (F.col("hits") / any_).alias("jaccard"), (F.col("hits") / F.col("n_selected")).alias("precision"), (F.col("hits") / F.nullif(F.lit(positives), F.lit(0))).alias("recall"))


def decisions(values: DataFrame, rules: Sequence[tuple[str, float, bool]]) -> DataFrame:
    """(rule, value, limit_value, tripped) over a table (rule, value): rules are data (name, limit, whether below the limit
    trips). A rule without a value comes back with none and isn't tripped."""
    known = values.sparkSession.createDataFrame(list(rules), "rule string, limit_value double, below boolean")
    d = known.join(values.select("rule", F.col("value").cast("double").alias("value")), "rule", "left")
    tripped = F.when(F.col("below"), F.col("value") < F.col("limit_value")).otherwise(F.col("value") > F.col("limit_value"))
    return d.select("rule", "value", "limit_value", F.coalesce(tripped, F.lit(False)).alias("tripped"))


def mean_of(columns: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, columns) / len(columns)
