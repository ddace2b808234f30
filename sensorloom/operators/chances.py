"""p values as column expressions: normal, chi-squared and Student's t, from finite sums and continued fractions.

Each is one fold over the places of a series, from the last to the first, so any SQL engine that folds lists repeats it
(``..._sql``). They are for summary rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the series of erf and of the fractions of erfc and of the incomplete beta function.
ERF, ERFC, BETA = 60, 60, 200
#: Degrees of freedom from which on Student's t is taken as normal after Wallace's transformation (error below 1e-8).
MANY = 10_000


def _fold(count: Column | int, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` for each place from ``count`` down to 1; none where it is below 1."""
    n = count if isinstance(count, Column) else F.lit(count)
    places = F.reverse(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")))
    return F.aggregate(places, start.cast("double"), lambda f, i: F.when(i <= n, step(f, i.cast("double"))).otherwise(f))


def _fold_sql(count: str, start: str, step: str) -> str:
    """The same in SQL; ``step`` is of f and i."""
    return f"list_reduce([({start})::DOUBLE] || list_reverse(range(1, ({count})::BIGINT + 1))::DOUBLE[], lambda f, i: {step})"


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0."""
    square = z * z
    low = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * z * _fold(ERF, F.lit(1.0), lambda f, i: 1 + f * 2 * square / (2 * i + 1))
    high = F.exp(-square) / math.sqrt(math.pi) / _fold(ERFC, z, lambda f, i: z + i / 2 / f)
    return F.when(z < 3, low).otherwise(high)


def erfc_sql(z: str) -> str:
    low = f"1 - {2 / math.sqrt(math.pi)} * exp(-({z}) * ({z})) * ({z}) * {_fold_sql(str(ERF), '1', f'1 + f * 2 * ({z}) * ({z}) / (2 * i + 1)')}"
    high = f"exp(-({z}) * ({z})) / {math.sqrt(math.pi)} / {_fold_sql(str(ERFC), z, f'({z}) + i / 2 / f')}"
    return f"CASE WHEN ({z}) < 3 THEN {low} ELSE {high} END"


def normal_p(z: Column) -> Column:
    """Two-sided."""
    return erfc(F.abs(z) / math.sqrt(2))


def normal_p_sql(z: str) -> str:
    return erfc_sql(f"abs({z}) / {math.sqrt(2)}")


def chi_squared_p(value: Column, df: Column) -> Column:
    """Upper tail of chi-squared with whole degrees of freedom: a finite sum, and erfc where they are odd."""
    x = value / 2
    even = F.exp(-x) * _fold(F.floor(df / 2) - 1, F.lit(1.0), lambda f, i: 1 + f * x / i)
    more = F.exp(-x) * F.sqrt(x) * (2 / math.sqrt(math.pi)) * _fold(F.floor((df - 3) / 2), F.lit(1.0), lambda f, i: 1 + f * x / (i + 0.5))
    odd = erfc(F.sqrt(x)) + F.when(df >= 3, more).otherwise(0.0)
    return F.when(df % 2 == 0, even).otherwise(odd)


def chi_squared_p_sql(value: str, df: int) -> str:
    x = f"(({value}) / 2)"
    if df % 2 == 0:
        return f"exp(-{x}) * {_fold_sql(str(df // 2 - 1), '1', f'1 + f * {x} / i')}"
    more = f"exp(-{x}) * sqrt({x}) * {2 / math.sqrt(math.pi)} * {_fold_sql(str((df - 3) // 2), '1', f'1 + f * {x} / (i + 0.5)')}"
    return f"({erfc_sql(f'sqrt({x})')})" + (f" + {more}" if df >= 3 else "")


def log_gamma(z: Column) -> Column:
    """Stirling's series eight places further on."""
    w = z + 8
    own = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * F.pow(w, F.lit(5.0)))
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return own - F.log(product)


def _beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, for x below (a + 1) / (a + b + 2)."""

    def part(i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd)

    front = F.exp(a * F.log(x) + b * F.log(1 - x) - log_gamma(a) - log_gamma(b) + log_gamma(a + b)) / a
    return front / _fold(BETA, F.lit(1.0), lambda f, i: 1 + part(i) / f)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null where t is, or without degrees of freedom."""
    df = df.cast("double")
    x, half = df / (df + t * t), F.lit(0.5)
    near = _beta(x, df / 2, half)
    far = 1 - _beta(1 - x, half, df / 2)
    few = F.when(x >= 1, 1.0).when(x < (df / 2 + 1) / (df / 2 + 2.5), near).otherwise(far)
    many = normal_p((8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log(1 + t * t / df)))
    return F.when(df > 0, F.when(df > MANY, many).otherwise(few))


def student_p_sql(t: str, df: str) -> str:
    """The same by the engine's own log-gamma, and the angle's series for whole degrees of freedom below ``MANY``: the
    chance between -t and t is a finite sum in the cosine of atan(t / sqrt(df))."""
    cos2 = f"(({df}) / (({df}) + ({t}) * ({t})))"
    sine = f"(abs({t}) / sqrt(({df}) + ({t}) * ({t})))"
    even = f"{sine} * {_fold_sql(f'({df}) // 2 - 1', '1', f'1 + f * {cos2} * (2 * i - 1) / (2 * i)')}"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + CASE WHEN ({df}) > 1 THEN {sine} * sqrt({cos2}) * {_fold_sql(f'(({df}) - 3) // 2', '1', f'1 + f * {cos2} * (2 * i) / (2 * i + 1)')} ELSE 0 END)"
    return f"1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END"
