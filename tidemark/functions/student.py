"""Two-sided Student-t p-value as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom up to which the finite sum is used; beyond, the normal approximation
#: below is exact to about 1e-12.
EXACT_DF = 1000
#: Terms of the error-function series (for z < 3) and depth of the tail fraction (for z >= 3).
SERIES_TERMS, FRACTION_DEPTH = 60, 80


def _finite_sum(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole df: a sum of df / 2 terms in the cosine of atan(t / sqrt(df))."""
    theta = F.atan(t / F.sqrt(df))
    square = F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    # Each term is the one before it times cos^2 and a ratio of two neighbouring numbers.
    last = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(state: Column, k: Column) -> Column:
        ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = state["term"] * square * ratio
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    terms = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, start, step)["total"]
    sine, cosine = F.sin(theta), F.cos(theta)
    inside = F.when(odd, (theta + F.when(df > 1, sine * cosine * total).otherwise(0.0)) * (2 / math.pi)).otherwise(sine * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def normal_tail(z: Column) -> Column:
    """P(|Z| >= z) of a standard normal, z >= 0: a power series near the middle, a fraction in the tail."""
    half = z / math.sqrt(2)
    start = F.struct(half.alias("term"), half.alias("total"))

    def series(state: Column, k: Column) -> Column:
        term = -state["term"] * half * half / k
        return F.struct(term.alias("term"), (state["total"] + term / (2 * k + 1)).alias("total"))

    middle = 1 - 2 / math.sqrt(math.pi) * F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, series)["total"]
    fraction = F.aggregate(F.sequence(F.lit(FRACTION_DEPTH), F.lit(1)), F.lit(0.0), lambda acc, k: k / (z + acc))
    tail = math.sqrt(2 / math.pi) * F.exp(-z * z / 2) / (z + fraction)
    return F.when(z < 3, middle).otherwise(tail)


def _large(t: Column, df: Column) -> Column:
    """Normal deviate of a large df by the expansion of log(1 + t^2 / df) in 1 / df."""
    a = df - 0.5
    b = 48 * a * a
    y2 = a * F.log1p(t * t / df)
    y = F.sqrt(y2)
    z = y + (y2 * y + 3 * y) / b - (4 * F.pow(y, 7) + 33 * F.pow(y, 5) + 240 * F.pow(y, 3) + 855 * y) / (10 * b * (b + 0.8 * F.pow(y, 4) + 100))
    return normal_tail(z)


def student_p(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|) for Student's t with a whole number of degrees of freedom.

    NULL where t or df is NULL or NaN, or df is not positive.
    """
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    size, whole = F.abs(t.cast("double")), df.cast("double")
    known = size.isNotNull() & whole.isNotNull() & ~F.isnan(size) & ~F.isnan(whole) & (whole > 0)
    p = F.when(whole <= EXACT_DF, _finite_sum(size, whole)).otherwise(_large(size, whole))
    return F.when(known, p)
