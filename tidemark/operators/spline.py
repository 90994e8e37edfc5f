"""Cubic spline through the knots of a series, as array folds.

Knots are an array of (t, y) in order of t.  The third derivative is continuous at the second and the
last but one knot, which takes the outer curvatures out of the system and leaves three bands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SWEPT = "array<struct<c:double, d:double>>"


def curvatures(knots: Column) -> Column:
    """Second derivatives at the knots: three knots bend alike, two don't bend, fewer have none."""
    n = F.size(knots)
    zero = F.lit(0.0)

    def t(i) -> Column:
        return F.get(knots, i)["t"]

    def y(i) -> Column:
        return F.get(knots, i)["y"]

    def gap(i) -> Column:
        return t(i + 1) - t(i)

    def bend(i) -> Column:
        """Change of the slope at an inner knot."""
        return (y(i + 1) - y(i)) / gap(i) - (y(i) - y(i - 1)) / gap(i - 1)

    def row(i: Column) -> Column:
        before, after = gap(i - 1), gap(i)
        first, last = i == 1, i == n - 2
        whole = before + after
        lower = F.when(first, zero).when(last, before - after * after / before).otherwise(before)
        upper = F.when(last, zero).when(first, after - before * before / after).otherwise(after)
        middle = 2 * whole + F.when(first, before * whole / after).otherwise(zero) + F.when(last, after * whole / before).otherwise(zero)
        return F.struct(lower.alias("lower"), middle.alias("middle"), upper.alias("upper"), (6 * bend(i)).alias("right"))

    def sweep(done: Column, r: Column) -> Column:
        top = F.coalesce(F.try_element_at(done, F.lit(-1)), F.struct(zero.alias("c"), zero.alias("d")))
        pivot = r["middle"] - r["lower"] * top["c"]
        return F.array_append(done, F.struct((r["upper"] / pivot).alias("c"), ((r["right"] - r["lower"] * top["d"]) / pivot).alias("d")))

    def back(found: Column, s: Column) -> Column:
        return F.array_append(found, s["d"] - s["c"] * F.coalesce(F.try_element_at(found, F.lit(-1)), zero))

    inner_rows = F.transform(F.sequence(F.lit(1), n - 2), row)
    swept = F.aggregate(inner_rows, F.array().cast(_SWEPT), sweep)
    inner = F.reverse(F.aggregate(F.reverse(swept), F.array().cast("array<double>"), back))

    def ends(m: Column) -> Column:
        start = ((gap(0) + gap(1)) * F.get(m, 0) - gap(0) * F.get(m, 1)) / gap(1)
        near, far = gap(n - 2), gap(n - 3)
        end = ((far + near) * F.try_element_at(m, F.lit(-1)) - near * F.try_element_at(m, F.lit(-2))) / far
        return F.concat(F.array(start), m, F.array(end))

    long = F.get(F.transform(F.array(inner), ends), 0)
    three = F.array_repeat(6 * bend(1) / (3 * (gap(0) + gap(1))), 3)
    return F.when(n >= 4, long).when(n == 3, three).when(n == 2, F.array(zero, zero)).otherwise(F.array().cast("array<double>"))


def between(t: Column, a: Column, b: Column, m_a: Column, m_b: Column) -> Column:
    """Value at ``t`` between the knots ``a`` and ``b`` with curvatures ``m_a`` and ``m_b``; NULL outside."""
    h = F.nullif(b["t"] - a["t"], F.lit(0.0))
    u, v = (b["t"] - t) / h, (t - a["t"]) / h
    return u * a["y"] + v * b["y"] + ((u * u * u - u) * m_a + (v * v * v - v) * m_b) * h * h / 6
