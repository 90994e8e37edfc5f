"""Pairing two models' errors and testing the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.student import student_p

LOSSES = ["d_squared", "d_absolute", "d_signed"]


def pair_models(a: DataFrame, b: DataFrame, positional: bool = False) -> DataFrame:
    """Errors of two models side by side.

    By vintage only weeks that both models have are kept.  By position the
    n-th row of a quarter meets the n-th row of the other model; the shorter
    side is padded with NULL.
    """
    keys = ["model", "quarter", "vintage"]
    if positional:
        week = Window.partitionBy("model", "quarter").orderBy("vintage")
        a = a.withColumn("week", F.row_number().over(week))
        b = b.withColumn("week", F.row_number().over(week))
        keys = ["model", "quarter", "week"]
    left = a.select(*keys, F.col("error").alias("error_a"))
    right = b.select(*keys, F.col("error").alias("error_b"))
    return left.join(right, keys, "full" if positional else "inner")


def loss_differentials(pairs: DataFrame) -> DataFrame:
    a, b = F.col("error_a"), F.col("error_b")
    return pairs.withColumns(
        {"d_squared": a * a - b * b, "d_absolute": F.abs(a) - F.abs(b), "d_signed": a - b}
    )


def t_statistic(c: str) -> Column:
    """Mean over its standard error; NULL when the spread is zero or unknown."""
    return F.try_divide(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c)))


def one_sample_t(df: DataFrame, column: str, by: list[str], p_value: bool = True) -> DataFrame:
    """Test of mean zero by group."""
    table = df.groupBy(*by).agg(
        t_statistic(column).alias("t"), F.count(column).alias("n"),
    )
    if not p_value:
        return table
    return table.withColumn("p", student_p("t", (F.col("n") - 1).cast("double")))


def sample_labels(year: Column, excluded: int) -> Column:
    """The overlapping samples a year belongs to."""
    return F.array_compact(
        F.array(
            F.lit("Full sample"),
            F.when(year != excluded, F.lit(f"Excluding {excluded}")),
            F.when(year < excluded, F.lit(f"Pre-{excluded}")),
            F.when(year > excluded, F.lit(f"Post-{excluded}")),
        )
    )


def compare_models(
    pairs: DataFrame, excluded: int, by: list[str] | None = None, p_value: bool = True
) -> DataFrame:
    """t statistics of the three loss differentials in four overlapping samples.

    A row is exploded into its samples before a map-side aggregate, so only
    one row per group and task is shuffled.  ``observations`` counts rows,
    also those in which one model has no value.
    """
    by = list(by or [])
    losses = loss_differentials(pairs)
    rows = losses.select("*", F.explode(sample_labels(cal.label_year("quarter"), excluded)).alias("sample"))
    table = rows.groupBy(*by, "sample").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("d_signed").alias("pairs"),
        *[t_statistic(c).alias("t" + c[1:]) for c in LOSSES],
    )
    if not p_value:
        return table
    df = (F.col("pairs") - 1).cast("double")
    return table.withColumns({"p" + c[1:]: student_p("t" + c[1:], df) for c in LOSSES})
