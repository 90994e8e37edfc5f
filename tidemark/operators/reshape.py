"""Unions, melts, pivots and key scaffolds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_labelled(frames: dict[str, DataFrame], label: str = "type") -> DataFrame:
    """Stack frames with a column saying where each row came from."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def melt(df: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, values, name, value)


def drop_metric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def scaffold(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """One row per key and listed value; combinations without data are NULL.

    Every row stands in for its whole key, so one explode and one aggregate
    replace a key list joined to a value list.
    """
    rest = [c for c in df.columns if c not in [*keys, column]]
    hit = F.col(column) == F.col("_v")
    spread = df.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in values])))
    return spread.groupBy(*keys, F.col("_v").alias(column)).agg(
        *[F.max(F.when(hit, F.col(c))).alias(c) for c in rest]
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def impact_matrix(news: DataFrame, vintages: list[str]) -> DataFrame:
    """Series by vintage matrix of impacts; a cell with two rows is an error."""
    once = F.when(F.count("impact") <= 1, F.first("impact", ignorenulls=True)).otherwise(
        F.raise_error(F.lit("more than one impact for a series and vintage")).cast("double")
    )
    text = F.date_format("vintage", "yyyy-MM-dd")
    wanted = news.where(text.isin(vintages)).withColumn("_v", text)
    return wanted.groupBy("model", "quarter", "series_id").pivot("_v", vintages).agg(once)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Sort by vintage dates, quarter labels or years, whose order is their own."""
    return df.orderBy(*columns)
