"""News impacts summed by series, category, quarter and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.reshape import scaffold

OTHER = "Other"


def _total(c: str = "impact") -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)


def with_category(df: DataFrame, mapping: DataFrame, default: str = OTHER) -> DataFrame:
    """Category of each series, ``default`` where the mapping has none."""
    return df.join(mapping.select("series_id", "category"), "series_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(default))
    )


def unmatched_series(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Series ids that fall to the default category."""
    return df.select("series_id").distinct().join(mapping, "series_id", "left_anti")


def impact_by_series(news: DataFrame) -> DataFrame:
    return news.groupBy("model", "quarter", "series_id").agg(_total())


def impact_by_vintage_category(news: DataFrame) -> DataFrame:
    """Needs ``category`` and ``vintage_ordinal``."""
    return news.groupBy("model", "quarter", "vintage", "vintage_ordinal", "category").agg(_total())


def impact_by_quarter_category(news: DataFrame) -> DataFrame:
    return news.groupBy("model", "quarter", "category").agg(_total())


def impact_by_year_category(news: DataFrame) -> DataFrame:
    """Quarterly and yearly sums in one scan; yearly rows have quarter NULL."""
    quarterly = impact_by_quarter_category(news).withColumn("year", cal.label_year("quarter"))
    levels = F.explode(F.array(F.col("quarter"), F.lit(None).cast("string")))
    return (
        quarterly.withColumn("_level", levels)
        .groupBy("model", "year", F.col("_level").alias("quarter"), "category")
        .agg(_total())
    )


def yearly_impact(news: DataFrame) -> DataFrame:
    return news.groupBy("model", cal.label_year("quarter").alias("year"), "category").agg(_total())


def mean_abs_year_impact(news: DataFrame, excluded: list[int]) -> DataFrame:
    """Mean over years of the absolute yearly category impact."""
    size = F.abs("impact")
    return yearly_impact(news).groupBy("model", "category").agg(
        F.avg(size).alias("all_years"),
        F.avg(F.when(~F.col("year").isin(excluded), size)).alias("excl_years"),
    )


def category_by_year(news: DataFrame, category: str) -> DataFrame:
    return yearly_impact(news.where(F.col("category") == category))


def _by_series_quarter(news: DataFrame, series: list[str], measure: Column, name: str) -> DataFrame:
    chosen = news.where(F.col("series_id").isin(series))
    table = chosen.groupBy("model", "series_id", cal.label_quarter("quarter").alias("qtr")).agg(
        measure.alias(name)
    )
    return scaffold(table, ["model", "series_id"], "qtr", ["q1", "q2", "q3", "q4"])


def mean_abs_by_series_quarter(news: DataFrame, series: list[str]) -> DataFrame:
    return _by_series_quarter(news, series, F.avg(F.abs("impact")), "mean_abs_impact")


def impact_std_by_series_quarter(news: DataFrame, series: list[str]) -> DataFrame:
    return _by_series_quarter(news, series, F.stddev_samp("impact"), "impact_sd")


def top_series(news: DataFrame, excluded: list[int], k: int = 10) -> DataFrame:
    """The k series with the largest mean absolute impact outside the excluded years.

    Both means come from one aggregate; the ranking keeps k rows per model
    before the shuffle.  Long format with one row per series and group.
    """
    size = F.abs("impact")
    kept = F.when(~cal.label_year("quarter").isin(excluded), size)
    means = news.groupBy("model", "series_id").agg(
        F.avg(kept).alias("excl_years"), F.avg(size).alias("all_years")
    )
    rank = Window.partitionBy("model").orderBy(F.desc_nulls_last("excl_years"), "series_id")
    best = (
        means.where(F.col("excl_years").isNotNull())
        .withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    )
    return best.unpivot(
        ["model", "series_id", "place"], ["excl_years", "all_years"], "sample", "impact"
    )
