"""What changed between two vintages and what it does to the nowcast.

Inputs are the cell pairs of ``pair_vintages``, or only those that differ from
``changed_cells``: model, quarter, vintage_old, vintage, series_id, period, old, new.  News is keyed by series and period, so
several periods of one series released in the same week all count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import PAIR


def vintage_diff(pairs: DataFrame) -> DataFrame:
    """Label each cell released, revised, unchanged, withdrawn or absent."""
    old, new = F.col("old"), F.col("new")
    return pairs.withColumn(
        "status",
        F.when(old.isNull() & new.isNull(), "absent")
        .when(old.isNull(), "released")
        .when(new.isNull(), "withdrawn")
        .when(old == new, "unchanged")
        .otherwise("revised"),
    )


def revised_view(pairs: DataFrame) -> DataFrame:
    """New values restricted to the cells that the old vintage already had."""
    return pairs.withColumn("revised", F.when(F.col("old").isNotNull(), F.col("new")))


def released_cells(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("old").isNull() & F.col("new").isNotNull())


def released_series(pairs: DataFrame) -> DataFrame:
    """Per series of a pair, whether anything was released."""
    hit = F.col("old").isNull() & F.col("new").isNotNull()
    return pairs.groupBy(*PAIR, "series_id").agg(F.bool_or(hit).alias("released"))


def series_released(pairs: DataFrame, first_known: DataFrame, changes: DataFrame) -> DataFrame:
    """Like ``released_series``, from the releases: per known series of a pair, whether anything was released.

    ``pairs`` are those of ``vintage_pairs``; ``first_known`` (model, series_id, since) says since when a series has
    values, ``changes`` are the changed cells.
    """
    known = pairs.join(first_known, "model").where(F.col("since") <= F.col("vintage")).select(*PAIR, "series_id")
    hit = released_cells(changes).select(*PAIR, "series_id").distinct().withColumn("released", F.lit(True))
    return known.join(hit, [*PAIR, "series_id"], "left").withColumn("released", F.coalesce("released", F.lit(False)))


def status_counts(changes: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells by status for every pair, without listing the unchanged ones.

    ``known`` (model, vintage, cells) counts the cells with a value on a vintage; those of the old vintage that were
    neither revised nor withdrawn are unchanged.  A status without cells has no row.
    """
    moved = vintage_diff(changes).groupBy(*PAIR, "status").agg(F.count(F.lit(1)).alias("cells"))
    start = pairs.join(known.withColumnRenamed("vintage", "vintage_old"), ["model", "vintage_old"])
    lost = moved.where(F.col("status") != "released").select(*PAIR, F.lit("unchanged").alias("status"), (-F.col("cells")).alias("cells"))
    stay = start.select(*PAIR, F.lit("unchanged").alias("status"), "cells").unionByName(lost)
    stay = stay.groupBy(*PAIR, "status").agg(F.sum("cells").alias("cells"))
    return moved.unionByName(stay).where("cells > 0")


def revised_cells(pairs: DataFrame) -> DataFrame:
    """Cells known in both vintages whose value changed."""
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    return pairs.where(both & (F.col("old") != F.col("new")))


def news(diff: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Actual minus forecast for every released cell.

    ``forecasts`` has model, quarter, vintage, series_id, period, forecast.
    """
    keys = ["model", "quarter", "vintage", "series_id", "period"]
    actual = released_cells(diff).select(*keys, F.col("new").alias("actual"))
    return actual.join(forecasts.select(*keys, "forecast"), keys, "left").withColumn(
        "news", F.col("actual") - F.col("forecast")
    )


def release_impacts(news_rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Impact = weight x news; ``keys`` names what a weight depends on."""
    return news_rows.join(weights.select(*keys, "weight"), keys, "left").withColumn(
        "impact", F.col("weight") * F.col("news")
    )


def revision_impact(evaluations: DataFrame) -> DataFrame:
    """Nowcast change from re-reading old cells with revised values.

    ``evaluations`` has one row per pair with y_old, y_rev and y_new.
    """
    return evaluations.withColumn("impact_revisions", F.col("y_rev") - F.col("y_old"))


def total_impact(news_rows: DataFrame) -> DataFrame:
    """Sum of release impacts per target and vintage; nothing released gives 0."""
    return news_rows.groupBy("model", "quarter", "vintage").agg(
        F.coalesce(F.sum("impact"), F.lit(0.0)).alias("impact_releases")
    )


def check_decomposition(nowcast: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per target, how many updates were checked and in how many y_old + revisions + releases misses y_new."""
    gap = F.col("y_new") - F.col("y_old") - F.col("impact_revisions") - F.col("impact_releases")
    missed = gap.isNull() | (F.abs(gap) > tolerance)
    return nowcast.groupBy("model", "quarter").agg(F.count(F.lit(1)).alias("checked"), F.count_if(missed).alias("gaps"))


def update_report(nowcast: DataFrame, news_rows: DataFrame) -> DataFrame:
    """Header figures of each update beside the detail of the series released in it."""
    head = nowcast.select(
        "model", "quarter", "vintage", "y_old", "impact_revisions", "impact_releases",
        (F.col("impact_revisions") + F.col("impact_releases")).alias("total_impact"), "y_new",
    )
    detail = news_rows.where(F.col("actual").isNotNull()).select(
        "model", "quarter", "vintage", "series_id", "period",
        "forecast", "actual", "weight", "impact",
    )
    return head.join(detail, ["model", "quarter", "vintage"], "left")
