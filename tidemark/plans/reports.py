"""The three report views as tables built from one nowcast and one news table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import impact, score
from tidemark.sources.files import with_vintage_ordinal


def quarter_report(nowcast: DataFrame, news: DataFrame, mapping: DataFrame, quarter: str) -> dict[str, DataFrame]:
    """Everything shown for one target quarter."""
    rows = nowcast.where(F.col("quarter") == quarter)
    items = with_vintage_ordinal(
        impact.with_category(news.where(F.col("quarter") == quarter), mapping)
    )
    return {
        "path": score.week_index(rows),
        "accuracy": score.accuracy(rows),
        "bias": score.bias_shares(rows),
        "official": score.recover_actual(rows),
        "impact_by_series": impact.impact_by_series(items),
        "impact_by_vintage_category": impact.impact_by_vintage_category(items),
    }


def year_report(nowcast: DataFrame, news: DataFrame, mapping: DataFrame, year: int) -> dict[str, DataFrame]:
    """Everything shown for one year."""
    rows = score.year_range(nowcast, year, year)
    items = impact.with_category(score.year_range(news, year, year), mapping)
    return {
        "paths": score.assign_tracking_dates(rows),
        "metrics": score.accuracy(rows),
        "final_errors": score.final_rows(rows).select("model", "quarter", "error", "abs_error"),
        "impact_by_quarter_category": impact.impact_by_quarter_category(items),
    }


def history_report(
    nowcast: DataFrame, news: DataFrame, mapping: DataFrame, excluded: list[int], top: int = 10
) -> dict[str, DataFrame]:
    """Everything shown for all years."""
    items = impact.with_category(news, mapping)
    yearly_error = score.final_error_by_year(nowcast)
    return {
        "accuracy": score.accuracy_by_year(score.accuracy(nowcast), excluded),
        "volatility": score.volatility_by_year(nowcast, excluded),
        "release_share": score.release_revision_share(nowcast, excluded),
        "final_error": score.rolling_mean(yearly_error, "final_abs_error"),
        "final_error_by_quarter": score.final_error_by_quarter_of_year(nowcast, excluded),
        "final_vs_actual": score.final_vs_actual(nowcast, excluded),
        "impact_by_year": impact.impact_by_year_category(items),
        "mean_impact": impact.mean_abs_year_impact(items, excluded),
        "top_series": impact.top_series(news, excluded, top),
    }
