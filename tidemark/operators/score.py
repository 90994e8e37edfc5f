"""Scoring of weekly nowcasts and the accuracy tables built from them.

Tables are keyed by (model, quarter, vintage).  Windows run inside one
(model, quarter), a couple of dozen weekly rows; everything else is a hash
aggregate with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal


def by_week() -> WindowSpec:
    return Window.partitionBy("model", "quarter").orderBy("vintage")


ALL_YEARS = "Average (all years)"


def excluding(years: list[int]) -> str:
    return "Average excl. " + ", ".join(str(y) for y in years)


# ---------------------------------------------------------------- filters


def exclude_years(df: DataFrame, years: list[int], quarter: str = "quarter") -> DataFrame:
    return df.where(~cal.label_year(quarter).isin(years))


def year_range(df: DataFrame, first: int, last: int, quarter: str = "quarter") -> DataFrame:
    return df.where(cal.label_year(quarter).between(first, last))


def mask_periods(df: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """Keep every row but blank the given columns where the condition holds."""
    return df.withColumns({c: F.when(~condition, F.col(c)) for c in columns})


# ---------------------------------------------------------------- scoring


def with_actual(nowcast: DataFrame, actuals: DataFrame) -> DataFrame:
    """First official figure beside each nowcast."""
    return nowcast.join(actuals.select("model", "quarter", "actual"), ["model", "quarter"])


def step_variance() -> Column:
    """Population variance of the pair (y_old, y_new)."""
    half = (F.col("y_new") - F.col("y_old")) / 2
    return half * half


def score(nowcast: DataFrame, actuals: DataFrame) -> DataFrame:
    """error = actual - nowcast, with absolute, relative and step figures."""
    error = F.col("actual") - F.col("y_new")
    return with_actual(nowcast, actuals).select(
        "model", "quarter", "vintage", "y_old", "y_new", error.alias("error"),
        F.abs(error).alias("abs_error"), F.try_divide(error, F.col("actual")).alias("perc_error"),
        "impact_revisions", "impact_releases", step_variance().alias("step_variance"), "params_used",
    )


def week_index(nowcast: DataFrame) -> DataFrame:
    return nowcast.withColumn("week", F.row_number().over(by_week()))


def final_rows(nowcast: DataFrame) -> DataFrame:
    """Last vintage of every quarter."""
    rest = [c for c in nowcast.columns if c not in ("model", "quarter", "vintage")]
    last = F.max_by(F.struct("vintage", *rest), "vintage").alias("_last")
    return nowcast.groupBy("model", "quarter").agg(last).select("model", "quarter", "_last.*")


def recover_actual(nowcast: DataFrame) -> DataFrame:
    """The official figure implied by the final nowcast and its error."""
    return final_rows(nowcast).select(
        "model", "quarter", (F.col("y_new") + F.col("error")).alias("actual")
    )


def final_vs_actual(nowcast: DataFrame, gap_years: list[int]) -> DataFrame:
    """Final nowcast and official figure by publication date, blank in the gap years."""
    table = final_rows(nowcast).select(
        "model", "quarter", cal.publication_month_end("quarter").alias("published"),
        F.col("y_new").alias("final_nowcast"), (F.col("y_new") + F.col("error")).alias("actual"),
    )
    gap = cal.label_year("quarter").isin(gap_years)
    return mask_periods(table, ["final_nowcast", "actual"], gap).orderBy("model", "published")


def assign_tracking_dates(nowcast: DataFrame) -> DataFrame:
    """n-th row of a quarter on the n-th charted Friday, regardless of skipped vintages."""
    start = cal.chart_window_start("quarter")
    return week_index(nowcast).withColumn("track_date", F.date_add(start, 7 * (F.col("week") - 1)))


def nowcast_changes(nowcast: DataFrame) -> DataFrame:
    return nowcast.select(
        "model", "quarter", "vintage", (F.col("y_new") - F.col("y_old")).alias("change"),
        step_variance().alias("step_variance"),
    )


def chain_breaks(nowcast: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose y_old differs from the previous row's y_new."""
    linked = nowcast.withColumn("previous_y_new", F.lag("y_new").over(by_week()))
    return linked.where(F.abs(F.col("y_old") - F.col("previous_y_new")) > tolerance)


def error_paths(nowcast: DataFrame) -> DataFrame:
    return week_index(nowcast).select("model", "quarter", "week", "vintage", "error", "abs_error")


# ---------------------------------------------------------------- accuracy tables


def accuracy(nowcast: DataFrame) -> DataFrame:
    e = F.col("error")
    return nowcast.groupBy("model", "quarter").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("abs_error").alias("mae"),
        F.avg(e).alias("bias"), (F.avg("perc_error") * 100).alias("mpe"),
    )


def bias_shares(nowcast: DataFrame) -> DataFrame:
    e = F.col("error")
    return nowcast.groupBy("model", "quarter").agg(
        F.avg(e).alias("mean_error"),
        F.avg((e > 0).cast("double")).alias("share_positive"),
        F.avg((e < 0).cast("double")).alias("share_negative"),
    )


def yearly_with_means(
    df: DataFrame, measures: dict[str, Column], excluded: list[int], inputs: list[str]
) -> DataFrame:
    """Aggregate by year, then add the mean of the yearly figures with and without some years.

    The yearly table feeds its own summary: each yearly row is exploded into
    the groups it belongs to, so the input is scanned once.  ``inputs`` names
    the measures whose mean over years is taken.
    """
    by_year = df.groupBy("model", cal.label_year("quarter").alias("year")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    year = F.col("year")
    groups = F.array_compact(
        F.array(
            year.cast("string"), F.lit(ALL_YEARS),
            F.when(~year.isin(excluded), F.lit(excluding(excluded))),
        )
    )
    return by_year.select("*", F.explode(groups).alias("label")).groupBy("model", "label").agg(
        *[F.avg(n).alias(n) for n in inputs]
    )


def accuracy_by_year(metrics: DataFrame, excluded: list[int]) -> DataFrame:
    """Yearly means of the quarterly metrics and the means of those yearly means."""
    names = ["rmse", "mae", "bias"]
    return yearly_with_means(metrics, {n: F.avg(n) for n in names}, excluded, names)


def volatility_by_year(nowcast: DataFrame, excluded: list[int]) -> DataFrame:
    """Mean final step variance by year."""
    measure = {"final_variance": F.avg("step_variance")}
    return yearly_with_means(final_rows(nowcast), measure, excluded, ["final_variance"])


def release_revision_share(nowcast: DataFrame, excluded: list[int]) -> DataFrame:
    """Signed sums of both impacts by year and the share of releases in them."""
    rel, rev = F.sum("impact_releases"), F.sum("impact_revisions")
    share = F.try_divide(rel, rel + rev)
    measures = {"releases_share": share, "revisions_share": 1 - share}
    return yearly_with_means(nowcast, measures, excluded, list(measures))


def release_revision_sums(nowcast: DataFrame) -> DataFrame:
    return nowcast.groupBy("model", "quarter").agg(
        F.sum("impact_releases").alias("releases"), F.sum("impact_revisions").alias("revisions")
    )


def final_error_by_year(nowcast: DataFrame) -> DataFrame:
    return final_rows(nowcast).groupBy("model", cal.label_year("quarter").alias("year")).agg(
        F.avg("abs_error").alias("final_abs_error")
    )


def final_error_by_quarter_of_year(nowcast: DataFrame, excluded: list[int]) -> DataFrame:
    kept = F.when(~cal.label_year("quarter").isin(excluded), F.col("abs_error"))
    return final_rows(nowcast).groupBy("model", cal.label_quarter("quarter").alias("qtr")).agg(
        F.avg("abs_error").alias("all_years"), F.avg(kept).alias("excl_years")
    )


def rolling_mean(yearly: DataFrame, value: str, n: int = 2) -> DataFrame:
    """Trailing mean over the last n years, shorter at the start."""
    last = Window.partitionBy("model").orderBy("year").rowsBetween(1 - n, 0)
    return yearly.withColumn("moving_average", F.avg(value).over(last))


# ---------------------------------------------------------------- availability


def inner_available(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rows of the quarters for which both tables exist."""
    return results.join(metrics.select("model", "quarter").distinct(), ["model", "quarter"], "left_semi")
