"""Panel preparation: selection, calendar alignment, transformation, gap filling, scaling.

Everything up to the cubic spline is one family of windows over
(model, vintage, series_id).  Spark shuffles once on that key and reuses the
partitioning through the whole chain; a group is one series, so its size is
the number of months in the calendar, not the number of source rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.labels import transformed_unit
from tidemark.operators import spline
from tidemark.schema import CELL, PANEL, SERIES


def by_series() -> WindowSpec:
    return Window.partitionBy(*SERIES)


def by_period() -> WindowSpec:
    return by_series().orderBy("period")


# ---------------------------------------------------------------- selection


def keep_spec_series(obs: DataFrame, spec: DataFrame) -> DataFrame:
    """Drop series that the model's spec does not list and carry their order."""
    return obs.join(spec.select("model", "series_id", "spec_pos"), ["model", "series_id"])


def with_spec(obs: DataFrame, spec: DataFrame) -> DataFrame:
    """Attach transformation and frequency to every observation."""
    return obs.join(
        spec.select("model", "series_id", "frequency", "transformation"), ["model", "series_id"]
    )


def sample_from(obs: DataFrame, start: str) -> DataFrame:
    return obs.where(F.col("period") >= F.lit(start).cast("date"))


def data_window(obs: DataFrame, start: str, end: str | Column = "vintage") -> DataFrame:
    """Keep periods in [start, end]; ``end`` is a column name or expression."""
    return obs.where(F.col("period").between(F.lit(start).cast("date"), cal._col(end)))


# ---------------------------------------------------------------- calendar


def to_monthly_last(raw: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Last non-null value of each month."""
    known = raw.where(F.col(value).isNotNull())
    return known.groupBy(*keys, cal.month_start(date).alias("period")).agg(
        F.max_by(value, F.struct(date, value)).alias(value)
    )


def quarter_to_third_month(raw: DataFrame, date: str = "period") -> DataFrame:
    return raw.withColumn(date, cal.quarter_third_month(date))


def dense_monthly(obs: DataFrame, horizon: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """Give every series one row per month of its panel, plus ``horizon`` empty months.

    ``edges`` (model, vintage, first, last) gives the span of each panel where it is known;
    else it is taken from ``obs``, which is then read twice.  Each observation opens a run of months that ends before the next one, so
    the missing months come out of an explode on the series' own partition and
    no scaffold has to be joined.
    """
    if edges is None:
        edges = obs.groupBy(*PANEL).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    edges = edges.select(*PANEL, F.col("first").alias("_lo"), F.add_months("last", horizon).alias("_hi"))
    attrs = [c for c in obs.columns if c not in CELL + ["value"]]
    keyed = obs.join(edges, PANEL)
    first = F.row_number().over(by_period()) == 1
    until = F.coalesce(
        F.add_months(F.lead("period").over(by_period()), -1), F.greatest("_hi", "period")
    )
    runs = keyed.select(
        *SERIES, *attrs, "period", "value",
        F.when(first, F.col("_lo")).otherwise(F.col("period")).alias("_from"),
        until.alias("_to"),
    )
    months = F.explode(F.sequence("_from", "_to", F.expr("interval 1 month")))
    grid = runs.withColumn("_month", months)
    return grid.select(
        *SERIES, *attrs, F.col("_month").alias("period"),
        F.when(F.col("_month") == F.col("period"), F.col("value")).alias("value"),
    )


def extend_horizon(obs: DataFrame, months: int = 12) -> DataFrame:
    """Dense grid with ``months`` empty rows after the panel's last month."""
    return dense_monthly(obs, horizon=months)


# ---------------------------------------------------------------- transformation


def transform_series(dense: DataFrame, out: str = "x") -> DataFrame:
    """Apply each series' transformation on a dense monthly grid.

    Needs columns ``frequency`` and ``transformation``.  Quarterly series step
    three months and exist only on the last month of a quarter.
    """
    v = F.col("value")
    code, freq = F.col("transformation"), F.col("frequency")
    step = F.when(freq == "q", F.lit(3)).otherwise(F.lit(1))
    back1, back3, back12 = (F.lag("value", k).over(by_period()) for k in (1, 3, 12))
    prev = F.when(step == 1, back1).otherwise(back3)
    on_grid = (freq == "m") | (F.month("period") % 3 == 0)
    ratio, yearly = F.try_divide(v, prev), F.try_divide(v, back12)
    growth = 100 * (F.log(v) - F.log(prev))
    x = (
        F.when(
            ~freq.isin("m", "q"),
            F.raise_error(F.concat(F.lit("unsupported frequency: "), freq)).cast("double"),
        )
        .when(code == "lin", v)
        .when(code == "log", F.log(v))
        .when(code == "chg", F.when(on_grid, v - prev))
        .when(code == "ch1", F.when(on_grid, v - back12))
        .when(code == "pch", F.when(on_grid, 100 * (ratio - 1)))
        .when(code == "pc1", F.when(on_grid, 100 * (yearly - 1)))
        .when(code == "pca", F.when(on_grid, 100 * (F.pow(ratio, 12 / step) - 1)))
        .when(code == "cch", F.when(on_grid, growth))
        .when(code == "cca", F.when(on_grid, growth * 12 / step))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown transformation: "), code)).cast("double")
        )
    )
    return dense.withColumn(out, x)


def drop_initial(dense: DataFrame, months: int = 3) -> DataFrame:
    """Drop the first rows of a dense grid, where changes are undefined."""
    return (
        dense.withColumn("_n", F.row_number().over(by_period())).where(F.col("_n") > months).drop("_n")
    )


# ---------------------------------------------------------------- scaling


def standardise(obs: DataFrame, value: str = "value", out: str = "z") -> DataFrame:
    """(x - mean) / sd by series, with ``mx`` and ``wx`` kept beside it."""
    return (
        obs.withColumn("mx", F.avg(value).over(by_series()))
        .withColumn("wx", F.stddev_samp(value).over(by_series()))
        .withColumn(out, F.try_divide(F.col(value) - F.col("mx"), F.col("wx")))
    )


def scale_stats(obs: DataFrame, value: str = "value") -> DataFrame:
    return obs.groupBy(*SERIES).agg(
        F.avg(value).alias("mx"), F.stddev_samp(value).alias("wx")
    )


def destandardise(df: DataFrame, stats: DataFrame, value: str = "z", out: str = "x") -> DataFrame:
    """Back to units with the stored mean and standard deviation."""
    scaled = df.drop("mx", "wx").join(stats.select(*SERIES, "mx", "wx"), SERIES)
    return scaled.withColumn(out, F.col("wx") * F.col(value) + F.col("mx"))


# ---------------------------------------------------------------- gaps


def trim_edges(dense: DataFrame, share: float = 0.8, value: str = "value") -> DataFrame:
    """Drop leading and trailing months in which too many series are missing.

    A month is removable when its missing share is above ``share``; with
    ``share=1`` only when nothing is observed.
    """
    months = dense.groupBy(*PANEL, "period").agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_seen")
    )
    missing = F.col("_n") - F.col("_seen")
    removable = missing == F.col("_n") if share >= 1 else missing > F.col("_n") * F.lit(share)
    kept = F.when(~removable, F.col("period"))
    edges = months.groupBy(*PANEL).agg(F.min(kept).alias("_lo"), F.max(kept).alias("_hi"))
    inside = dense.join(edges, PANEL).where(F.col("period").between(F.col("_lo"), F.col("_hi")))
    return inside.drop("_lo", "_hi")


def interpolate_linear(dense: DataFrame, value: str = "value") -> DataFrame:
    """Straight line between neighbouring observations; ends stay NULL."""
    seen = F.when(F.col(value).isNotNull(), F.struct(cal.month_index("period").alias("t"), value))
    before = F.last(seen, ignorenulls=True).over(by_period().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(by_period().rowsBetween(0, Window.unboundedFollowing))
    t = cal.month_index("period")
    a, b = F.col("_a"), F.col("_b")
    slope = (b[value] - a[value]) / (b["t"] - a["t"])
    line = F.when(a["t"] == b["t"], a[value]).when(
        a.isNotNull() & b.isNotNull(), a[value] + slope * (t - a["t"])
    )
    return (
        dense.withColumn("_a", before).withColumn("_b", after).withColumn(value, line).drop("_a", "_b")
    )


def interpolate_cubic(dense: DataFrame, value: str = "value") -> DataFrame:
    """Not-a-knot cubic spline between a series' first and last observation.

    The knots' second derivatives come from one forward and one backward sweep over a series' knots; each
    hole then takes those of its two neighbours by position.
    """
    t = cal.month_index("period").cast("double")
    knot = F.struct(t.alias("t"), F.col(value).cast("double").alias("y"))
    knots = dense.where(F.col(value).isNotNull()).groupBy(*SERIES).agg(F.sort_array(F.collect_list(knot)).alias("_knots"))
    bends = knots.select(*SERIES, spline.curvatures(F.col("_knots")).alias("_bends"))
    seen = F.when(F.col(value).isNotNull(), knot)
    upto, beyond = by_period().rowsBetween(Window.unboundedPreceding, 0), by_period().rowsBetween(0, Window.unboundedFollowing)
    led = dense.join(bends, SERIES, "left").withColumns(
        {"_a": F.last(seen, ignorenulls=True).over(upto), "_b": F.first(seen, ignorenulls=True).over(beyond), "_k": F.count(value).over(upto)}
    )
    k = F.col("_k").cast("int")
    filled = spline.between(t, F.col("_a"), F.col("_b"), F.get("_bends", k - 1), F.get("_bends", k))
    return led.withColumn(value, F.coalesce(F.col(value), filled)).select(*dense.columns)


def fill_median(dense: DataFrame, value: str = "value") -> DataFrame:
    """Replace what is still missing with the series' median."""
    return dense.withColumn(value, F.coalesce(value, F.median(value).over(by_series())))


def smooth_filled(
    dense: DataFrame, filled: str = "filled", value: str = "value", k: int = 3
) -> DataFrame:
    """Replace filled cells by the centred moving average of width 2k+1.

    Beyond either end the series is continued with its first or last value.
    """
    whole = by_period().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = by_period().rowsBetween(-k, k)
    pos, n = F.row_number().over(by_period()), F.count(F.lit(1)).over(by_series())
    head, tail = F.first(value).over(whole), F.last(value).over(whole)
    left, right = F.greatest(F.lit(0), k + 1 - pos), F.greatest(F.lit(0), k - (n - pos))
    mean = (F.sum(value).over(near) + left * head + right * tail) / (2 * k + 1)
    return dense.withColumn("_ma", mean).withColumn(
        value, F.when(F.col(filled), F.col("_ma")).otherwise(F.col(value))
    ).drop("_ma")


def fill_missing(
    dense: DataFrame, method: int = 2, k: int = 3, interpolation: str = "linear"
) -> DataFrame:
    """The five treatments of missing cells; ``was_missing`` marks the originals.

    1 median and smoothing; 2 trim at 80 %, interpolate, median, smoothing;
    3 trim empty edges only; 4 trim empty edges, then as 2; 5 as 2 untrimmed.
    """
    if method not in (1, 2, 3, 4, 5):
        raise ValueError(f"unknown method {method}")
    df = dense
    if method in (2, 3, 4):
        df = trim_edges(df, 0.8 if method == 2 else 1.0)
    df = df.withColumn("was_missing", F.col("value").isNull())
    if method == 3:
        return df
    if method != 1:
        df = interpolate_cubic(df) if interpolation == "cubic" else interpolate_linear(df)
    df = df.withColumn("_hole", F.col("value").isNull())
    return smooth_filled(fill_median(df), "_hole", k=k).drop("_hole")


# ---------------------------------------------------------------- summaries


def observation_range(obs: DataFrame, value: str = "value") -> DataFrame:
    seen = F.when(F.col(value).isNotNull(), F.col("period"))
    return obs.groupBy(*SERIES).agg(
        F.min(seen).alias("first_period"), F.max(seen).alias("last_period")
    )


def extreme_dates(obs: DataFrame, value: str = "value") -> DataFrame:
    """Months of the smallest and the largest value, the earliest on ties."""
    known = obs.where(F.col(value).isNotNull())
    return known.groupBy(*SERIES).agg(
        F.min_by("period", F.struct(value, "period")).alias("min_period"),
        F.max_by("period", F.struct(F.col(value), -F.unix_date("period"))).alias("max_period"),
    )


def summarise_series(obs: DataFrame, spec: DataFrame, value: str = "value") -> DataFrame:
    """One row per series: count, range, unit, moments and the dates of the extremes."""
    v = F.col(value)
    seen = F.when(v.isNotNull(), F.col("period"))
    stats = obs.groupBy(*SERIES).agg(
        F.count(v).alias("observations"),
        F.min(seen).alias("first_period"), F.max(seen).alias("last_period"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min_value"),
        F.min_by(seen, F.when(v.isNotNull(), F.struct(v, "period"))).alias("min_period"),
        F.max_by(seen, F.when(v.isNotNull(), F.struct(v, -F.unix_date("period")))).alias("max_period"),
    )
    labels = spec.select(
        "model", "series_id", "frequency", "spec_pos", transformed_unit().alias("unit")
    )
    return stats.join(labels, ["model", "series_id"])


def panel_header(obs: DataFrame) -> DataFrame:
    """Size and span of each panel."""
    return obs.groupBy(*PANEL).agg(
        F.countDistinct("series_id").alias("n_series"),
        F.countDistinct("period").alias("n_periods"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )


def obs_wide(obs: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Period by series matrix with the columns in the given order; a cell with two rows is an error."""
    once = F.when(F.count(value) <= 1, F.max(value)).otherwise(
        F.raise_error(F.lit("more than one value for a series and period")).cast("double")
    )
    return obs.groupBy(*PANEL, "period").pivot("series_id", series).agg(once)
