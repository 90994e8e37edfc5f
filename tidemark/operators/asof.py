"""Bitemporal operators: schedules, data as known on a date, pairing of vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal

FACT = ["model", "series_id", "period"]
PAIR = ["model", "quarter", "vintage_old", "vintage"]


# ---------------------------------------------------------------- schedules


def tracking_schedule(quarters: DataFrame, weeks: int = 22) -> DataFrame:
    """Weekly vintages per target quarter.

    The last ``weeks`` Fridays up to the last one of the month in which the
    first official figure appears, so tracking starts about four weeks before
    the quarter.  Irregular schedules are read as a table instead.
    """
    end = cal.chart_window_end("quarter")
    fridays = F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 7 days"))
    return quarters.select("*", F.explode(fridays).alias("vintage"))


def chart_windows(quarters: DataFrame) -> DataFrame:
    """First and last charted Friday and publication month end of each quarter."""
    return quarters.select(
        "quarter",
        cal.chart_window_start("quarter").alias("window_start"),
        cal.chart_window_end("quarter").alias("window_end"),
        cal.publication_month_end("quarter").alias("published"),
    )


def vintage_pairs(schedule: DataFrame, available: DataFrame) -> DataFrame:
    """Consecutive vintages of one quarter's schedule when both exist.

    ``available`` lists (model, vintage).  A missing vintage breaks both pairs
    it belongs to; the neighbours are not paired across the hole.
    """
    week = Window.partitionBy("quarter").orderBy("vintage")
    pairs = schedule.select(
        "quarter", F.lag("vintage").over(week).alias("vintage_old"), "vintage"
    ).where(F.col("vintage_old").isNotNull())
    have = available.select("model", "vintage").distinct()
    both = pairs.join(have, "vintage").join(
        have.withColumnRenamed("vintage", "vintage_old"), ["model", "vintage_old"]
    )
    return both.select(*PAIR)


def pair_vintages(
    schedule: DataFrame, obs: DataFrame, available: DataFrame | None = None
) -> DataFrame:
    """Old and new value of every cell for every pair of consecutive vintages.

    A short table of links says in which pairs a vintage is the new and in
    which the old side, so the observations are read once; both sides meet in
    one aggregation, which also pads the shorter vintage with NULL.  Quarters
    sharing a pair are attached afterwards.  ``available`` lists the vintages
    that exist when that is known without scanning ``obs``.  The result holds
    every unchanged cell too; ``changed_cells`` gives the others without it.
    """
    pairs = vintage_pairs(schedule, obs if available is None else available)
    steps = pairs.select("model", "vintage_old", F.col("vintage").alias("vintage_new")).distinct()
    links = steps.withColumn(
        "_link",
        F.explode(
            F.array(
                F.struct(F.col("vintage_old").alias("vintage"), F.lit(False).alias("is_new")),
                F.struct(F.col("vintage_new").alias("vintage"), F.lit(True).alias("is_new")),
            )
        ),
    ).select("model", "vintage_old", "vintage_new", "_link.*")
    cells = obs.join(links, ["model", "vintage"]).groupBy(
        "model", "vintage_old", "vintage_new", "series_id", "period"
    ).agg(
        F.max(F.when(~F.col("is_new"), F.col("value"))).alias("old"),
        F.max(F.when(F.col("is_new"), F.col("value"))).alias("new"),
    )
    named = cells.withColumnRenamed("vintage_new", "vintage")
    return named.join(pairs, ["model", "vintage_old", "vintage"]).select(
        *PAIR, "series_id", "period", "old", "new"
    )


def changed_cells(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells whose value differs between the two vintages of a pair, from the releases alone.

    ``pairs`` comes from ``vintage_pairs``.  A release changes a cell in the
    pair whose days it falls into; of several between two vintages the last
    counts, and the old value is the one before the first of them.  So the
    work is one row per release and not one per cell and vintage.  A step that
    several quarters share is resolved once.
    """
    once = facts.groupBy(*FACT, "release_date").agg(F.max("value").alias("value"))
    release = Window.partitionBy(*FACT).orderBy("release_date")
    versions = once.withColumn("before", F.lag("value").over(release))
    steps = pairs.select("model", "vintage_old", "vintage").distinct()
    days = steps.withColumn(
        "release_date",
        F.explode(F.sequence(F.date_add("vintage_old", 1), F.col("vintage"), F.expr("interval 1 day"))),
    )
    cells = versions.join(days, ["model", "release_date"]).groupBy(
        "model", "vintage_old", "vintage", "series_id", "period"
    ).agg(
        F.min_by("before", "release_date").alias("old"), F.max_by("value", "release_date").alias("new")
    )
    moved = cells.where(~F.col("old").eqNullSafe(F.col("new")))
    return moved.join(pairs, ["model", "vintage_old", "vintage"]).select(
        *PAIR, "series_id", "period", "old", "new"
    )


def level_at(changes: DataFrame, vintages: DataFrame, amounts: list[str]) -> DataFrame:
    """Running totals of daily changes on every vintage.

    ``changes`` has model, day and the amounts, a few rows a day; ``vintages``
    (model, vintage).  A vintage before the first change has zeros.
    """
    asked = vintages.select("model", F.col("vintage").alias("day")).distinct()
    asked = asked.select("*", *[F.lit(None).cast("double").alias(a) for a in amounts], F.lit(True).alias("_ask"))
    daily = changes.groupBy("model", "day").agg(*[F.sum(F.col(a).cast("double")).alias(a) for a in amounts])
    upto = Window.partitionBy("model").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    both = daily.withColumn("_ask", F.lit(False)).unionByName(asked)
    totals = both.withColumns({a: F.coalesce(F.sum(a).over(upto), F.lit(0.0)) for a in amounts})
    return totals.where("_ask").select("model", F.col("day").alias("vintage"), *amounts)


def known_cells(facts: DataFrame, vintages: DataFrame) -> DataFrame:
    """Number of cells with a value on every vintage: (model, vintage, cells)."""
    once = facts.groupBy(*FACT, "release_date").agg(F.max("value").alias("value"))
    release = Window.partitionBy(*FACT).orderBy("release_date")
    had = F.coalesce(F.lag("value").over(release).isNotNull(), F.lit(False))
    step = F.col("value").isNotNull().cast("int") - had.cast("int")
    changes = once.withColumn("cells", step).where("cells <> 0")
    daily = changes.groupBy("model", F.col("release_date").alias("day")).agg(F.sum("cells").alias("cells"))
    return level_at(daily, vintages, ["cells"]).withColumn("cells", F.col("cells").cast("bigint"))


def select_params(schedule: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Parameter set of every scheduled vintage.

    Before the target quarter starts the previous quarter's estimates apply,
    afterwards the quarter's own, also once the next quarter has begun.
    ``catalogue`` maps param_quarter, or (model, param_quarter), to est_vintage.
    Every scheduled row is kept: one whose quarter has no estimates has a NULL
    est_vintage and says so in ``missing``.
    """
    early = F.col("vintage") < cal.quarter_start("quarter")
    chosen = schedule.withColumn(
        "params_used", F.when(early, "prev").otherwise("curr")
    ).withColumn(
        "param_quarter", F.when(early, cal.previous_quarter("quarter")).otherwise(F.col("quarter"))
    )
    both = "model" in schedule.columns and "model" in catalogue.columns
    keys = ["model", "param_quarter"] if both else ["param_quarter"]
    reason = F.concat(F.lit("no parameters for "), F.col("param_quarter"))
    return chosen.join(catalogue, keys, "left").withColumn(
        "missing", F.when(F.col("est_vintage").isNull(), reason)
    )


# ---------------------------------------------------------------- as-of values


def fact_versions(facts: DataFrame, horizon: Column) -> DataFrame:
    """Validity interval [release_date, valid_to] of every released value."""
    once = facts.groupBy(*FACT, "release_date").agg(F.max("value").alias("value"))
    release = Window.partitionBy(*FACT).orderBy("release_date")
    until = F.coalesce(F.date_sub(F.lead("release_date").over(release), 1), horizon)
    return once.withColumn("valid_to", until)


def value_as_of(facts: DataFrame, vintages: DataFrame) -> DataFrame:
    """The panel as it was known on every vintage date.

    The vintages are numbered.  Each release date is mapped to the first
    vintage that knows it, so a version is current from its own number up to
    the one before the next version's, and an explode over that range of
    numbers gives exactly the rows of the result.
    """
    dates = vintages.select("vintage").distinct()
    numbered = dates.withColumn("_n", F.row_number().over(Window.orderBy("vintage")))
    # One row per day on which anything was released or a vintage was taken.
    days = facts.select(F.col("release_date").alias("day")).distinct().withColumn(
        "_n", F.lit(None).cast("int")
    ).unionByName(numbered.select(F.col("vintage").alias("day"), "_n")).groupBy("day").agg(F.max("_n").alias("_n"))
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = days.select(
        F.col("day").alias("release_date"), F.min("_n").over(ahead).alias("_since"), F.max("_n").over(whole).alias("_last")
    )
    once = facts.groupBy(*FACT, "release_date").agg(F.max("value").alias("value"))
    release = Window.partitionBy(*FACT).orderBy("release_date")
    versions = once.join(first, "release_date").withColumn(
        "_until", F.coalesce(F.lead("_since").over(release), F.col("_last") + 1) - 1
    )
    current = versions.where(F.col("_since") <= F.col("_until"))
    spread = current.withColumn("_n", F.explode(F.sequence("_since", "_until")))
    return spread.join(numbered, "_n").select("model", "vintage", "series_id", "period", "value")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    columns: list[str],
    bucket: str = "MM",
) -> DataFrame:
    """Last ``right`` row at or before each ``left`` row of the same key; unmatched rows keep NULL.

    A key may be hot, so only distinct (key, time) pairs, combined on the map
    side, enter ordered windows, and those run on (key, time bucket).  What a
    bucket needs from earlier ones is the last right row before it, carried by
    a second window over one summary row per bucket.  Of several right rows at
    the same time the largest by ``columns`` counts.
    """
    keys = list(on)
    side = F.struct(*[F.col(c) for c in columns])
    known = right.groupBy(*keys, F.col(right_ts).alias("_ts")).agg(F.max(side).alias("_right"))
    asked = left.select(*keys, F.col(left_ts).alias("_ts")).distinct()
    times = known.withColumn("_ask", F.lit(False)).unionByName(
        asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True
    ).groupBy(*keys, "_ts").agg(F.max("_right").alias("_right"), F.max("_ask").alias("_ask"))
    times = times.withColumn("_bucket", F.date_trunc(bucket, "_ts"))
    tails = times.groupBy(*keys, "_bucket").agg(
        F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_ts"))).alias("_tail")
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_bucket", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_ts").rowsBetween(Window.unboundedPreceding, 0)
    seen = times.withColumn("_seen", F.last("_right", ignorenulls=True).over(within)).where("_ask")
    answers = seen.join(carried, [*keys, "_bucket"]).select(
        *keys, F.col("_ts").alias(left_ts), F.coalesce("_seen", "_carry").alias("_best")
    )
    return left.join(answers, [*keys, left_ts], "left").select(
        *[left[c] for c in left.columns], *[F.col("_best")[c].alias(c) for c in columns]
    )


def backfill(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Keep base values, fill their holes from ``extra``; only base dates survive.

    A series that base lacks altogether is created on all base dates, as is a
    date that a base series lacks.
    """
    keys = ["model", "vintage", "series_id", "period"]
    dates = base.groupBy("model", "vintage").agg(F.sort_array(F.collect_set("period")).alias("_dates"))
    marked = base.select(*keys, F.col("value").alias("_base"), F.lit(None).cast("double").alias("_extra"))
    fetched = extra.select(*keys, F.lit(None).cast("double").alias("_base"), F.col("value").alias("_extra"))
    # One row per series carries the calendar of its panel; cells off the calendar drop out.
    cells = marked.unionByName(fetched).groupBy(*keys).agg(F.max("_base").alias("_base"), F.max("_extra").alias("_extra"))
    series = cells.groupBy("model", "vintage", "series_id").agg(F.count(F.lit(1)).alias("_n")).join(dates, ["model", "vintage"])
    grid = series.select("model", "vintage", "series_id", F.explode("_dates").alias("period"))
    return grid.join(cells, keys, "left").select(*keys, F.coalesce("_base", "_extra").alias("value"))
