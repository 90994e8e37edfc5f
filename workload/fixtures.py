"""Spark side of the test panels, derived from the driver's tables.

Every table is read whole, and the two large ones once: order cells and fact
events are aggregated to calendar x series and stored in the shared folder at
the start of a query, and all its branches read them there.  Orders meet their customer first and lines their
order once; both are joins to a unique key, where adaptive execution splits a
hot customer or order over several tasks, and the aggregate behind them
combines on the map side.  Money is summed as whole units of 0.01 or 0.0001,
which is exact and stays in primitive arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import asof, factor, news as news_ops, panel, score
from tidemark.sources.files import parse_spec
from tidemark.storage import materialise
from workload.scope import shared

EXCLUDED_YEAR = 2000
EXTENDED_ONLY = ["NATION_3", "NATION_8", "NATION_15"]


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Columns read from each table; stating them spares a schema-inference job per read.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def raw_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide spec sheet: one row per nation in use, one per region not in use."""
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("n_nationkey")
    codes = F.array(*[F.lit(c) for c in ["lin", "chg", "ch1", "pch", "pc1", "pca", "cch", "cca", "log"]])
    units = F.array(F.lit("Index"), F.lit("% rate"), F.lit("USD"))
    names = REGIONS
    used = nations.select(
        key.alias("Position"), F.lit(1).alias("Model"), F.col("n_name").alias("Series ID"),
        F.concat(F.lit("Orders of "), "n_name").alias("SeriesName"),
        F.when(key % 6 == 0, "q").otherwise("m").alias("Frequency"),
        F.element_at(units, (key % 3 + 1).cast("int")).alias("Units"),
        F.element_at(codes, (key % 9 + 1).cast("int")).alias("Transformation"),
        F.col("r_name").alias("Category"),
        F.lit(1).alias("Block1-Global"),
        *[F.when(F.col("r_name") == r, 1).alias(f"Block{i + 2}-{r}") for i, r in enumerate(names)],
    )
    unused = regions.select(
        (F.col("r_regionkey") + 100).alias("Position"), F.lit(0).alias("Model"),
        F.col("r_name").alias("Series ID"), F.col("r_name").alias("SeriesName"),
        F.lit("m").alias("Frequency"), F.lit("USD").alias("Units"),
        F.lit("lin").alias("Transformation"), F.lit("Region").alias("Category"),
        F.lit(1).alias("Block1-Global"),
        *[F.lit(None).cast("int").alias(f"Block{i + 2}-{r}") for i, r in enumerate(names)],
    )
    return used.unionByName(unused)


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("spec", sf_dir, lambda: _spec(spark, sf_dir))


def _spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed spec for every model (market segment): the series of the nations of its customers."""
    one = parse_spec(raw_spec(spark, sf_dir), model="x", position="Position").drop("model")
    used = customers(spark, sf_dir).select("model", "series_id").distinct()
    return used.join(one, "series_id").select("model", *one.columns)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("series_id"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("model")
    ).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their model, nation and month."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", day.alias("ordered"), cal.month_start(day).alias("month")
    )
    return orders.join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value in cents by model, nation and complete month."""
    return order_months(spark, sf_dir).where(F.col("month") < month_end(spark, sf_dir)).drop("last_day")


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by model, nation and month with the last order day; stored, as several branches read it."""

    def build() -> DataFrame:
        cells = placed_orders(spark, sf_dir).groupBy("model", "series_id", "month").agg(
            F.sum(cents("o_totalprice")).alias("amount"), F.max("ordered").alias("last_day")
        )
        return materialise(cells, "order-months")

    return shared("order_months", sf_dir, build)


def first_open_month(last_day: Column) -> Column:
    """First month that the orders up to ``last_day`` don't cover completely."""
    return F.trunc(F.date_add(last_day, 1), "MM")


def month_end(spark: SparkSession, sf_dir: str) -> Column:
    """First day after the complete months of the orders."""
    return order_months(spark, sf_dir).agg(first_open_month(F.max("last_day"))).scalar()


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("obs", sf_dir, lambda: _obs(spark, sf_dir))


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-frequency index panel on a base of 100: quarterly series sit on the third month.

    Its vintage is the first Friday after the last complete month; a quarter
    whose third month is not complete has no value yet.
    """
    end = month_end(spark, sf_dir)
    freq = spec(spark, sf_dir).select("model", "series_id", "frequency")
    period = F.when(F.col("frequency") == "q", cal.quarter_third_month("month")).otherwise(F.col("month"))
    cells = order_cells(spark, sf_dir).join(freq, ["model", "series_id"]).withColumn("period", period)
    return (
        cells.where(F.col("period") < end)
        .groupBy("model", "series_id", "period")
        .agg((F.lit(100) + F.sum("amount").cast("double") / 100 / 10000).alias("value"))
        .select("model", cal.friday_on_or_after(end).alias("vintage"), "series_id", "period", "value")
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_monthly(obs(spark, sf_dir))


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = panel.dense_monthly(panel.with_spec(obs(spark, sf_dir), spec(spark, sf_dir)))
    return panel.transform_series(grid)


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_weeks(spark, sf_dir).drop("last_day")


def fact_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts (in 0.0001) published by model, nation, order month and release week (Friday); stored.

    A line is published when it ships, but not before its order exists.
    """

    def build() -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        net = cents("l_extendedprice") * (100 - cents("l_discount"))
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", ship.alias("ship"), net.alias("net"))
        shipped = lines.join(placed_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        known = F.greatest("ship", "ordered")
        events = shipped.groupBy(
            "model", "series_id", F.col("month").alias("period"), cal.friday_on_or_after(known).alias("release_date")
        ).agg(F.sum("net").alias("amount"), F.max("ordered").alias("last_day"))
        return materialise(events, "fact-weeks")

    return shared("fact_weeks", sf_dir, build)


def money(amount) -> Column:
    """Units of 0.0001 as a number."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast("double") / 10000


def wide_sum(c: str) -> Column:
    """Sum that cannot overflow over the whole table."""
    return F.sum(F.col(c).cast("decimal(38,0)"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts: the published value of a cell grows with every release."""
    upto = Window.partitionBy("model", "series_id", "period").orderBy("release_date")
    return fact_events(spark, sf_dir).select(
        "model", "series_id", "period", "release_date",
        (money(F.sum("amount").over(upto)) / 100000).alias("value"),
    )


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("quarters", sf_dir, lambda: _quarters(spark, sf_dir))


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target quarters: the complete order quarters that have a quarter before them."""
    day = F.trunc("period", "QUARTER")
    whole = F.trunc(first_open_month(F.max("last_day")), "QUARTER")
    span = fact_weeks(spark, sf_dir)
    first, end = span.agg(F.min(day)).scalar(), span.agg(whole).scalar()
    found = span.select(day.alias("q")).distinct().where((F.col("q") > first) & (F.col("q") < end))
    return found.select(cal.quarter_label("q").alias("quarter"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.tracking_schedule(quarters(spark, sf_dir))


def month_end_fridays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last Friday of every month in which something was released."""
    released = fact_events(spark, sf_dir).select(cal.month_start("release_date").alias("m")).distinct()
    return released.select(cal.last_friday(F.year("m"), F.month("m")).alias("vintage"))


def vintage_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("vintage_obs", sf_dir, lambda: _vintage_obs(spark, sf_dir))


def _vintage_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.value_as_of(facts(spark, sf_dir), schedule(spark, sf_dir))


def available_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintages that exist: the weeks in which a model published, less some that were lost."""
    weeks = fact_events(spark, sf_dir).select("model", F.col("release_date").alias("vintage")).distinct()
    number = (F.datediff("vintage", F.lit("1970-01-02").cast("date")) / 7).cast("int") + F.length("model")
    return weeks.where(number % 19 != 7)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of scheduled vintages; stored, as they are few and several branches join them."""

    def build() -> DataFrame:
        return materialise(asof.vintage_pairs(schedule(spark, sf_dir), available_vintages(spark, sf_dir)), "pairs")

    return shared("pairs", sf_dir, build)


def cell_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.pair_vintages(
        schedule(spark, sf_dir), vintage_obs(spark, sf_dir), available_vintages(spark, sf_dir)
    )


def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.changed_cells(facts(spark, sf_dir), pairs(spark, sf_dir))


def irregular_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking dates that keep no rhythm: fourth quarters every other week, others a day early in even weeks."""
    week = Window.partitionBy("quarter").orderBy("vintage")
    numbered = schedule(spark, sf_dir).withColumn("n", F.row_number().over(week))
    kept = numbered.where(~F.col("quarter").endswith("q4") | (F.col("n") % 2 == 1))
    early = F.when((F.col("n") % 2 == 0), F.date_sub("vintage", 1)).otherwise(F.col("vintage"))
    return kept.select("quarter", early.alias("vintage"))


def quarter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published amount by model, order quarter and release week; stored, a few rows a week."""

    def build() -> DataFrame:
        totals = fact_events(spark, sf_dir).groupBy(
            "model", cal.quarter_label("period").alias("quarter"), "release_date"
        ).agg(F.sum("amount").alias("amount"))
        return materialise(totals, "quarter-totals")

    return shared("quarter_totals", sf_dir, build)


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("actuals", sf_dir, lambda: _actuals(spark, sf_dir))


def _actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final growth of each quarter over the one before it."""
    final = quarter_totals(spark, sf_dir).groupBy("model", "quarter").agg(wide_sum("amount").alias("amount"))
    prior = final.select("model", F.col("quarter").alias("pq"), F.col("amount").alias("prior"))
    growth = final.withColumn("pq", cal.previous_quarter("quarter")).join(prior, ["model", "pq"])
    ratio = money("amount") / money("prior")
    return growth.join(quarters(spark, sf_dir), "quarter").select(
        "model", "quarter", (100 * (ratio - 1)).alias("actual")
    )


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("estimates", sf_dir, lambda: _estimates(spark, sf_dir))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of growth of the target quarter on every scheduled vintage.

    The published amount of a quarter is a running total over release weeks;
    the schedule rows join the timeline of their own and of the previous
    quarter as zero amounts, so one window gives the total on each date.
    """
    plan = schedule(spark, sf_dir)
    totals = quarter_totals(spark, sf_dir)
    begun = totals.select("model", cal.next_quarter("quarter").alias("quarter")).distinct()
    asked = begun.join(plan, "quarter").select("model", F.col("quarter").alias("target"), "vintage")
    own = asked.withColumn("quarter", F.col("target"))
    prior = asked.withColumn("quarter", cal.previous_quarter("target"))
    asks = own.unionByName(prior).select(
        "model", "quarter", F.col("vintage").alias("d"), "target",
        F.lit(0).cast("bigint").alias("amount"),
    )
    released = totals.select(
        "model", "quarter", F.col("release_date").alias("d"),
        F.lit(None).cast("string").alias("target"), "amount",
    )
    upto = Window.partitionBy("model", "quarter").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    running = released.unionByName(asks).withColumn("known", F.sum("amount").over(upto))
    sides = running.where(F.col("target").isNotNull()).groupBy(
        "model", F.col("target").alias("quarter"), F.col("d").alias("vintage")
    ).agg(
        F.max(F.when(F.col("quarter") == F.col("target"), F.col("known"))).alias("cur"),
        F.max(F.when(F.col("quarter") != F.col("target"), F.col("known"))).alias("prev"),
    )
    start = cal.quarter_start("quarter")
    length = F.datediff(F.add_months(start, 3), start)
    share = F.greatest(F.lit(0), F.least(F.datediff("vintage", start), length)) / length
    growth = 100 * (money("cur") / money("prev") - 1)
    return sides.where(F.col("prev") > 0).select(
        "model", "quarter", "vintage", growth.alias("y_a"),
        (growth * (0.5 + 0.5 * share)).alias("y_b"),
    )


def nowcast(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """Scored weekly nowcasts of one model variant.

    Variant b lacks its fifth week in first quarters, so pairing by date and
    by position differ.
    """
    week = Window.partitionBy("model", "quarter").orderBy("vintage")
    y = estimates(spark, sf_dir).select(
        "model", "quarter", "vintage", F.col(f"y_{variant}").alias("y_new"),
        F.row_number().over(week).alias("n"),
    )
    if variant == "b":
        y = y.where(~((F.col("n") == 5) & F.col("quarter").endswith("q1")))
    early = F.col("vintage") < cal.quarter_start("quarter")
    steps = y.withColumn("y_old", F.lag("y_new").over(week)).where(F.col("y_old").isNotNull())
    change = F.col("y_new") - F.col("y_old")
    # The part of a change that revisions make differs from week to week: one to four eighths.
    eighths = (F.datediff("vintage", F.lit("1970-01-02").cast("date")) / 7).cast("int") % 4
    rows = steps.select(
        "model", "quarter", "vintage", "y_old", "y_new",
        ((1 + eighths) / 8 * change).alias("impact_revisions"), ((7 - eighths) / 8 * change).alias("impact_releases"),
        F.when(early, "prev").otherwise("curr").alias("params_used"),
    )
    return score.score(rows, actuals(spark, sf_dir))


def first_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_events(spark, sf_dir).groupBy("model", "series_id", "period").agg(
        F.min("release_date").alias("vintage"),
        (money(F.min_by("amount", "release_date")) / 100000).alias("actual"),
    )


def region_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a series: its region's share of the model's published amount."""
    amounts = fact_events(spark, sf_dir).groupBy("model", "series_id").agg(wide_sum("amount").alias("amount"))
    joined = amounts.join(spec(spark, sf_dir).select("model", "series_id", "category"), ["model", "series_id"])
    share = money(F.sum("amount").over(Window.partitionBy("model", "category"))) / money(
        F.sum("amount").over(Window.partitionBy("model"))
    )
    return joined.select("model", "series_id", share.alias("weight"))


def trailing_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast of a first release: the mean of the series' twelve months before it."""
    year = Window.partitionBy("model", "series_id").orderBy("period").rowsBetween(-12, -1)
    return first_releases(spark, sf_dir).withColumn("forecast", F.avg("actual").over(year))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News rows of every scheduled update: first releases of the week times region weight."""
    forecasts = trailing_forecasts(spark, sf_dir).join(schedule(spark, sf_dir), "vintage")
    rows = forecasts.withColumn("news", F.col("actual") - F.col("forecast"))
    scored = news_ops.release_impacts(rows, region_weights(spark, sf_dir), ["model", "series_id"])
    return scored.select(
        "model", "quarter", "vintage", "series_id", "period", "forecast", "actual", "weight", "impact"
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to region; one region is left out so that unmatched series occur."""
    regions = table(spark, sf_dir, "region").where(F.col("r_name") != "ASIA")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("n_name").alias("series_id"), F.col("r_name").alias("category"))


def estimation_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date on which the parameters of each quarter are estimated, by quarter.

    The first scheduled vintage inside the quarter; for the quarter before the
    first target, which has no schedule, its first Friday.  Every tenth quarter
    was never estimated.
    """
    started = schedule(spark, sf_dir).where(F.col("vintage") >= cal.quarter_start("quarter"))
    found = started.groupBy(F.col("quarter").alias("param_quarter")).agg(F.min("vintage").alias("est_vintage"))
    first = quarters(spark, sf_dir).agg(F.min("quarter").alias("q")).select(cal.previous_quarter("q").alias("param_quarter"))
    start = first.withColumn("est_vintage", cal.friday_on_or_after(cal.quarter_start("param_quarter")))
    number = F.year("est_vintage") * 4 + F.quarter("est_vintage")
    return found.unionByName(start).where(number % 10 != 3)


# ---------------------------------------------------------------- factor-model fixtures


def panel_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.drop_initial(transformed(spark, sf_dir), 3)
    return out.select("model", "vintage", "series_id", "period", F.col("x").alias("value"), "frequency")


def panel_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.standardise(panel_x(spark, sf_dir))


def mean_factor(z: DataFrame) -> DataFrame:
    """Cross-section mean by month: a factor that SQL can state."""
    return z.groupBy("model", "vintage", "period").agg(F.avg("z").alias("f"))


def simple_loadings(z: DataFrame, lags: DataFrame) -> DataFrame:
    """c0..c4: slope on the current factor for monthly, tent loadings for quarterly series."""
    f = lags.select("model", "vintage", "period", "f")
    both = z.where(F.col("frequency") == "m").join(f, ["model", "vintage", "period"])
    square = F.sum(F.when(F.col("z").isNotNull(), F.col("f") * F.col("f")))
    monthly = both.groupBy("model", "vintage", "series_id").agg(
        F.try_divide(F.sum(F.col("z") * F.col("f")), square).alias("c0")
    )
    monthly = monthly.withColumns({f"c{k}": F.lit(0.0) for k in range(1, 5)})
    quarterly = factor.restricted_loadings(z.where(F.col("frequency") == "q"), lags).drop("b")
    return monthly.unionByName(quarterly)


def simple_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate parameter table made of slopes, AR fits and scales of the static panel."""
    z = materialise(panel_z(spark, sf_dir), "panel_z")
    place = spec(spark, sf_dir).select("model", "series_id", (F.col("spec_pos") - 1).alias("i"), "category")
    lags = factor.factor_lags(mean_factor(z))
    keys = ["model", F.col("vintage").alias("est_vintage")]
    loads = simple_loadings(z, lags).join(place, ["model", "series_id"])
    own = F.array_position(F.array(*[F.lit(r) for r in REGIONS]), F.col("category")).cast("int") * 5
    entries = F.array(
        *[F.struct(F.lit(k).alias("j"), F.col(f"c{k}").alias("v")) for k in range(5)],
        F.struct(own.alias("j"), (F.col("c0") / 2).alias("v")),
    )
    c = loads.withColumn("_e", F.explode(entries)).select(
        *keys, F.lit("C").alias("name"), "i", F.col("_e.j").alias("j"), F.col("_e.v").alias("v")
    )
    ar = factor.ar1(z, ["model", "vintage", "series_id"], "z").join(place, ["model", "series_id"])
    state = F.when(F.col("i") < 20, 30 + F.col("i")).otherwise(50 + 5 * (F.col("i") - 20))
    dynamics = ar.withColumn("k", state).withColumn(
        "_e",
        F.explode(
            F.array(
                F.struct(F.lit("A").alias("name"), F.col("b").alias("v")),
                F.struct(F.lit("Q").alias("name"), F.col("residual_variance").alias("v")),
            )
        ),
    ).select(*keys, "_e.name", F.col("k").alias("i"), F.col("k").alias("j"), "_e.v")
    factor_ar = factor.ar1(mean_factor(z), ["model", "vintage"], "f").withColumn(
        "_e",
        F.explode(
            F.array(
                F.struct(F.lit("A").alias("name"), F.col("b").alias("v")),
                F.struct(F.lit("Q").alias("name"), F.col("residual_variance").alias("v")),
            )
        ),
    ).select(*keys, "_e.name", F.lit(0).alias("i"), F.lit(0).alias("j"), "_e.v")
    scale = panel.scale_stats(z).join(place, ["model", "series_id"]).withColumn(
        "_e",
        F.explode(
            F.array(
                F.struct(F.lit("Mx").alias("name"), F.col("mx").alias("v")),
                F.struct(F.lit("Wx").alias("name"), F.col("wx").alias("v")),
            )
        ),
    ).select(*keys, "_e.name", "i", F.lit(0).alias("j"), "_e.v")
    return materialise(c.unionByName(dynamics).unionByName(factor_ar).unionByName(scale), "params")


BLOCKS = ["Global", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLEEAST"]
