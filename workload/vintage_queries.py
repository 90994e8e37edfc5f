"""Queries over the bitemporal panel: as-of values, pairs of vintages, news."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import asof, news
from workload import fixtures as fx
from workload.registry import query


@query("value_as_of", """
SELECT f.model, v.vintage, f.series_id, count(*) AS cells, sum(f.value) AS total, max(f.value) AS largest
FROM fact_versions f
JOIN (SELECT m + ((k * 7)::INTEGER) AS vintage FROM (SELECT DATE '1970-01-02' AS m), (SELECT unnest(generate_series(0, 4000)) AS k)) v
  ON v.vintage >= f.release_date AND (f.next_release IS NULL OR v.vintage < f.next_release)
WHERE v.vintage IN (SELECT max(w) FROM (SELECT DATE '1970-01-02' + ((k * 7)::INTEGER) AS w FROM (SELECT unnest(generate_series(0, 4000)) AS k))
                    WHERE date_trunc('month', w) IN (SELECT date_trunc('month', release_date) FROM fact_events)
                    GROUP BY date_trunc('month', w))
GROUP BY 1, 2, 3""", "total largest")
def value_as_of(spark, d):
    """Every last Friday of a month over the whole span of releases."""
    known = asof.value_as_of(fx.facts(spark, d), fx.month_end_fridays(spark, d))
    return known.groupBy("model", "vintage", "series_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"), F.max("value").alias("largest")
    )


@query("fact_versions", """
SELECT model, series_id, period, release_date, value,
  CAST(coalesce(next_release - 1, DATE '2001-12-31') AS DATE) AS valid_to FROM fact_versions""", "value")
def fact_versions(spark, d):
    return asof.fact_versions(fx.facts(spark, d), F.lit("2001-12-31").cast("date"))


@query("asof_join", """
SELECT o_orderkey, model, series_id, day, value, release_date
FROM (SELECT o_orderkey, c_mktsegment AS model, n_name AS series_id, CAST(o_orderdate AS DATE) AS day
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) l
ASOF LEFT JOIN (SELECT model AS m, series_id AS s, release_date, CAST(sum(amount) AS DOUBLE) / 100 AS value
                FROM fact_events GROUP BY 1, 2, 3) r
  ON l.model = r.m AND l.series_id = r.s AND l.day >= r.release_date""", "value")
def asof_join(spark, d):
    """Latest weekly publication of the customer's nation known when an order came in."""
    orders = fx.placed_orders(spark, d).select("o_orderkey", "model", "series_id", F.col("ordered").alias("day"))
    weekly = fx.fact_events(spark, d).groupBy("model", "series_id", "release_date").agg(
        (fx.money(F.sum("amount")) / 100).alias("value")
    )
    return asof.asof_join(
        orders, weekly, ["model", "series_id"], "day", "release_date", ["value", "release_date"]
    )


@query("select_params", """
WITH first AS (SELECT CAST(min(q_start) - INTERVAL 3 MONTH AS DATE) AS q FROM quarters),
made AS (
  SELECT quarter AS param_quarter, min(vintage) FILTER (vintage >= q_start) AS est_vintage FROM schedule GROUP BY 1
  UNION ALL SELECT year(q) || '_q' || quarter(q), CAST(q + CAST((12 - isodow(q)) % 7 AS INTEGER) AS DATE) FROM first),
asked AS (
  SELECT quarter, vintage, CASE WHEN vintage < q_start THEN 'prev' ELSE 'curr' END AS params_used,
    CASE WHEN vintage < q_start
     THEN year(q_start - INTERVAL 3 MONTH) || '_q' || quarter(q_start - INTERVAL 3 MONTH) ELSE quarter END AS param_quarter
  FROM schedule)
SELECT a.quarter, a.vintage, a.params_used, a.param_quarter, m.est_vintage,
  CASE WHEN m.est_vintage IS NULL THEN 'no parameters for ' || a.param_quarter END AS missing
FROM asked a LEFT JOIN (SELECT * FROM made WHERE (year(est_vintage) * 4 + quarter(est_vintage)) % 10 <> 3) m
  ON m.param_quarter = a.param_quarter""")
def select_params(spark, d):
    """Every scheduled row, also those whose quarter was never estimated."""
    plan = fx.schedule(spark, d)
    return asof.select_params(plan, fx.estimation_vintages(spark, d)).select(
        "quarter", "vintage", "params_used", "param_quarter", "est_vintage", "missing"
    )


@query("vintage_pairs", "SELECT model, quarter, vintage_old, vintage FROM pairs")
def vintage_pairs(spark, d):
    """Pairs of scheduled vintages; the lost weeks of each model leave holes."""
    return fx.pairs(spark, d)


@query("lost_pairs", """
WITH published AS (SELECT DISTINCT model, release_date AS vintage FROM fact_events),
steps AS (SELECT quarter, vintage, lag(vintage) OVER (PARTITION BY quarter ORDER BY vintage) AS vintage_old FROM schedule)
SELECT a.model, a.vintage AS lost, s.quarter, count(*) AS pairs
FROM published a JOIN steps s ON a.vintage IN (s.vintage, s.vintage_old)
JOIN published n ON n.model = a.model AND n.vintage = s.vintage
JOIN published o ON o.model = a.model AND o.vintage = s.vintage_old
WHERE ((a.vintage - DATE '1970-01-02') // 7 + length(a.model)) % 19 = 7 GROUP BY 1, 2, 3""")
def lost_pairs(spark, d):
    """Pairs that each lost vintage takes away: those of the complete list that are not among the pairs."""
    published = fx.fact_events(spark, d).select("model", F.col("release_date").alias("vintage")).distinct()
    lost = published.join(fx.available_vintages(spark, d), ["model", "vintage"], "left_anti").withColumnRenamed("vintage", "lost")
    gone = asof.vintage_pairs(fx.schedule(spark, d), published).join(fx.pairs(spark, d), asof.PAIR, "left_anti")
    sides = gone.select("model", "quarter", F.explode(F.array("vintage_old", "vintage")).alias("lost"))
    return lost.join(sides, ["model", "lost"]).groupBy("model", "lost", "quarter").agg(F.count(F.lit(1)).alias("pairs"))


_IRREGULAR = """(SELECT quarter, CASE WHEN n % 2 = 0 THEN CAST(vintage - 1 AS DATE) ELSE vintage END AS vintage
  FROM (SELECT quarter, vintage, row_number() OVER (PARTITION BY quarter ORDER BY vintage) AS n FROM schedule)
  WHERE quarter NOT LIKE '%q4' OR n % 2 = 1)"""


@query("irregular_vintage_changes", f"""
WITH steps AS (SELECT quarter, vintage, lag(vintage) OVER (PARTITION BY quarter ORDER BY vintage) AS vintage_old FROM {_IRREGULAR}),
have AS (SELECT DISTINCT model, vintage FROM steps JOIN (SELECT DISTINCT model, quarter FROM quarter_totals) USING (quarter)),
side AS (SELECT n.model, s.* FROM steps s JOIN have n ON n.vintage = s.vintage JOIN have o ON o.vintage = s.vintage_old AND o.model = n.model),
sides AS (
  SELECT b.model, b.quarter, b.vintage_old, b.vintage, f.series_id, f.period,
    max(f.value) FILTER (b.vintage_old >= f.release_date AND (f.next_release IS NULL OR b.vintage_old < f.next_release)) AS old,
    max(f.value) FILTER (b.vintage >= f.release_date AND (f.next_release IS NULL OR b.vintage < f.next_release)) AS new
  FROM side b JOIN fact_versions f ON f.model = b.model AND b.vintage >= f.release_date
    AND (f.next_release IS NULL OR b.vintage_old < f.next_release)
  GROUP BY 1, 2, 3, 4, 5, 6)
SELECT model, quarter, vintage_old, vintage, count(*) FILTER (old IS NULL) AS released, count(*) FILTER (old <> new) AS revised,
  sum(new) FILTER (old IS NULL OR old <> new) AS total
FROM sides GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (old IS NULL OR old <> new) > 0""", "total")
def irregular_vintage_changes(spark, d):
    """Releases and revisions between tracking dates that keep no weekly rhythm."""
    plan = fx.irregular_schedule(spark, d)
    begun = fx.quarter_totals(spark, d).select("model", "quarter").distinct()
    have = plan.join(begun, "quarter").select("model", "vintage")
    cells = asof.changed_cells(fx.facts(spark, d), asof.vintage_pairs(plan, have))
    return cells.groupBy(*asof.PAIR).agg(
        F.count_if(F.col("old").isNull()).alias("released"), F.count_if(F.col("old").isNotNull()).alias("revised"),
        F.sum("new").alias("total"),
    )


_SUM = """count(*) AS cells, count(old) AS old_cells, count(new) AS new_cells,
  sum(old) AS old_total, sum(new) AS new_total"""


@query("pair_vintages", f"""
SELECT model, quarter, vintage_old, vintage, series_id, {_SUM} FROM cell_pairs GROUP BY 1, 2, 3, 4, 5""",
       "old_total new_total")
def pair_vintages(spark, d):
    return fx.cell_pairs(spark, d).groupBy("model", "quarter", "vintage_old", "vintage", "series_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("old").alias("old_cells"), F.count("new").alias("new_cells"),
        F.sum("old").alias("old_total"), F.sum("new").alias("new_total"),
    )


@query("vintage_diff", """
SELECT model, quarter, vintage, CASE WHEN old IS NULL THEN 'released' WHEN new IS NULL THEN 'withdrawn'
  WHEN old = new THEN 'unchanged' ELSE 'revised' END AS status, count(*) AS cells
FROM cell_pairs GROUP BY 1, 2, 3, 4""")
def vintage_diff(spark, d):
    """Cells by status; the unchanged ones are counted without being listed."""
    pairs = fx.pairs(spark, d)
    known = asof.known_cells(fx.facts(spark, d), pairs.select("model", F.col("vintage_old").alias("vintage")))
    counts = news.status_counts(fx.changed_cells(spark, d), known, pairs)
    return counts.select("model", "quarter", "vintage", "status", "cells")


@query("vintage_diff_by_cell", """
SELECT model, quarter, vintage, CASE WHEN old IS NULL THEN 'released' WHEN new IS NULL THEN 'withdrawn'
  WHEN old = new THEN 'unchanged' ELSE 'revised' END AS status, count(*) AS cells
FROM cell_pairs GROUP BY 1, 2, 3, 4""")
def vintage_diff_by_cell(spark, d):
    """The same counts from the listing of every cell of every pair."""
    diff = news.vintage_diff(fx.cell_pairs(spark, d))
    return diff.groupBy("model", "quarter", "vintage", "status").agg(F.count(F.lit(1)).alias("cells"))


@query("released_cells", "SELECT * FROM changed_cells WHERE old IS NULL", "new")
def released_cells(spark, d):
    return news.released_cells(fx.changed_cells(spark, d))


@query("revised_cells", "SELECT * FROM changed_cells WHERE old IS NOT NULL AND new IS NOT NULL", "old new")
def revised_cells(spark, d):
    return news.revised_cells(fx.changed_cells(spark, d))


@query("released_series", """
SELECT model, quarter, vintage_old, vintage, series_id, bool_or(old IS NULL AND new IS NOT NULL) AS released
FROM cell_pairs GROUP BY 1, 2, 3, 4, 5""")
def released_series(spark, d):
    since = fx.fact_events(spark, d).groupBy("model", "series_id").agg(F.min("release_date").alias("since"))
    return news.series_released(fx.pairs(spark, d), since, fx.changed_cells(spark, d))


@query("revised_view", """
SELECT model, quarter, vintage, series_id, count(CASE WHEN old IS NOT NULL THEN new END) AS cells,
  sum(CASE WHEN old IS NOT NULL THEN new END) AS total FROM cell_pairs GROUP BY 1, 2, 3, 4""", "total")
def revised_view(spark, d):
    view = news.revised_view(fx.cell_pairs(spark, d))
    return view.groupBy("model", "quarter", "vintage", "series_id").agg(
        F.count("revised").alias("cells"), F.sum("revised").alias("total")
    )


_NEWS = """
SELECT c.model, c.quarter, c.vintage, c.series_id, c.period, c.new AS actual, f.forecast,
  c.new - f.forecast AS news
FROM changed_cells c LEFT JOIN forecasts f ON f.model = c.model AND f.vintage = c.vintage
  AND f.series_id = c.series_id AND f.period = c.period
WHERE c.old IS NULL"""


def news_rows(spark, d):
    plan = fx.schedule(spark, d)
    forecasts = fx.trailing_forecasts(spark, d).join(plan, "vintage")
    return news.news(fx.changed_cells(spark, d), forecasts)


@query("news", _NEWS, "actual forecast news")
def news_query(spark, d):
    return news_rows(spark, d)


_IMPACTS = f"""
SELECT n.*, w.weight, w.weight * n.news AS impact FROM ({_NEWS}) n
LEFT JOIN region_weights w ON w.model = n.model AND w.series_id = n.series_id"""


@query("release_impacts", _IMPACTS, "actual forecast news weight impact")
def release_impacts(spark, d):
    return news.release_impacts(news_rows(spark, d), fx.region_weights(spark, d), ["model", "series_id"])


_WEIGHTED = """
SELECT c.model, c.quarter, c.vintage,
  coalesce(sum(w.weight * old), 0) AS y_old,
  coalesce(sum(w.weight * CASE WHEN old IS NOT NULL THEN new END), 0) AS y_rev,
  coalesce(sum(w.weight * new), 0) AS y_new
FROM cell_pairs c JOIN region_weights w ON w.model = c.model AND w.series_id = c.series_id
GROUP BY 1, 2, 3"""


def evaluations(spark, d, weights):
    """Weighted panel totals of the old, the revised and the new view of every pair.

    The total on a vintage is a running sum of weighted changes over the release dates; what
    was revised or released since comes on top.
    """
    w = F.col("weight")
    once = fx.facts(spark, d)
    upto = Window.partitionBy("model", "series_id", "period").orderBy("release_date")
    steps = once.withColumn("step", F.col("value") - F.coalesce(F.lag("value").over(upto), F.lit(0.0)))
    daily = steps.join(weights, ["model", "series_id"]).groupBy("model", F.col("release_date").alias("day")).agg(
        F.sum(w * F.col("step")).alias("total")
    )
    pairs = fx.pairs(spark, d)
    start = asof.level_at(daily, pairs.select("model", F.col("vintage_old").alias("vintage")), ["total"])
    released = F.col("old").isNull()
    moved = fx.changed_cells(spark, d).join(weights, ["model", "series_id"]).groupBy("model", "quarter", "vintage").agg(
        F.sum(F.when(~released, w * (F.col("new") - F.col("old")))).alias("_rev"), F.sum(F.when(released, w * F.col("new"))).alias("_rel")
    )
    base = pairs.join(start.select("model", F.col("vintage").alias("vintage_old"), "total"), ["model", "vintage_old"])
    both = base.join(moved, ["model", "quarter", "vintage"], "left").na.fill(0.0, ["_rev", "_rel"])
    return both.select(
        "model", "quarter", "vintage", F.col("total").alias("y_old"), (F.col("total") + F.col("_rev")).alias("y_rev"),
        (F.col("total") + F.col("_rev") + F.col("_rel")).alias("y_new"),
    )


def evaluations_by_cell(pairs, weights):
    """The same totals from the listing of every cell of every pair."""
    cells = news.revised_view(pairs).join(weights, ["model", "series_id"])
    w = F.col("weight")
    return cells.groupBy("model", "quarter", "vintage").agg(
        *[
            F.coalesce(F.sum(w * F.col(c)), F.lit(0.0)).alias(name)
            for c, name in [("old", "y_old"), ("revised", "y_rev"), ("new", "y_new")]
        ]
    )


@query("revision_impact", f"SELECT *, y_rev - y_old AS impact_revisions FROM ({_WEIGHTED})",
       "y_old y_rev y_new impact_revisions")
def revision_impact(spark, d):
    return news.revision_impact(evaluations(spark, d, fx.region_weights(spark, d)))


def decomposed(spark, d):
    """Linear nowcast of every pair: zero forecasts, so a release counts with its whole value."""
    weights = fx.region_weights(spark, d)
    changes = fx.changed_cells(spark, d)
    zero = news.released_cells(changes).withColumn("forecast", F.lit(0.0))
    impacts = news.release_impacts(news.news(changes, zero), weights, ["model", "series_id"])
    totals = news.total_impact(impacts)
    head = news.revision_impact(evaluations(spark, d, weights)).join(totals, ["model", "quarter", "vintage"], "left")
    return head.withColumn("impact_releases", F.coalesce("impact_releases", F.lit(0.0))), impacts


@query("decomposition_gaps", """
SELECT model, quarter, count(*) AS checked, CAST(0 AS BIGINT) AS gaps FROM pairs GROUP BY 1, 2""")
def decomposition_gaps(spark, d):
    """Revisions and releases add up to the change of every nowcast, which is taken from the whole views here."""
    head, _ = decomposed(spark, d)
    weights = fx.region_weights(spark, d)
    whole = evaluations_by_cell(fx.cell_pairs(spark, d), weights).select("model", "quarter", "vintage", "y_old", "y_new")
    parts = head.select("model", "quarter", "vintage", "impact_revisions", "impact_releases")
    return news.check_decomposition(whole.join(parts, ["model", "quarter", "vintage"], "left"))


@query("update_report", f"""
SELECT e.model, e.quarter, e.vintage, y_old, y_rev - y_old AS impact_revisions,
  y_new - y_rev AS impact_releases, y_new - y_old AS total_impact, y_new,
  c.series_id, c.period, CASE WHEN c.period IS NOT NULL THEN CAST(0 AS DOUBLE) END AS forecast, c.new AS actual, w.weight, w.weight * c.new AS impact
FROM ({_WEIGHTED}) e
LEFT JOIN (SELECT * FROM changed_cells WHERE old IS NULL AND new IS NOT NULL) c
  ON c.model = e.model AND c.quarter = e.quarter AND c.vintage = e.vintage
LEFT JOIN region_weights w ON w.model = c.model AND w.series_id = c.series_id""",
       "y_old impact_revisions impact_releases total_impact y_new forecast actual weight impact")
def update_report(spark, d):
    head, impacts = decomposed(spark, d)
    return news.update_report(head, impacts)


@query("total_impact", """
SELECT model, quarter, vintage, coalesce(sum(impact), 0) AS impact_releases FROM news GROUP BY 1, 2, 3""",
       "impact_releases")
def total_impact(spark, d):
    return news.total_impact(fx.news(spark, d))


@query("backfill", """
SELECT c.model, c.vintage, c.series_id, c.period, coalesce(b.value, e.value) AS value
FROM (SELECT DISTINCT d.model, d.vintage, d.period, s.series_id
      FROM obs d JOIN spec_t s ON s.model = d.model WHERE d.series_id <> 'NATION_3' AND s.frequency = 'm') c
LEFT JOIN (SELECT * FROM obs WHERE series_id <> 'NATION_3' AND value < 130) b
  ON b.model = c.model AND b.series_id = c.series_id AND b.period = c.period
LEFT JOIN (SELECT model, series_id, month AS period, CAST(amount AS DOUBLE) / 1000 AS value FROM order_cells) e
  ON e.model = c.model AND e.series_id = c.series_id AND e.period = c.period""", "value")
def backfill(spark, d):
    """Holes and one absent series of the panel filled from a second source."""
    monthly = fx.spec(spark, d).where(F.col("frequency") == "m").select("model", "series_id")
    base = fx.obs(spark, d).where(F.col("series_id") != "NATION_3").withColumn(
        "value", F.when(F.col("value") < 130, F.col("value"))
    )
    extra = fx.order_cells(spark, d).join(monthly, ["model", "series_id"]).select(
        "model", cal.friday_on_or_after(fx.month_end(spark, d)).alias("vintage"), "series_id",
        F.col("month").alias("period"), (F.col("amount").cast("double") / 100 / 1000).alias("value"),
    )
    filled = asof.backfill(base, extra)
    return filled.join(monthly, ["model", "series_id"], "left_semi")


@query("panel_at_vintages", """
SELECT o.model, o.vintage, o.period, count(*) AS cells, sum(o.value) AS total
FROM vintage_obs o GROUP BY 1, 2, 3""", "total")
def panel_at_vintages(spark, d):
    return fx.vintage_obs(spark, d).groupBy("model", "vintage", "period").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")
    )
