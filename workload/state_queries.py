"""Queries over scalar state-space models: filter by scan, smoother and fit."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import asof, news
from tidemark.operators import state_space as ss
from workload import fixtures as fx
from workload.factor_queries import local_level_sql, stored_z
from workload.registry import query

KEYS = ["model", "vintage", "series_id"]
MONTH = "CAST(year(period) * 12 + month(period) - 1 AS BIGINT)"
#: Seconds of a step of the event series.
SLOT = 900
ROUNDS, THRESHOLD = 5, 0.01


@query("local_level_by_buckets", local_level_sql("dense", ", ".join(KEYS)), "level variance loglik")
def local_level_by_buckets(spark, d):
    """The model of ``local_level`` on the same panel, by the scan over buckets of 16 months."""
    return ss.local_level_scan(fx.dense(spark, d), ss.month_number(F.col("period")), 4.0, 25.0, width=16)


@query("local_level_long", f"""
WITH RECURSIVE slots AS (
  SELECT event_type, CAST(floor(epoch(ts) / {SLOT}) AS BIGINT) AS t, sum(round(value * 100)) / 100 AS value FROM events GROUP BY 1, 2),
ends AS (SELECT event_type, min(t) AS low, max(t) AS high FROM slots GROUP BY 1),
numbered AS (SELECT g.event_type, CAST(g.t - low + 1 AS INTEGER) AS n, value
  FROM (SELECT event_type, low, unnest(range(low, high + 1)) AS t FROM ends) g LEFT JOIN slots s ON s.event_type = g.event_type AND s.t = g.t),
k AS (
  SELECT event_type, 0 AS n, CAST(0 AS DOUBLE) AS a, CAST(1e6 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll, 0 AS hits FROM ends
  UNION ALL
  SELECT k.event_type, d.n, CASE WHEN value IS NULL THEN a ELSE a + (p + 4) / (p + 4 + 25) * (value - a) END,
    CASE WHEN value IS NULL THEN p + 4 ELSE (p + 4) * 25 / (p + 4 + 25) END,
    CASE WHEN value IS NULL THEN ll ELSE ll - 0.5 * (ln(p + 4 + 25) + (value - a) * (value - a) / (p + 4 + 25)) END,
    CASE WHEN value IS NULL THEN hits ELSE hits + 1 END
  FROM k JOIN numbered d ON d.event_type = k.event_type AND d.n = k.n + 1)
SELECT k.event_type, a AS level, p AS variance, ll AS loglik, hits AS observations FROM k JOIN ends USING (event_type) WHERE n = high - low + 1""",
       "level variance loglik")
def local_level_long(spark, d):
    """A local level for every event type on quarter hours: thousands of steps a series."""
    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SLOT).alias("t")
    slots = fx.table(spark, d, "events").groupBy("event_type", t).agg((F.sum(fx.cents("value")) / 100).alias("value"))
    steps = ss.every_step(slots, ["event_type"])
    return ss.local_level_scan(steps, F.col("t"), 4.0, 25.0, keys=["event_type"])


def _filter_sql(name: str, params: str) -> str:
    """A recursive filter over ``numbered`` with the variances of ``params``; n = 0 is the start."""
    on = " AND ".join(f"d.{c} = k.{c}" for c in KEYS)
    k, keys = ", ".join(f"k.{c}" for c in KEYS), ", ".join(KEYS)
    return f"""{name} AS (
  SELECT {keys}, 0 AS n, CAST(NULL AS DOUBLE) AS x, q, r, CAST(0 AS DOUBLE) AS a, CAST(1e6 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM {params}
  UNION ALL
  SELECT {k}, d.n, d.z, q, r, CASE WHEN d.z IS NULL THEN a ELSE a + (p + q) / (p + q + r) * (d.z - a) END,
    CASE WHEN d.z IS NULL THEN p + q ELSE (p + q) * r / (p + q + r) END,
    CASE WHEN d.z IS NULL THEN 0 ELSE -0.5 * (ln(p + q + r) + (d.z - a) * (d.z - a) / (p + q + r)) END
  FROM {name} k JOIN numbered d ON {on} AND d.n = k.n + 1)"""


def _smoother_sql(name: str, source: str) -> str:
    """The backward recursion over a filter's rows, with each step's gain and the filtered level before it."""
    on = " AND ".join(f"f.{c} = b.{c}" for c in KEYS)
    b, keys = ", ".join(f"b.{c}" for c in KEYS), ", ".join(KEYS)
    return f"""{name} AS (
  SELECT {keys}, n, x, q, r, a, p, ll, a AS s, p AS v FROM {source} JOIN lengths USING ({keys}) WHERE n = steps
  UNION ALL
  SELECT {b}, f.n, f.x, f.q, f.r, f.a, f.p, f.ll, f.a + f.p / (f.p + f.q) * (b.s - f.a),
    f.p + f.p / (f.p + f.q) * f.p / (f.p + f.q) * (b.v - f.p - f.q)
  FROM {name} b JOIN {source} f ON {on} AND f.n = b.n - 1)"""


_NUMBERED = f"""numbered AS (SELECT {", ".join(KEYS)}, {MONTH} AS t, z,
    CAST(row_number() OVER (PARTITION BY {", ".join(KEYS)} ORDER BY period) AS INTEGER) AS n FROM panel_z),
  lengths AS (SELECT {", ".join(KEYS)}, max(n) AS steps FROM numbered GROUP BY {", ".join(KEYS)})"""


@query("smoothed_levels", f"""
WITH RECURSIVE {_NUMBERED},
params AS (SELECT {", ".join(KEYS)}, CAST(0.1 AS DOUBLE) AS q, CAST(0.6 AS DOUBLE) AS r FROM lengths),
{_filter_sql("f", "params")},
{_smoother_sql("b", "f")}
SELECT b.model, b.vintage, b.series_id, t, z, b.a AS filtered, b.p AS filtered_variance, s AS level, v AS variance, f.p / (f.p + f.q) * v AS lag_cov
FROM b JOIN numbered d ON d.model = b.model AND d.vintage = b.vintage AND d.series_id = b.series_id AND d.n = b.n
  JOIN f ON f.model = b.model AND f.vintage = b.vintage AND f.series_id = b.series_id AND f.n = b.n - 1""",
       "z filtered filtered_variance level variance lag_cov")
def smoothed_levels(spark, d):
    """Level, variance and lag-one covariance of every month given all months."""
    return ss.smooth_levels(stored_z(spark, d), ss.month_number(F.col("period")), 0.1, 0.6, value="z", width=16)


def _fit_sql() -> str:
    keys = ", ".join(KEYS)
    parts = [_NUMBERED, f"""par1 AS (SELECT {keys}, var_samp(z) / 2 AS q, var_samp(z) / 2 AS r FROM numbered GROUP BY {keys} HAVING var_samp(z) > 0)"""]
    for k in range(1, ROUNDS + 1):
        parts += [_filter_sql(f"f{k}", f"par{k}"), _smoother_sql(f"b{k}", f"f{k}")]
        parts.append(f"""sum{k} AS (
  SELECT b.model, b.vintage, b.series_id, any_value(b.q) AS level_var, any_value(b.r) AS noise_var, sum(b.ll) AS loglik,
    avg(pow(f.q / (f.p + f.q) * (b.s - f.a), 2) + pow(f.q / (f.p + f.q), 2) * b.v + f.p * f.q / (f.p + f.q)) AS q,
    avg(CASE WHEN b.x IS NOT NULL THEN (b.x - b.s) * (b.x - b.s) + b.v END) AS r
  FROM b{k} b JOIN f{k} f ON f.model = b.model AND f.vintage = b.vintage AND f.series_id = b.series_id AND f.n = b.n - 1 GROUP BY 1, 2, 3)""")
        parts.append(f"par{k + 1} AS (SELECT {keys}, q, r FROM sum{k})")
    rounds = " UNION ALL ".join(f"SELECT {keys}, {k} AS iteration, level_var, noise_var, q AS next_level_var, r AS next_noise_var, loglik FROM sum{k}" for k in range(1, ROUNDS + 1))
    return f"""WITH RECURSIVE {", ".join(parts)},
trace AS (SELECT *, abs(loglik - before) / nullif((abs(loglik) + abs(before)) / 2, 0) AS change
  FROM (SELECT *, lag(loglik) OVER (PARTITION BY {keys} ORDER BY iteration) AS before FROM ({rounds}))),
ruled AS (SELECT *, coalesce(iteration >= 4 AND change < {THRESHOLD}, false) AS converged FROM trace)
SELECT {keys}, iteration, level_var, noise_var, next_level_var, next_noise_var, loglik, change, converged, coalesce(loglik - before < -1e-3, false) AS decreased
FROM (SELECT *, min(CASE WHEN converged THEN iteration END) OVER (PARTITION BY {keys}) AS stopped FROM ruled) WHERE iteration <= coalesce(stopped, iteration)"""


@query("fit_local_level", _fit_sql(), "level_var noise_var next_level_var next_noise_var loglik change")
def fit_local_level(spark, d):
    """Level and noise variance of every series by expectation maximisation, stopped by the rule on its own likelihood."""
    return ss.fit_local_level(stored_z(spark, d), ss.month_number(F.col("period")), ROUNDS, THRESHOLD, value="z")


# ---------------------------------------------------------------- news of a model


def total_cells(spark, d):
    """Old and new published value of every month up to the end of the target quarter, for the total of each model."""
    upto = Window.partitionBy("model", "period").orderBy("release_date")
    events = fx.fact_events(spark, d).groupBy("model", "period", "release_date").agg(fx.wide_sum("amount").alias("amount"))
    facts = events.select("model", F.lit("TOTAL").alias("series_id"), "period", "release_date", (fx.money(F.sum("amount").over(upto)) / 1000000).alias("value"))
    known = asof.value_as_of(facts, fx.schedule(spark, d))
    target = F.add_months(cal.quarter_start("quarter"), 2)
    pairs = fx.pairs(spark, d)
    cells = asof.pair_vintages(fx.schedule(spark, d), known, fx.available_vintages(spark, d)).drop("vintage_old", "series_id")
    cells = cells.withColumn("t", ss.month_number(F.col("period")))
    first = facts.groupBy("model").agg(F.min(ss.month_number(F.col("period"))).alias("first"))
    steps = pairs.select("model", "quarter", "vintage", ss.month_number(target).alias("last")).join(first, "model")
    steps = steps.withColumn("t", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return steps.join(cells.drop("period"), ["model", "quarter", "vintage", "t"], "left")


UPDATE = ["model", "quarter", "vintage"]

_VIEWS = f"""
WITH RECURSIVE total AS (SELECT model, period, release_date, sum(amount) AS amount FROM fact_events GROUP BY 1, 2, 3),
known AS (SELECT model, period, release_date, CAST(sum(amount) OVER (PARTITION BY model, period ORDER BY release_date) AS DOUBLE) / 1000000 AS value FROM total),
steps AS (SELECT p.model, p.quarter, p.vintage_old, p.vintage, CAST(first AS DATE) AS first, CAST(s.q_start + INTERVAL 2 MONTH AS DATE) AS last
  FROM pairs p JOIN (SELECT DISTINCT quarter, q_start FROM schedule) s ON s.quarter = p.quarter JOIN (SELECT model, min(period) AS first FROM known GROUP BY 1) f ON f.model = p.model),
grid AS (SELECT model, quarter, vintage_old, vintage, CAST(unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS DATE) AS period FROM steps),
cells AS (SELECT g.model, g.quarter, g.vintage, g.period, CAST(row_number() OVER (PARTITION BY g.model, g.quarter, g.vintage ORDER BY g.period) AS INTEGER) AS n,
    max(value) FILTER (release_date <= vintage_old) AS old, max(value) FILTER (release_date <= g.vintage) AS new
  FROM grid g LEFT JOIN known k ON k.model = g.model AND k.period = g.period AND k.release_date <= g.vintage GROUP BY 1, 2, 3, 4),
views AS (SELECT *, 'old' AS view, old AS x FROM cells UNION ALL SELECT *, 'rev', CASE WHEN old IS NOT NULL THEN new END FROM cells UNION ALL SELECT *, 'new', new FROM cells),
k AS (
  SELECT DISTINCT model, quarter, vintage, view, 0 AS n, CAST(0 AS DOUBLE) AS a, CAST(1e6 AS DOUBLE) AS p FROM views
  UNION ALL
  SELECT k.model, k.quarter, k.vintage, k.view, d.n, CASE WHEN x IS NULL THEN a ELSE a + (p + 4) / (p + 4 + 25) * (x - a) END,
    CASE WHEN x IS NULL THEN p + 4 ELSE (p + 4) * 25 / (p + 4 + 25) END
  FROM k JOIN views d ON d.model = k.model AND d.quarter = k.quarter AND d.vintage = k.vintage AND d.view = k.view AND d.n = k.n + 1),
ends AS (SELECT model, quarter, vintage, max(a) FILTER (view = 'old') AS y_old, max(a) FILTER (view = 'rev') AS y_rev, max(a) FILTER (view = 'new') AS y_new
  FROM (SELECT *, max(n) OVER (PARTITION BY model, quarter, vintage) AS steps FROM k) WHERE n = steps GROUP BY 1, 2, 3)"""


@query("model_news", _VIEWS + """
SELECT e.model, e.quarter, e.vintage, y_old, y_rev, y_new, y_rev - y_old AS impact_revisions, y_new - y_rev AS impact_releases,
  count(*) FILTER (old <> new) AS revisions, count(*) FILTER (old IS NULL AND new IS NOT NULL) AS releases
FROM ends e JOIN cells c ON c.model = e.model AND c.quarter = e.quarter AND c.vintage = e.vintage GROUP BY ALL""",
       "y_old y_rev y_new impact_revisions impact_releases")
def model_news(spark, d):
    """Updates of each model's level at the end of the target quarter; both impacts are sums over single cells.

    The oracle takes them from whole filters of the three views instead.
    """
    return ss.level_news(total_cells(spark, d), UPDATE, F.col("t"), 4.0, 25.0)[0]


@query("model_news_gaps", "SELECT model, quarter, count(*) AS checked, CAST(0 AS BIGINT) AS gaps FROM pairs GROUP BY 1, 2")
def model_news_gaps(spark, d):
    """Old figure, revisions and releases of the model add up to its new figure in every update."""
    return news.check_decomposition(ss.level_news(total_cells(spark, d), UPDATE, F.col("t"), 4.0, 25.0)[0])
