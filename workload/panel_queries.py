"""Queries over the static panel: selection, calendar, transformation, gaps, summaries."""

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.labels import transformed_unit, transformation_name
from tidemark.operators import panel
from tidemark.sources import files
from workload import fixtures as fx
from workload.registry import query

SPEC_COLUMNS = ["series_id", "series_name", "frequency", "units", "transformation", "category", "spec_pos"]


@query("spec_parse", "SELECT model, series_id, series_name, frequency, units, transformation, category, "
       "'Global,' || replace(category, ' ', '') AS blocks, spec_pos FROM spec_t")
def spec_parse(spark, d):
    return fx.spec(spark, d).withColumn("blocks", F.array_join("blocks", ","))


@query("spec_order", "SELECT series_id, frequency, spec_pos FROM spec_one")
def spec_order(spark, d):
    one = files.parse_spec(fx.raw_spec(spark, d), "x", "Position")
    return one.select("series_id", "frequency", "spec_pos")


@query("spec_unit_labels", """
SELECT model, series_id, CASE
  WHEN units = 'Index' THEN 'Index'
  WHEN transformation = 'chg' AND units LIKE '%\\%%' ESCAPE '\\' THEN 'Ppt. change'
  WHEN transformation = 'chg' THEN 'Level change'
  WHEN transformation = 'pch' AND frequency = 'm' THEN 'MoM %'
  WHEN transformation = 'pca' AND frequency = 'q' THEN 'QoQ AR %'
  ELSE units || ' [' || transformation || ']' END AS unit,
  CASE transformation WHEN 'lin' THEN 'Levels (No Transformation)' WHEN 'chg' THEN 'Change (Difference)'
   WHEN 'ch1' THEN 'Year over Year Change (Difference)' WHEN 'pch' THEN 'Percent Change'
   WHEN 'pc1' THEN 'Year over Year Percent Change' WHEN 'pca' THEN 'Percent Change (Annual Rate)'
   WHEN 'cch' THEN 'Continuously Compounded Rate of Change'
   WHEN 'cca' THEN 'Continuously Compounded Annual Rate of Change' ELSE 'Natural Log' END AS long_name
FROM spec_t""")
def spec_unit_labels(spark, d):
    return fx.spec(spark, d).select(
        "model", "series_id", transformed_unit().alias("unit"), transformation_name().alias("long_name")
    )


@query("block_table", """
SELECT model, series_id, 1 AS "global", CAST(category = 'AFRICA' AS INTEGER) AS africa,
  CAST(category = 'AMERICA' AS INTEGER) AS america, CAST(category = 'ASIA' AS INTEGER) AS asia,
  CAST(category = 'EUROPE' AS INTEGER) AS europe, CAST(category = 'MIDDLE EAST' AS INTEGER) AS middleeast
FROM spec_t""")
def block_table(spark, d):
    from tidemark.operators.factor import block_table as table

    out = table(fx.spec(spark, d), ["Global", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLEEAST"])
    return out.toDF(*[c.lower() for c in out.columns])


@query("panel_from_orders", "SELECT * FROM obs", "value")
def panel_from_orders(spark, d):
    return fx.obs(spark, d)


def series_names(spark, d) -> list[str]:
    """Names of all series: one for each row of the nation table."""
    return sorted(r["n_name"] for r in fx.table(spark, d, "nation").select("n_name").distinct().collect())


@query("wide_vintage_to_long", """
SELECT p.model, p.vintage, s.n_name AS series_id, p.period, o.value
FROM (SELECT DISTINCT model, vintage, period FROM obs) p CROSS JOIN (SELECT DISTINCT n_name FROM nation) s
LEFT JOIN obs o ON o.model = p.model AND o.vintage = p.vintage AND o.period = p.period AND o.series_id = s.n_name""", "value")
def wide_vintage_to_long(spark, d):
    """Every cell of the wide panel, the empty ones too."""
    wide = panel.obs_wide(fx.obs(spark, d), series_names(spark, d)).withColumnRenamed("period", "Date")
    return files.wide_to_long(wide, ["model", "vintage"])


# The oracle has to name its columns: the nations of the driver's table.
_NATIONS = [f"NATION_{k}" for k in range(25)]


@query("panel_wide", f"""
SELECT model, vintage, period, {", ".join(f"max(value) FILTER (series_id = '{n}') AS {n.lower()}" for n in _NATIONS)}
FROM obs GROUP BY 1, 2, 3""", " ".join(n.lower() for n in _NATIONS))
def panel_wide(spark, d):
    out = panel.obs_wide(fx.obs(spark, d), series_names(spark, d))
    return out.toDF(*[c.lower() for c in out.columns])


@query("keep_spec_series", """
SELECT o.*, s.spec_pos FROM obs o JOIN spec_t s ON s.model = o.model AND s.series_id = o.series_id
WHERE s.category <> 'ASIA'""", "value")
def keep_spec_series(spark, d):
    spec = fx.spec(spark, d).where(F.col("category") != "ASIA")
    return panel.keep_spec_series(fx.obs(spark, d), spec).select(
        "model", "vintage", "series_id", "period", "value", "spec_pos"
    )


@query("attach_spec", """
SELECT o.*, s.frequency, s.transformation
FROM obs o JOIN spec_t s ON s.model = o.model AND s.series_id = o.series_id""", "value")
def attach_spec(spark, d):
    return panel.with_spec(fx.obs(spark, d), fx.spec(spark, d))


@query("data_window", "SELECT * FROM obs WHERE period BETWEEN DATE '1997-01-01' AND vintage", "value")
def data_window(spark, d):
    return panel.data_window(fx.obs(spark, d), "1997-01-01")


@query("dense_monthly", "SELECT * FROM dense", "value")
def dense_monthly(spark, d):
    return fx.dense(spark, d)


@query("extend_horizon", """
SELECT * FROM dense UNION ALL
SELECT s.model, s.vintage, s.series_id, CAST(s.hi + h.k * INTERVAL 1 MONTH AS DATE), CAST(NULL AS DOUBLE)
FROM (SELECT model, vintage, series_id, max(period) AS hi FROM dense GROUP BY 1, 2, 3) s
JOIN (SELECT unnest(generate_series(1, 12)) AS k) h ON true""", "value")
def extend_horizon(spark, d):
    return panel.extend_horizon(fx.obs(spark, d))


@query("transform_all", "SELECT model, vintage, series_id, period, transformation, x FROM transformed", "x")
def transform_all(spark, d):
    return fx.transformed(spark, d).select("model", "vintage", "series_id", "period", "transformation", "x")


_CODE_SQL = """
SELECT model, vintage, series_id, period, x FROM (
  SELECT *, CASE WHEN {guard} THEN {formula} END AS x FROM lagged)"""

_FORMULAS = {
    "lin": ("true", "value"),
    "chg": ("on_grid", "value - prev"),
    "ch1": ("on_grid", "value - year_ago"),
    "pch": ("on_grid", "100 * (value / nullif(prev, 0) - 1)"),
    "pc1": ("on_grid", "100 * (value / nullif(year_ago, 0) - 1)"),
    "pca": ("on_grid", "100 * (pow(value / nullif(prev, 0), 12 / step) - 1)"),
    "log": ("value > 0", "ln(value)"),
    "cch": ("on_grid AND value > 0 AND prev > 0", "100 * (ln(value) - ln(prev))"),
    "cca": ("on_grid AND value > 0 AND prev > 0", "100 * (ln(value) - ln(prev)) * 12 / step"),
}
_ON_GRID = "(frequency = 'm' OR month(period) % 3 = 0)"


def _register_code(code: str, guard: str, formula: str) -> None:
    sql = _CODE_SQL.format(guard=guard.replace("on_grid", _ON_GRID), formula=formula)

    @query(f"transform_{code}", sql, "x")
    def run(spark, d):
        spec = fx.spec(spark, d).withColumn("transformation", F.lit(code))
        grid = panel.dense_monthly(panel.with_spec(fx.obs(spark, d), spec))
        return panel.transform_series(grid).select("model", "vintage", "series_id", "period", "x")


for _code, (_guard, _formula) in _FORMULAS.items():
    _register_code(_code, _guard, _formula)


def panel_x(spark, d):
    out = panel.drop_initial(fx.transformed(spark, d), 3)
    return out.select("model", "vintage", "series_id", "period", F.col("x").alias("value"), "frequency")


def panel_z(spark, d):
    return panel.standardise(panel_x(spark, d))


@query("drop_initial", "SELECT model, vintage, series_id, period, value FROM panel_x", "value")
def drop_initial(spark, d):
    return panel_x(spark, d).drop("frequency")


@query("sample_from", """
SELECT model, vintage, series_id, period, value FROM panel_x WHERE period >= DATE '1998-01-01'""", "value")
def sample_from(spark, d):
    return panel.sample_from(panel_x(spark, d), "1998-01-01").drop("frequency")


@query("standardise", "SELECT model, vintage, series_id, period, value, mx, wx, z FROM panel_z", "value mx wx z")
def standardise(spark, d):
    return panel_z(spark, d).drop("frequency")


@query("destandardise", "SELECT model, vintage, series_id, period, wx * z + mx AS x FROM panel_z", "x")
def destandardise(spark, d):
    stats = panel.scale_stats(panel_x(spark, d))
    return panel.destandardise(panel_z(spark, d), stats).select(
        "model", "vintage", "series_id", "period", "x"
    )


@query("trim_sparse_edges", """
SELECT x.model, x.vintage, x.series_id, x.period, x.value FROM panel_x x JOIN (
  SELECT model, vintage, min(period) FILTER (NOT gone) AS lo, max(period) FILTER (NOT gone) AS hi FROM (
    SELECT model, vintage, period, count(*) - count(value) > 0.8 * count(*) AS gone
    FROM panel_x GROUP BY 1, 2, 3)
  GROUP BY 1, 2) e ON e.model = x.model AND e.vintage = x.vintage
WHERE x.period BETWEEN e.lo AND e.hi""", "value")
def trim_sparse_edges(spark, d):
    return panel.trim_edges(panel_x(spark, d), 0.8).drop("frequency").select(
        "model", "vintage", "series_id", "period", "value"
    )


@query("trim_empty_edges", """
SELECT x.model, x.vintage, x.series_id, x.period, x.value FROM panel_x x JOIN (
  SELECT model, vintage, min(period) AS lo, max(period) AS hi FROM panel_x
  WHERE value IS NOT NULL GROUP BY 1, 2) e ON e.model = x.model AND e.vintage = x.vintage
WHERE x.period BETWEEN e.lo AND e.hi""", "value")
def trim_empty_edges(spark, d):
    return panel.trim_edges(panel_x(spark, d), 1.0).select(
        "model", "vintage", "series_id", "period", "value"
    )


def _linear_sql(source: str) -> str:
    return f"""
SELECT model, vintage, series_id, period, was_missing,
  CASE WHEN ta = tb THEN va WHEN ta IS NOT NULL AND tb IS NOT NULL
       THEN va + (vb - va) / (tb - ta) * (t - ta) END AS value
FROM (SELECT *, value IS NULL AS was_missing,
        last_value(value IGNORE NULLS) OVER back AS va, last_value(tv IGNORE NULLS) OVER back AS ta,
        first_value(value IGNORE NULLS) OVER ahead AS vb, first_value(tv IGNORE NULLS) OVER ahead AS tb
      FROM (SELECT *, year(period) * 12 + month(period) AS t,
              CASE WHEN value IS NOT NULL THEN year(period) * 12 + month(period) END AS tv FROM {source})
      WINDOW back AS (PARTITION BY model, vintage, series_id ORDER BY period
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS (PARTITION BY model, vintage, series_id ORDER BY period
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _smooth_sql(source: str, keep: str = "was_missing") -> str:
    """Median for the remaining holes of ``source``, then the moving average over them."""
    return f"""
SELECT model, vintage, series_id, period, {keep},
  CASE WHEN hole THEN (sum(v) OVER near + greatest(0, 4 - n) * head + greatest(0, 3 - (cnt - n)) * tail) / 7
       ELSE v END AS value
FROM (SELECT *, first_value(v) OVER whole AS head, last_value(v) OVER whole AS tail,
        row_number() OVER (PARTITION BY model, vintage, series_id ORDER BY period) AS n,
        count(*) OVER (PARTITION BY model, vintage, series_id) AS cnt
      FROM (SELECT *, value IS NULL AS hole,
              coalesce(value, median(value) OVER (PARTITION BY model, vintage, series_id)) AS v
            FROM ({source}))
      WINDOW whole AS (PARTITION BY model, vintage, series_id ORDER BY period
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WINDOW near AS (PARTITION BY model, vintage, series_id ORDER BY period
                ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


def _cubic_sql(source: str) -> str:
    """Not-a-knot spline of every series: a forward and a backward pass over its knots."""
    key = "model, vintage, series_id"
    on = "ON b.model = a.model AND b.vintage = a.vintage AND b.series_id = a.series_id"
    return f"""
WITH RECURSIVE grid AS (
  SELECT model, vintage, series_id, period, value, value IS NULL AS was_missing, year(period) * 12 + month(period) AS t FROM {source}),
steps AS (
  SELECT *, lead(t) OVER w - t AS h, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS s,
    CAST(row_number() OVER w AS INTEGER) - 1 AS k, CAST(count(*) OVER (PARTITION BY {key}) AS INTEGER) AS n
  FROM grid WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY t)),
around AS (SELECT *, lag(h) OVER w AS p, lag(s) OVER w AS sp FROM steps WINDOW w AS (PARTITION BY {key} ORDER BY t)),
eqs AS (
  SELECT *, 6 * (s - sp) AS r,
    CASE WHEN k = 1 THEN 0.0 WHEN k = n - 2 THEN p - h * h / p ELSE p END AS lo,
    CASE WHEN n = 3 THEN 3.0 * (p + h) ELSE 2.0 * (p + h) + CASE WHEN k = 1 THEN p * (p + h) / h ELSE 0 END
      + CASE WHEN k = n - 2 THEN h * (p + h) / p ELSE 0 END END AS mid,
    CASE WHEN k = n - 2 THEN 0.0 WHEN k = 1 THEN h - p * p / h ELSE h END AS up
  FROM around WHERE k BETWEEN 1 AND n - 2),
fore AS (
  SELECT {key}, k, n, up / mid AS c, r / mid AS d FROM eqs WHERE k = 1
  UNION ALL
  SELECT a.model, a.vintage, a.series_id, b.k, b.n, b.up / (b.mid - b.lo * a.c), (b.r - b.lo * a.d) / (b.mid - b.lo * a.c)
  FROM fore a JOIN eqs b {on} AND b.k = a.k + 1),
back AS (
  SELECT {key}, k, n, d AS m FROM fore WHERE k = n - 2
  UNION ALL
  SELECT a.model, a.vintage, a.series_id, b.k, b.n, b.d - b.c * a.m FROM back a JOIN fore b {on} AND b.k = a.k - 1),
ends AS (
  SELECT a.model, a.vintage, a.series_id, a.k, a.t, a.value AS y, a.h, a.n, b.m, x.m AS m1, y.m AS m2, u.m AS w1, v.m AS w2,
    f.h AS h0, f2.h AS h1, g.h AS g0, g2.h AS g1
  FROM steps a LEFT JOIN back b {on} AND b.k = a.k
  LEFT JOIN back x ON x.model = a.model AND x.vintage = a.vintage AND x.series_id = a.series_id AND x.k = 1
  LEFT JOIN back y ON y.model = a.model AND y.vintage = a.vintage AND y.series_id = a.series_id AND y.k = 2
  LEFT JOIN back u ON u.model = a.model AND u.vintage = a.vintage AND u.series_id = a.series_id AND u.k = a.n - 2
  LEFT JOIN back v ON v.model = a.model AND v.vintage = a.vintage AND v.series_id = a.series_id AND v.k = a.n - 3
  LEFT JOIN steps f ON f.model = a.model AND f.vintage = a.vintage AND f.series_id = a.series_id AND f.k = 0
  LEFT JOIN steps f2 ON f2.model = a.model AND f2.vintage = a.vintage AND f2.series_id = a.series_id AND f2.k = 1
  LEFT JOIN steps g ON g.model = a.model AND g.vintage = a.vintage AND g.series_id = a.series_id AND g.k = a.n - 2
  LEFT JOIN steps g2 ON g2.model = a.model AND g2.vintage = a.vintage AND g2.series_id = a.series_id AND g2.k = a.n - 3),
bends AS (
  SELECT {key}, k, t, y, h, CASE WHEN n < 3 THEN 0.0 WHEN n = 3 THEN m1 WHEN k = 0 THEN ((h0 + h1) * m1 - h0 * m2) / h1
    WHEN k = n - 1 THEN ((g1 + g0) * w1 - g0 * w2) / g1 ELSE m END AS m FROM ends),
spans AS (SELECT *, lead(t) OVER w AS t1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM bends WINDOW w AS (PARTITION BY {key} ORDER BY t))
SELECT g.model, g.vintage, g.series_id, g.period, g.was_missing, CASE WHEN g.value IS NOT NULL THEN g.value WHEN z.t IS NOT NULL THEN
  (z.t1 - g.t) / z.h * z.y + (g.t - z.t) / z.h * z.y1
  + ((pow((z.t1 - g.t) / z.h, 3) - (z.t1 - g.t) / z.h) * z.m + (pow((g.t - z.t) / z.h, 3) - (g.t - z.t) / z.h) * z.m1) * z.h * z.h / 6 END AS value
FROM grid g LEFT JOIN spans z ON z.model = g.model AND z.vintage = g.vintage AND z.series_id = g.series_id AND g.t > z.t AND g.t < z.t1"""


@query("interpolate_linear", f"SELECT model, vintage, series_id, period, value FROM ({_linear_sql('dense')})", "value")
def interpolate_linear(spark, d):
    return panel.interpolate_linear(fx.dense(spark, d))


@query("interpolate_cubic", f"SELECT model, vintage, series_id, period, value FROM ({_cubic_sql('dense')})", "value")
def interpolate_cubic(spark, d):
    return panel.interpolate_cubic(fx.dense(spark, d))


_CUBIC_LINE = "(0.002 * u * u * u - 0.3 * u * u + 4 * u - 7)"
_KNOTS = """SELECT model, vintage, series_id, period, value IS NULL AS hole, CAST(year(period) * 12 + month(period) - 23960 AS DOUBLE) AS u,
  min(period) FILTER (value IS NOT NULL) OVER s AS lo, max(period) FILTER (value IS NOT NULL) OVER s AS hi,
  count(value) OVER s AS n FROM dense WINDOW s AS (PARTITION BY model, vintage, series_id)"""


@query("cubic_reproduces_polynomial", f"""
SELECT model, vintage, series_id, period, CASE WHEN period BETWEEN lo AND hi THEN {_CUBIC_LINE} END AS value
FROM ({_KNOTS}) WHERE n >= 4""", "value")
def cubic_reproduces_polynomial(spark, d):
    """With the panel's holes in a cubic of the month number, every filled month must lie on the cubic again."""
    u = (cal.month_index("period") - 23960).cast("double")
    grid = fx.dense(spark, d)
    many = grid.groupBy("model", "vintage", "series_id").agg(F.count("value").alias("n")).where("n >= 4")
    line = 0.002 * u * u * u - 0.3 * u * u + 4 * u - 7
    holed = grid.withColumn("value", F.when(F.col("value").isNotNull(), line))
    return panel.interpolate_cubic(holed).join(many.drop("n"), ["model", "vintage", "series_id"])


@query("fill_median", """
SELECT model, vintage, series_id, period,
  coalesce(value, median(value) OVER (PARTITION BY model, vintage, series_id)) AS value FROM dense""", "value")
def fill_median(spark, d):
    return panel.fill_median(fx.dense(spark, d))


@query("smooth_filled", _smooth_sql("SELECT *, value IS NULL AS was_missing FROM dense"), "value")
def smooth_filled(spark, d):
    marked = fx.dense(spark, d).withColumn("was_missing", F.col("value").isNull())
    return panel.smooth_filled(panel.fill_median(marked), "was_missing")


_TRIMMED_80 = """(SELECT d.* FROM dense d JOIN (
  SELECT model, vintage, min(period) FILTER (NOT gone) AS lo, max(period) FILTER (NOT gone) AS hi FROM (
    SELECT model, vintage, period, count(*) - count(value) > 0.8 * count(*) AS gone
    FROM dense GROUP BY 1, 2, 3) GROUP BY 1, 2) e ON e.model = d.model AND e.vintage = d.vintage
WHERE d.period BETWEEN e.lo AND e.hi)"""
_TRIMMED_ALL = """(SELECT d.* FROM dense d JOIN (
  SELECT model, vintage, min(period) AS lo, max(period) AS hi FROM dense WHERE value IS NOT NULL
  GROUP BY 1, 2) e ON e.model = d.model AND e.vintage = d.vintage
WHERE d.period BETWEEN e.lo AND e.hi)"""

_METHODS = {
    1: _smooth_sql("SELECT *, value IS NULL AS was_missing FROM dense"),
    2: _smooth_sql(_linear_sql(_TRIMMED_80)),
    3: f"SELECT *, value IS NULL AS was_missing FROM {_TRIMMED_ALL}",
    4: _smooth_sql(_linear_sql(_TRIMMED_ALL)),
    5: _smooth_sql(_linear_sql("dense")),
}


def _register_method(method: int, sql: str) -> None:
    @query(f"fill_method_{method}", sql, "value")
    def run(spark, d):
        return panel.fill_missing(fx.dense(spark, d), method)


for _method, _sql in _METHODS.items():
    _register_method(_method, _sql)


@query("fill_method_2_cubic", _smooth_sql(_cubic_sql(_TRIMMED_80)), "value")
def fill_method_2_cubic(spark, d):
    return panel.fill_missing(fx.dense(spark, d), 2, interpolation="cubic")


@query("summarise_series", """
SELECT x.model, x.vintage, x.series_id, count(value) AS observations,
  min(period) FILTER (value IS NOT NULL) AS first_period, max(period) FILTER (value IS NOT NULL) AS last_period,
  avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min_value,
  arg_min(period, (value, period)) FILTER (value IS NOT NULL) AS min_period,
  arg_max(period, (value, -epoch(period))) FILTER (value IS NOT NULL) AS max_period,
  any_value(s.frequency) AS frequency, any_value(s.spec_pos) AS spec_pos,
  any_value(CASE WHEN units = 'Index' THEN 'Index'
    WHEN transformation = 'chg' AND contains(units, '%') THEN 'Ppt. change'
    WHEN transformation = 'chg' THEN 'Level change'
    WHEN transformation = 'pch' AND s.frequency = 'm' THEN 'MoM %'
    WHEN transformation = 'pca' AND s.frequency = 'q' THEN 'QoQ AR %'
    ELSE units || ' [' || transformation || ']' END) AS unit
FROM panel_x x JOIN spec_t s ON s.model = x.model AND s.series_id = x.series_id
GROUP BY 1, 2, 3""", "mean sd min_value")
def summarise_series(spark, d):
    return panel.summarise_series(panel_x(spark, d), fx.spec(spark, d))


@query("panel_header", """
SELECT model, vintage, count(DISTINCT series_id) AS n_series, count(DISTINCT period) AS n_periods,
  min(period) AS first_period, max(period) AS last_period FROM panel_x GROUP BY 1, 2""")
def panel_header(spark, d):
    return panel.panel_header(panel_x(spark, d))


@query("observation_range", """
SELECT model, vintage, series_id, min(period) FILTER (value IS NOT NULL) AS first_period,
  max(period) FILTER (value IS NOT NULL) AS last_period FROM panel_x GROUP BY 1, 2, 3""")
def observation_range(spark, d):
    return panel.observation_range(panel_x(spark, d))


@query("extreme_dates", """
SELECT model, vintage, series_id, arg_min(period, (value, period)) AS min_period,
  arg_max(period, (value, -epoch(period))) AS max_period
FROM panel_x WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def extreme_dates(spark, d):
    return panel.extreme_dates(panel_x(spark, d))


@query("standardised_growth_summary", """
SELECT model, series_id, count(z) AS observations, avg(z) AS mean, stddev_samp(z) AS sd, min(z) AS lo, max(z) AS hi
FROM (SELECT *, (x - avg(x) OVER s) / nullif(stddev_samp(x) OVER s, 0) AS z
      FROM (SELECT *, CASE WHEN frequency = 'm' OR month(period) % 3 = 0
                           THEN 100 * (value / nullif(prev, 0) - 1) END AS x FROM lagged)
      WINDOW s AS (PARTITION BY model, vintage, series_id))
GROUP BY 1, 2""", "mean sd lo hi")
def standardised_growth_summary(spark, d):
    """Flagship: monthly order value by nation, growth, standardised, summarised."""
    spec = fx.spec(spark, d).withColumn("transformation", F.lit("pch"))
    grid = panel.dense_monthly(panel.with_spec(fx.obs(spark, d), spec))
    z = panel.standardise(panel.transform_series(grid), "x")
    return z.groupBy("model", "series_id").agg(
        F.count("z").alias("observations"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"),
        F.min("z").alias("lo"), F.max("z").alias("hi"),
    )


# ---------------------------------------------------------------- calendar


@query("monthly_last_value", """
SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
  arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS o_totalprice
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2""")
def monthly_last_value(spark, d):
    return panel.to_monthly_last(fx.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice")


@query("quarter_to_third_month", """
SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE) AS period FROM orders""")
def quarter_to_third_month(spark, d):
    raw = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("period"))
    return panel.quarter_to_third_month(raw)


@query("target_month", """
SELECT quarter, CAST(q_start + INTERVAL 2 MONTH AS DATE) AS quarter_target,
  CAST(q_start AS DATE) AS month_target FROM quarters""")
def target_month(spark, d):
    month = F.concat(F.substring("quarter", 1, 4), F.lit("m"), F.month(cal.quarter_start("quarter")))
    return fx.quarters(spark, d).select(
        "quarter",
        cal.checked_target_month("quarter", F.lit("2001-07-01").cast("date")).alias("quarter_target"),
        cal.target_month(month).alias("month_target"),
    )


@query("weekly_calendar", """
SELECT o_custkey, first_day, last_day, count(friday) AS fridays, min(friday) AS first_friday, max(friday) AS last_friday
FROM (SELECT r.*, CAST(d AS DATE) AS friday
      FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day,
              max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY 1) r
      LEFT JOIN (SELECT unnest(generate_series(DATE '1994-01-07', DATE '2003-01-03', INTERVAL 7 DAY)) AS d) w
        ON w.d BETWEEN r.first_day AND r.last_day)
GROUP BY 1, 2, 3""")
def weekly_calendar(spark, d):
    day = F.col("o_orderdate").cast("date")
    spans = fx.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    weeks = spans.withColumn("w", cal.fridays_between("first_day", "last_day"))
    return weeks.select(
        "o_custkey", "first_day", "last_day", F.size("w").cast("bigint").alias("fridays"),
        F.array_min("w").alias("first_friday"), F.array_max("w").alias("last_friday"),
    )


@query("last_fridays", """
SELECT m, CAST(max(d) AS DATE) AS last_friday
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
JOIN (SELECT unnest(generate_series(DATE '1994-01-07', DATE '2003-01-03', INTERVAL 7 DAY)) AS d)
  ON date_trunc('month', d) = m
GROUP BY m""")
def last_fridays(spark, d):
    months = fx.table(spark, d, "orders").select(cal.month_start(F.col("o_orderdate").cast("date")).alias("m"))
    return months.distinct().select("m", cal.last_friday(F.year("m"), F.month("m")).alias("last_friday"))


@query("tracking_schedule", "SELECT quarter, vintage FROM schedule")
def tracking_schedule(spark, d):
    return fx.schedule(spark, d)


@query("chart_windows", """
SELECT quarter, max(w) FILTER (date_trunc('month', w) = q_start - INTERVAL 2 MONTH) AS window_start,
  max(w) FILTER (date_trunc('month', w) = q_start + INTERVAL 3 MONTH) AS window_end,
  CAST(q_start + INTERVAL 4 MONTH - INTERVAL 1 DAY AS DATE) AS published
FROM quarters
JOIN (SELECT CAST(unnest(generate_series(DATE '1994-01-07', DATE '2003-01-03', INTERVAL 7 DAY)) AS DATE) AS w) ON true
GROUP BY quarter, q_start""")
def chart_windows(spark, d):
    from tidemark.operators.asof import chart_windows as windows

    return windows(fx.quarters(spark, d))
