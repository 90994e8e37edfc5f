"""Queries over factor-model building blocks."""

from pyspark.sql import functions as F

from tidemark.operators import factor, score
from tidemark.storage import materialise
from workload import fixtures as fx
from workload.registry import query

KEYS = ["model", "vintage", "series_id"]


def stored_z(spark, d):
    """The standardised panel, stored: a covariance reads it twice."""
    return materialise(fx.panel_z(spark, d), "panel_z")


def lags(spark, d):
    return factor.factor_lags(fx.mean_factor(fx.panel_z(spark, d)))


@query("panel_gram", """
SELECT a.model, a.vintage, a.series_id AS series_i, b.series_id AS series_j, count(*) AS n,
  covar_samp(a.z, b.z) AS cov
FROM panel_z a JOIN panel_z b ON b.model = a.model AND b.vintage = a.vintage AND b.period = a.period
  AND a.series_id <= b.series_id
WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2, 3, 4""", "cov")
def panel_gram(spark, d):
    return factor.panel_gram(stored_z(spark, d))


def _power_sql(source: str, by: str) -> str:
    """Leading eigenvectors by squaring matrices of lists, shifted to be positive; signed to a non-negative sum.

    ``source`` has the key columns ``by``, series_id, period and z; one covariance matrix per key.
    """
    keys = by.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    same = " AND ".join(f"e.{k} = s.{k}" for k in keys)
    a = ", ".join(f"a.{k}" for k in keys)
    s = ", ".join(f"s.{k}" for k in keys)
    return f"""
WITH RECURSIVE src AS (SELECT * FROM ({source}) WHERE z IS NOT NULL),
entries AS (SELECT {a}, a.series_id AS i, b.series_id AS j, coalesce(covar_samp(a.z, b.z), 0) AS v
  FROM src a JOIN src b ON {on} AND a.period = b.period GROUP BY ALL),
names AS (SELECT {by}, list(DISTINCT i ORDER BY i) AS ids FROM entries GROUP BY {by}),
cells AS (SELECT {s}, x.i, y.j FROM names s, LATERAL (SELECT unnest(s.ids) AS i) x, LATERAL (SELECT unnest(s.ids) AS j) y),
full_rows AS (SELECT {s}, s.i, list(coalesce(v, 0) ORDER BY s.j) AS g
  FROM cells s LEFT JOIN entries e ON {same} AND e.i = s.i AND e.j = s.j GROUP BY {s}, s.i),
mats AS (SELECT {by}, list(i ORDER BY i) AS ids, list(g ORDER BY i) AS g FROM full_rows GROUP BY {by}),
shifted AS (SELECT {by}, ids, list_transform(range(len(g)), lambda a: list_transform(range(len(g)),
    lambda b: g[a + 1][b + 1] + CASE WHEN a = b THEN list_max(list_transform(g, lambda r: list_sum(list_transform(r, lambda x: abs(x))))) ELSE 0 END)) AS m
  FROM mats),
it AS (
  SELECT {by}, ids, 0 AS n, m FROM shifted
  UNION ALL
  SELECT {by}, ids, n + 1, list_transform(w, lambda r: list_transform(r, lambda x: x / nullif(list_sum(list_transform(range(len(w)), lambda k: w[k + 1][k + 1])), 0)))
  FROM (SELECT {by}, ids, n, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) AS w FROM it WHERE n < 16)),
picked AS (SELECT {by}, ids, m[list_position(list_transform(range(len(m)), lambda k: round(m[k + 1][k + 1], 9)),
    list_max(list_transform(range(len(m)), lambda k: round(m[k + 1][k + 1], 9))))] AS c FROM it WHERE n = 16),
done AS (SELECT {by}, ids, list_transform(c, lambda x: CASE WHEN round(list_sum(c), 9) < 0 THEN -1 ELSE 1 END * x / nullif(sqrt(list_dot_product(c, c)), 0)) AS v FROM picked)
SELECT {by}, unnest(ids) AS series_id, unnest(v) AS loading FROM done"""


_LOADINGS = _power_sql("SELECT model, vintage, series_id, period, z FROM panel_z", "model, vintage")
_BLOCKS = """SELECT z.model, z.vintage, b.block, z.series_id, z.period, z.z FROM panel_z z JOIN (
  SELECT model, series_id, unnest(['Global', replace(category, ' ', '')]) AS block FROM spec_t) b
  ON b.model = z.model AND b.series_id = z.series_id"""
BLOCK = ["model", "vintage", "block"]


@query("first_factor_loadings", _LOADINGS, "loading")
def first_factor_loadings(spark, d):
    return factor.leading_vector(factor.panel_gram(stored_z(spark, d)))


def _deflated_sql(r: int) -> str:
    """The first ``r`` eigenvectors of (model, vintage), each by squaring what the ones before it leave."""
    head, tail = _LOADINGS.split("shifted AS (")
    parts, rows = [head + "m1 AS (SELECT model, vintage, ids, g FROM mats)"], []
    step = "shifted AS (" + tail[: tail.index("SELECT model, vintage, unnest(ids)")]
    for k in range(1, r + 1):
        names = {"shifted": f"s{k}", "FROM mats": f"FROM m{k}", "FROM it ": f"FROM it{k} ", "it AS (": f"it{k} AS (", "picked": f"p{k}", "done": f"d{k}"}
        sql = step.rstrip()
        for a, b in names.items():
            sql = sql.replace(a, b)
        image = "list_transform(g, lambda row: list_dot_product(row, v))"
        parts.append(sql)
        parts.append(f"""l{k} AS (SELECT d.model, d.vintage, d.ids, v, g, list_dot_product(v, {image}) AS value
  FROM d{k} d JOIN m{k} m ON m.model = d.model AND m.vintage = d.vintage)""")
        parts.append(f"""m{k + 1} AS (SELECT model, vintage, ids, list_transform(range(len(g)), lambda a: list_transform(range(len(g)),
    lambda b: g[a + 1][b + 1] - value * v[a + 1] * v[b + 1])) AS g FROM l{k})""")
        rows.append(f"SELECT model, vintage, CAST({k} AS INTEGER) AS factor, unnest(ids) AS series_id, unnest(v) AS loading, value FROM l{k}")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


@query("factor_loadings", _deflated_sql(3), "loading value")
def factor_loadings(spark, d):
    """Three factors of every panel by subspace iteration."""
    return factor.leading_vectors(factor.panel_gram(stored_z(spark, d)), 3)


@query("first_factor_scores", f"""
SELECT z.model, z.vintage, z.block, z.period, sum(z.z * l.loading) AS f
FROM ({_BLOCKS}) z JOIN ({_power_sql(_BLOCKS, "model, vintage, block")}) l
  ON l.model = z.model AND l.vintage = z.vintage AND l.block = z.block AND l.series_id = z.series_id
GROUP BY 1, 2, 3, 4""", "f")
def first_factor_scores(spark, d):
    """The first factor of every block."""
    z = materialise(factor.in_blocks(stored_z(spark, d), fx.spec(spark, d)), "blocks")
    return factor.first_factor(z, by=BLOCK)[1]


@query("first_factor_variance", f"""
SELECT l.model, l.vintage, count(*) AS n, sum(l.loading * l.loading) AS norm,
  (SELECT count(*) FROM panel_z q WHERE q.model = l.model AND q.vintage = l.vintage AND q.z IS NOT NULL) AS cells
FROM ({_LOADINGS}) l GROUP BY 1, 2""", "norm")
def first_factor_variance(spark, d):
    """Unit length of the leading vector, beside the size of its panel."""
    z = stored_z(spark, d)
    v = factor.leading_vector(factor.panel_gram(z)).groupBy("model", "vintage").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("loading") * F.col("loading")).alias("norm")
    )
    return v.join(z.groupBy("model", "vintage").agg(F.count("z").alias("cells")), ["model", "vintage"])


@query("factor_lags", "SELECT * FROM lags", "f f0 f1 f2 f3 f4")
def factor_lags(spark, d):
    return lags(spark, d)


@query("restricted_loadings", """
SELECT model, vintage, series_id, b, b AS c0, 2 * b AS c1, 3 * b AS c2, 2 * b AS c3, b AS c4 FROM tent_loadings""",
       "b c0 c1 c2 c3 c4")
def restricted_loadings(spark, d):
    quarterly = fx.panel_z(spark, d).where(F.col("frequency") == "q")
    return factor.restricted_loadings(quarterly, lags(spark, d))


@query("ar1", "SELECT model, vintage, series_id, n, b, residual_variance FROM ar_fits", "b residual_variance")
def ar1(spark, d):
    return factor.ar1(fx.panel_z(spark, d), KEYS, "z")


@query("block_residuals", """
SELECT z.model, z.vintage, z.series_id, z.period, z.z,
  z.z - coalesce(c1 * f1 + c2 * f2 + c3 * f3 + c4 * f4 + c0 * f0, 0) AS residual
FROM panel_z z
LEFT JOIN simple_loadings s ON s.model = z.model AND s.vintage = z.vintage AND s.series_id = z.series_id
LEFT JOIN (SELECT * FROM lags WHERE f4 IS NOT NULL) l
  ON l.model = z.model AND l.vintage = z.vintage AND l.period = z.period""", "z residual")
def block_residuals(spark, d):
    z = fx.panel_z(spark, d)
    lagged = factor.factor_lags(fx.mean_factor(z))
    out = factor.block_residuals(z, fx.simple_loadings(z, lagged), lagged)
    return out.select(*KEYS, "period", "z", "residual")


def _chain_sql() -> str:
    """Two waves: the global block, then the regional ones on its residuals."""
    key, same = "model, vintage, block", "a.model = b.model AND a.vintage = b.vintage AND a.block = b.block"
    parts = ["z0 AS (SELECT model, vintage, series_id, period, frequency, z, z AS r FROM panel_z)"]
    for k, block in ((1, "'Global'"), (2, "replace(category, ' ', '')")):
        lags = ", ".join(f"lag(f, {n}) OVER w AS f{n}" for n in range(1, 5))
        parts += [
            f"m{k} AS (SELECT z.model, z.vintage, {block} AS block, z.series_id, z.period, z.frequency, z.r AS z FROM z{k - 1} z JOIN spec_t s ON s.model = z.model AND s.series_id = z.series_id)",
            f"v{k} AS ({_power_sql(f"SELECT {key}, series_id, period, z FROM m{k} WHERE frequency = 'm'", key)})",
            f"f{k} AS (SELECT a.model, a.vintage, a.block, a.period, sum(a.z * b.loading) AS f FROM m{k} a JOIN v{k} b ON {same} AND a.series_id = b.series_id GROUP BY ALL)",
            f"g{k} AS (SELECT *, f AS f0, f + 2 * f1 + 3 * f2 + 2 * f3 + f4 AS tent FROM (SELECT {key}, period, f, {lags} FROM f{k} WINDOW w AS (PARTITION BY {key} ORDER BY period)) WHERE f4 IS NOT NULL)",
            f"q{k} AS (SELECT a.model, a.vintage, a.block, a.series_id, CASE WHEN count(z) >= 7 THEN sum(z * tent) / nullif(sum(CASE WHEN z IS NOT NULL THEN tent * tent END), 0) END AS c FROM m{k} a JOIN g{k} b ON {same} AND a.period = b.period WHERE frequency = 'q' GROUP BY ALL)",
            f"c{k} AS (SELECT {key}, series_id, loading AS c0, 0 AS c1, 0 AS c2 FROM v{k} UNION ALL SELECT {key}, series_id, c, 2 * c, 3 * c FROM q{k})",
            f"""t{k} AS (SELECT a.model, a.vintage, a.series_id, a.period,
    coalesce(CASE WHEN a.frequency = 'm' THEN c0 * f0 + 0 * (f1 + f2 + f3 + f4) ELSE c0 * (f0 + f4) + c1 * (f1 + f3) + c2 * f2 END, 0) AS fit
  FROM m{k} a JOIN c{k} b ON {same} AND a.series_id = b.series_id JOIN g{k} g ON g.model = a.model AND g.vintage = a.vintage AND g.block = a.block AND g.period = a.period)""",
            f"z{k} AS (SELECT z.* REPLACE (z.r - coalesce(fit, 0) AS r) FROM z{k - 1} z LEFT JOIN t{k} t ON t.model = z.model AND t.vintage = z.vintage AND t.series_id = z.series_id AND t.period = z.period)",
        ]
    return "WITH " + ",\n".join(parts) + "\nSELECT model, vintage, series_id, period, z, r AS residual FROM z2"


@query("block_chain", _chain_sql(), "z residual")
def block_chain(spark, d):
    """What the global factor and then the regional ones leave of every series."""
    z = stored_z(spark, d).select(*KEYS, "period", "frequency", "z")
    return factor.block_chain(z, fx.spec(spark, d), fx.BLOCKS)[0].drop("frequency")


@query("em_converged", """
SELECT model, est_vintage, iteration, loglik, change, coalesce(iteration >= 4 AND change < 0.01, false) AS converged,
  coalesce(loglik - before < -1e-3, false) AS decreased
FROM (SELECT *, abs(loglik - before) / nullif((abs(loglik) + abs(before)) / 2, 0) AS change
      FROM (SELECT *, lag(loglik) OVER (PARTITION BY model, est_vintage ORDER BY iteration) AS before
            FROM (SELECT model, quarter AS est_vintage, y_new AS loglik,
                    CAST(row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS iteration
                  FROM nowcast_a)))""", "loglik change")
def em_converged(spark, d):
    """The rule on a stand-in trace: the weekly nowcasts of each quarter."""
    trace = score.week_index(fx.nowcast(spark, d)).select(
        "model", F.col("quarter").alias("est_vintage"), F.col("week").alias("iteration"),
        F.col("y_new").alias("loglik"),
    )
    return factor.em_converged(trace, 0.01)


def local_level_sql(source: str, by: str) -> str:
    """The filter with variances 4 and 25 as a recursion over the rows of ``source`` in order of period."""
    k = ", ".join(f"k.{c}" for c in by.split(", "))
    on = " AND ".join(f"d.{c} = k.{c}" for c in by.split(", "))
    return f"""
WITH RECURSIVE numbered AS (
  SELECT {by}, value, CAST(row_number() OVER (PARTITION BY {by} ORDER BY period) AS INTEGER) AS n FROM {source}),
k AS (
  SELECT DISTINCT {by}, 0 AS n, CAST(0 AS DOUBLE) AS a, CAST(1e6 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll, 0 AS hits FROM numbered
  UNION ALL
  SELECT {k}, d.n,
    CASE WHEN value IS NULL THEN a ELSE a + (p + 4) / (p + 4 + 25) * (value - a) END,
    CASE WHEN value IS NULL THEN p + 4 ELSE (p + 4) * 25 / (p + 4 + 25) END,
    CASE WHEN value IS NULL THEN ll
      ELSE ll - 0.5 * (ln(p + 4 + 25) + (value - a) * (value - a) / (p + 4 + 25)) END,
    CASE WHEN value IS NULL THEN hits ELSE hits + 1 END
  FROM k JOIN numbered d ON {on} AND d.n = k.n + 1)
SELECT {by}, a AS level, p AS variance, ll AS loglik, hits AS observations
FROM k WHERE n = (SELECT max(n) FROM numbered)"""


@query("local_level", local_level_sql("dense", "model, vintage, series_id"), "level variance loglik")
def local_level(spark, d):
    return factor.local_level(fx.dense(spark, d), 4.0, 25.0)


# ---------------------------------------------------------------- parameter tables


@query("monthly_loading_table", """
SELECT model, est_vintage, series_id, coalesce(sum(v) FILTER (j = 0), 0) AS "global",
  coalesce(sum(v) FILTER (j = 5), 0) AS africa, coalesce(sum(v) FILTER (j = 10), 0) AS america,
  coalesce(sum(v) FILTER (j = 15), 0) AS asia, coalesce(sum(v) FILTER (j = 20), 0) AS europe,
  coalesce(sum(v) FILTER (j = 25), 0) AS middleeast
FROM param_c WHERE frequency = 'm' AND j % 5 = 0 GROUP BY 1, 2, 3""",
       "global africa america asia europe middleeast")
def monthly_loading_table(spark, d):
    monthly, _ = factor.loading_tables(fx.simple_params(spark, d), fx.spec(spark, d), fx.BLOCKS)
    return monthly.toDF(*[c.lower() for c in monthly.columns])


@query("quarterly_loading_table", """
SELECT model, est_vintage, series_id, coalesce(sum(v) FILTER (j = 0), 0) AS f1_lag0,
  coalesce(sum(v) FILTER (j = 1), 0) AS f1_lag1, coalesce(sum(v) FILTER (j = 2), 0) AS f1_lag2,
  coalesce(sum(v) FILTER (j = 3), 0) AS f1_lag3, coalesce(sum(v) FILTER (j = 4), 0) AS f1_lag4
FROM param_c WHERE frequency = 'q' AND j < 5 GROUP BY 1, 2, 3""", "f1_lag0 f1_lag1 f1_lag2 f1_lag3 f1_lag4")
def quarterly_loading_table(spark, d):
    return factor.loading_tables(fx.simple_params(spark, d), fx.spec(spark, d), fx.BLOCKS)[1]


@query("factor_ar_table", """
SELECT model, vintage AS est_vintage, 0 AS state, coalesce(b, 0) AS ar, residual_variance
FROM factor_ar WHERE residual_variance IS NOT NULL""", "ar residual_variance")
def factor_ar_table(spark, d):
    return factor.ar_tables(fx.simple_params(spark, d), len(fx.BLOCKS))[0]


@query("idiosyncratic_ar_table", """
SELECT a.model, a.vintage AS est_vintage, CASE WHEN p.i < 20 THEN 30 + p.i ELSE 50 + 5 * (p.i - 20) END AS state,
  coalesce(a.b, 0) AS ar, a.residual_variance
FROM ar_fits a JOIN place p ON p.model = a.model AND p.series_id = a.series_id
WHERE a.residual_variance IS NOT NULL""", "ar residual_variance")
def idiosyncratic_ar_table(spark, d):
    return factor.ar_tables(fx.simple_params(spark, d), len(fx.BLOCKS))[1]


def commons(spark, d, params=None):
    params = fx.simple_params(spark, d) if params is None else params
    states = lags(spark, d).unpivot(
        ["model", "vintage", "period"], factor.LAG_NAMES, "name", "state"
    ).select(
        "model", F.col("vintage").alias("est_vintage"), "period",
        F.substring("name", 2, 1).cast("int").alias("j"), "state",
    ).where(F.col("state").isNotNull())
    return factor.common_component(params, states, fx.spec(spark, d), 5)


@query("common_component", "SELECT * FROM common_units", "common_z common")
def common_component(spark, d):
    return commons(spark, d)


_SPLIT = """SELECT c.model, c.est_vintage, c.series_id, c.period, x.value AS total, c.common,
  x.value - c.common AS residual, c.common / nullif(x.value, 0) AS share_common,
  (x.value - c.common) / nullif(x.value, 0) AS share_residual
FROM common_units c JOIN panel_x x ON x.model = c.model AND x.vintage = c.est_vintage
  AND x.series_id = c.series_id AND x.period = c.period"""


def split(spark, d, params=None):
    observed = fx.panel_x(spark, d).withColumnRenamed("vintage", "est_vintage")
    return factor.common_and_residual(commons(spark, d, params), observed)


@query("common_and_residual", _SPLIT, "total common residual share_common share_residual")
def common_and_residual(spark, d):
    return split(spark, d)


@query("component_contributions", f"""
WITH w AS (
  SELECT o.model, o.est_vintage, o.series_id, sum(o.v * t.v) AS weight
  FROM param_c o JOIN param_c t ON t.model = o.model AND t.est_vintage = o.est_vintage AND t.j = o.j
  WHERE t.series_id = 'NATION_12' AND o.series_id <> 'NATION_12' AND o.j < 30 GROUP BY 1, 2, 3),
s AS (SELECT w.model, w.est_vintage, coalesce(c.category, 'Other') AS category, sum(weight) AS weight,
        sum(sum(weight)) OVER (PARTITION BY w.model, w.est_vintage) AS all_weight
      FROM w LEFT JOIN categories c ON c.series_id = w.series_id GROUP BY 1, 2, 3),
r AS (SELECT * FROM ({_SPLIT}) WHERE series_id = 'NATION_12')
SELECT s.model, s.est_vintage, r.period, r.total, r.common, r.residual, s.category, s.weight,
  coalesce(s.weight / nullif(s.all_weight, 0), 0) AS share_common,
  r.common * coalesce(s.weight / nullif(s.all_weight, 0), 0) AS contribution
FROM s JOIN r ON r.model = s.model AND r.est_vintage = s.est_vintage""",
       "total common residual weight share_common contribution")
def component_contributions(spark, d):
    params = fx.simple_params(spark, d)
    target = split(spark, d, params).where(F.col("series_id") == "NATION_12").select(
        "model", "est_vintage", "period", "total", "common", "residual"
    )
    return factor.component_contributions(
        params, fx.spec(spark, d), "NATION_12", fx.categories(spark, d), target, 30
    )


@query("component_share", """
SELECT model, category, sum(weight) AS weight,
  coalesce(sum(weight) / nullif(sum(sum(weight)) OVER (PARTITION BY model), 0), 0) AS share_common
FROM (SELECT w.model, w.weight, coalesce(c.category, 'Other') AS category
      FROM region_weights w LEFT JOIN categories c ON c.series_id = w.series_id)
GROUP BY 1, 2""", "weight share_common")
def component_share(spark, d):
    weights = factor.with_category(fx.region_weights(spark, d), fx.categories(spark, d))
    return factor.component_share(weights, ["model"])
