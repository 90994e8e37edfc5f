"""SQL side of the test panels: the same derivations as ``fixtures`` for the oracle engine."""

TABLES: dict[str, str] = {}

TABLES["raw_spec"] = """
SELECT n_nationkey AS position, 1 AS model_flag, n_name AS series_id,
       'Orders of ' || n_name AS series_name,
       CASE WHEN n_nationkey % 6 = 0 THEN 'q' ELSE 'm' END AS frequency,
       CASE n_nationkey % 3 WHEN 0 THEN 'Index' WHEN 1 THEN '% rate' ELSE 'USD' END AS units,
       CASE n_nationkey % 9 WHEN 0 THEN 'lin' WHEN 1 THEN 'chg' WHEN 2 THEN 'ch1' WHEN 3 THEN 'pch'
            WHEN 4 THEN 'pc1' WHEN 5 THEN 'pca' WHEN 6 THEN 'cch' WHEN 7 THEN 'cca' ELSE 'log' END
            AS transformation,
       r_name AS category
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

TABLES["spec_one"] = """
SELECT series_id, series_name, frequency, units, transformation, category,
       CAST(row_number() OVER (ORDER BY CASE frequency WHEN 'm' THEN 3 ELSE 4 END, position) AS INTEGER)
       AS spec_pos
FROM raw_spec
"""

TABLES["segments"] = "SELECT DISTINCT c_mktsegment AS model FROM customer"

TABLES["spec_t"] = """
SELECT model, spec_one.*
FROM (SELECT DISTINCT c_mktsegment AS model, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
JOIN spec_one ON series_id = name
"""

TABLES["order_span"] = """
SELECT CAST(date_trunc('month', max(CAST(o_orderdate AS DATE)) + 1) AS DATE) AS month_end
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

TABLES["order_cells"] = """
SELECT c_mktsegment AS model, n_name AS series_id,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE CAST(o_orderdate AS DATE) < (SELECT month_end FROM order_span)
GROUP BY 1, 2, 3
"""

TABLES["obs"] = """
SELECT model, (SELECT CAST(month_end + CAST((12 - isodow(month_end)) % 7 AS INTEGER) AS DATE) FROM order_span) AS vintage, series_id, period,
       100 + CAST(sum(amount) AS DOUBLE) / 10000 AS value
FROM (SELECT c.model, c.series_id, c.amount,
             CASE WHEN s.frequency = 'q'
                  THEN CAST(date_trunc('quarter', c.month) + INTERVAL 2 MONTH AS DATE)
                  ELSE c.month END AS period
      FROM order_cells c JOIN spec_t s ON s.model = c.model AND s.series_id = c.series_id)
WHERE period < (SELECT month_end FROM order_span)
GROUP BY 1, 2, 3, 4
"""

TABLES["grid_months"] = """
SELECT model, vintage, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE)
       AS period
FROM obs GROUP BY model, vintage
"""

TABLES["dense"] = """
SELECT g.model, g.vintage, s.series_id, g.period, o.value
FROM grid_months g
JOIN (SELECT DISTINCT model, vintage, series_id FROM obs) s
  ON s.model = g.model AND s.vintage = g.vintage
LEFT JOIN obs o ON o.model = g.model AND o.vintage = g.vintage
  AND o.series_id = s.series_id AND o.period = g.period
"""

TABLES["lagged"] = """
SELECT d.*, s.frequency, s.transformation,
       CASE WHEN s.frequency = 'm' THEN 1 ELSE 3 END AS step,
       CASE WHEN s.frequency = 'm' THEN lag(value, 1) OVER w ELSE lag(value, 3) OVER w END AS prev,
       lag(value, 12) OVER w AS year_ago,
       row_number() OVER w AS n
FROM dense d JOIN spec_t s ON s.model = d.model AND s.series_id = d.series_id
WINDOW w AS (PARTITION BY d.model, d.vintage, d.series_id ORDER BY d.period)
"""

TABLES["transformed"] = """
SELECT *, CASE
  WHEN transformation = 'lin' THEN value
  WHEN transformation = 'log' THEN CASE WHEN value > 0 THEN ln(value) END
  WHEN frequency = 'q' AND month(period) % 3 <> 0 THEN NULL
  WHEN transformation = 'chg' THEN value - prev
  WHEN transformation = 'ch1' THEN value - year_ago
  WHEN transformation = 'pch' THEN 100 * (value / nullif(prev, 0) - 1)
  WHEN transformation = 'pc1' THEN 100 * (value / nullif(year_ago, 0) - 1)
  WHEN transformation = 'pca' THEN 100 * (pow(value / nullif(prev, 0), 12 / step) - 1)
  WHEN transformation = 'cch' THEN CASE WHEN value > 0 AND prev > 0 THEN 100 * (ln(value) - ln(prev)) END
  WHEN transformation = 'cca' THEN CASE WHEN value > 0 AND prev > 0
       THEN 100 * (ln(value) - ln(prev)) * 12 / step END
END AS x
FROM lagged
"""

TABLES["panel_x"] = """
SELECT model, vintage, series_id, period, x AS value, frequency
FROM transformed WHERE n > 3
"""

TABLES["panel_z"] = """
SELECT *, (value - mx) / nullif(wx, 0) AS z
FROM (SELECT *, avg(value) OVER s AS mx, stddev_samp(value) OVER s AS wx FROM panel_x
      WINDOW s AS (PARTITION BY model, vintage, series_id))
"""

TABLES["fact_events"] = """
SELECT model, series_id, period,
       CAST(known + CAST((12 - isodow(known)) % 7 AS INTEGER) AS DATE) AS release_date, sum(net) AS amount
FROM (SELECT c_mktsegment AS model, n_name AS series_id,
             CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
             greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS known,
             CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
GROUP BY 1, 2, 3, 4
"""

TABLES["facts"] = """
SELECT model, series_id, period, release_date,
       CAST(sum(amount) OVER (PARTITION BY model, series_id, period ORDER BY release_date) AS DOUBLE) / 100000
       AS value
FROM fact_events
"""

TABLES["fact_versions"] = """
SELECT *, lead(release_date) OVER (PARTITION BY model, series_id, period ORDER BY release_date) AS next_release
FROM facts
"""

TABLES["fact_span"] = """
SELECT date_trunc('quarter', min(day)) AS first_quarter, date_trunc('quarter', date_trunc('month', max(day) + 1)) AS open_quarter
FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

TABLES["quarters"] = """
SELECT DISTINCT year(period) || '_q' || quarter(period) AS quarter, CAST(date_trunc('quarter', period) AS DATE) AS q_start
FROM fact_events, fact_span
WHERE date_trunc('quarter', period) > first_quarter AND date_trunc('quarter', period) < open_quarter
"""

TABLES["schedule"] = """
SELECT quarter, q_start, CAST(last_friday - k * INTERVAL 7 DAY AS DATE) AS vintage
FROM (SELECT quarter, q_start, month_end - CAST((isodow(month_end) + 2) % 7 AS INTEGER) AS last_friday
      FROM (SELECT *, CAST(q_start + INTERVAL 4 MONTH - INTERVAL 1 DAY AS DATE) AS month_end FROM quarters))
JOIN (SELECT unnest(generate_series(0, 21)) AS k) ON true
"""

TABLES["vintage_obs"] = """
SELECT f.model, v.vintage, f.series_id, f.period, f.value
FROM fact_versions f JOIN (SELECT DISTINCT vintage FROM schedule) v
  ON v.vintage >= f.release_date AND (f.next_release IS NULL OR v.vintage < f.next_release)
"""

TABLES["available"] = """
SELECT DISTINCT model, release_date AS vintage FROM fact_events
WHERE ((release_date - DATE '1970-01-02') // 7 + length(model)) % 19 <> 7
"""

TABLES["pairs"] = """
SELECT p.*, s.model FROM (
  SELECT quarter, vintage, lag(vintage) OVER (PARTITION BY quarter ORDER BY vintage) AS vintage_old
  FROM schedule) p
JOIN available s ON s.vintage = p.vintage
JOIN available t ON t.vintage = p.vintage_old AND t.model = s.model
"""

TABLES["new_side"] = """
SELECT p.model, p.quarter, p.vintage_old, p.vintage, o.series_id, o.period, o.value
FROM pairs p JOIN vintage_obs o ON o.model = p.model AND o.vintage = p.vintage
"""

TABLES["old_side"] = """
SELECT p.model, p.quarter, p.vintage_old, p.vintage, o.series_id, o.period, o.value
FROM pairs p JOIN vintage_obs o ON o.model = p.model AND o.vintage = p.vintage_old
"""

TABLES["cell_pairs"] = """
SELECT model, quarter, vintage_old, vintage, series_id, period, o.value AS old, n.value AS new
FROM new_side n FULL JOIN old_side o
  USING (model, quarter, vintage_old, vintage, series_id, period)
"""

TABLES["changed_cells"] = """
SELECT * FROM cell_pairs WHERE old IS DISTINCT FROM new
"""

TABLES["quarter_totals"] = """
SELECT model, year(period) || '_q' || quarter(period) AS quarter,
       CAST(date_trunc('quarter', period) AS DATE) AS q_start, release_date, sum(amount) AS amount
FROM fact_events GROUP BY 1, 2, 3, 4
"""

TABLES["finals"] = """
SELECT model, quarter, q_start, sum(amount) AS amount FROM quarter_totals GROUP BY 1, 2, 3
"""

TABLES["actuals"] = """
SELECT f.model, f.quarter, 100 * (CAST(f.amount AS DOUBLE) / CAST(p.amount AS DOUBLE) - 1) AS actual
FROM finals f JOIN finals p ON p.model = f.model AND p.q_start = f.q_start - INTERVAL 3 MONTH
WHERE f.quarter IN (SELECT quarter FROM quarters)
"""

TABLES["estimates"] = """
SELECT model, quarter, vintage, y AS y_a,
       y * (0.5 + 0.5 * greatest(0, least(vintage - q_start, len)) / len) AS y_b
FROM (SELECT a.model, a.quarter, a.vintage, a.q_start,
             CAST(a.q_start + INTERVAL 3 MONTH AS DATE) - a.q_start AS len,
             100 * (CAST(a.cur AS DOUBLE) / CAST(a.prev AS DOUBLE) - 1) AS y
      FROM (SELECT s.model, c.quarter, c.q_start, c.vintage,
                   coalesce(sum(t.amount) FILTER (t.q_start = c.q_start), 0) AS cur,
                   coalesce(sum(t.amount) FILTER (t.q_start < c.q_start), 0) AS prev
            FROM schedule c, segments s
            LEFT JOIN quarter_totals t ON t.model = s.model AND t.release_date <= c.vintage
              AND t.q_start BETWEEN c.q_start - INTERVAL 3 MONTH AND c.q_start
            GROUP BY 1, 2, 3, 4) a
      WHERE a.prev > 0)
"""

TABLES["variants"] = """
SELECT *, row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS n FROM estimates
"""

_SCORED = """
SELECT r.model, r.quarter, r.vintage, y_old, y_new,
       actual - y_new AS error, abs(actual - y_new) AS abs_error,
       (actual - y_new) / nullif(actual, 0) AS perc_error,
       (1 + date_diff('day', DATE '1970-01-02', CAST(r.vintage AS DATE)) // 7 % 4) / 8 * (y_new - y_old) AS impact_revisions,
       (7 - date_diff('day', DATE '1970-01-02', CAST(r.vintage AS DATE)) // 7 % 4) / 8 * (y_new - y_old) AS impact_releases,
       ((y_new - y_old) / 2) * ((y_new - y_old) / 2) AS step_variance,
       CASE WHEN r.vintage < q.q_start THEN 'prev' ELSE 'curr' END AS params_used
FROM (SELECT model, quarter, vintage, {y} AS y_new,
             lag({y}) OVER (PARTITION BY model, quarter ORDER BY vintage) AS y_old
      FROM variants {where}) r
JOIN actuals a ON a.model = r.model AND a.quarter = r.quarter
JOIN quarters q ON q.quarter = r.quarter
WHERE y_old IS NOT NULL
"""

TABLES["nowcast_a"] = _SCORED.format(y="y_a", where="")
TABLES["nowcast_b"] = _SCORED.format(y="y_b", where="WHERE NOT (n = 5 AND quarter LIKE '%q1')")

TABLES["metrics_a"] = """
SELECT model, quarter, sqrt(avg(error * error)) AS rmse, avg(abs_error) AS mae, avg(error) AS bias,
       avg(perc_error) * 100 AS mpe
FROM nowcast_a GROUP BY model, quarter
"""

TABLES["final_a"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY model, quarter ORDER BY vintage DESC) AS back FROM nowcast_a)
WHERE back = 1
"""

TABLES["first_releases"] = """
SELECT model, series_id, period, min(release_date) AS vintage,
       CAST(arg_min(amount, release_date) AS DOUBLE) / 100000 AS actual
FROM fact_events GROUP BY 1, 2, 3
"""

TABLES["region_weights"] = """
SELECT DISTINCT e.model, e.series_id,
       CAST(sum(e.amount) OVER (PARTITION BY e.model, s.category) AS DOUBLE)
       / CAST(sum(e.amount) OVER (PARTITION BY e.model) AS DOUBLE) AS weight
FROM (SELECT model, series_id, sum(amount) AS amount FROM fact_events GROUP BY 1, 2) e
JOIN spec_t s ON s.model = e.model AND s.series_id = e.series_id
"""

TABLES["forecasts"] = """
SELECT *, avg(actual) OVER (PARTITION BY model, series_id ORDER BY period
                            ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS forecast
FROM first_releases
"""

TABLES["news"] = """
SELECT f.model, s.quarter, f.vintage, f.series_id, f.period, f.forecast, f.actual, w.weight,
       w.weight * (f.actual - f.forecast) AS impact
FROM forecasts f JOIN schedule s ON s.vintage = f.vintage
JOIN region_weights w ON w.model = f.model AND w.series_id = f.series_id
"""

TABLES["categories"] = """
SELECT n_name AS series_id, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA'
"""

TABLES["news_cat"] = """
SELECT n.*, coalesce(c.category, 'Other') AS category
FROM news n LEFT JOIN categories c ON c.series_id = n.series_id
"""

TABLES["mean_factor"] = """
SELECT model, vintage, period, avg(z) AS f FROM panel_z GROUP BY 1, 2, 3
"""

TABLES["lags"] = """
SELECT *, f AS f0, lag(f, 1) OVER w AS f1, lag(f, 2) OVER w AS f2, lag(f, 3) OVER w AS f3, lag(f, 4) OVER w AS f4
FROM mean_factor WINDOW w AS (PARTITION BY model, vintage ORDER BY period)
"""

TABLES["tents"] = """
SELECT model, vintage, period, f0 + 2 * f1 + 3 * f2 + 2 * f3 + f4 AS tent FROM lags WHERE f4 IS NOT NULL
"""

TABLES["tent_loadings"] = """
SELECT z.model, z.vintage, z.series_id, CASE WHEN count(z) >= 7
  THEN sum(z * tent) / nullif(sum(tent * tent) FILTER (z IS NOT NULL), 0) END AS b
FROM panel_z z JOIN tents t ON t.model = z.model AND t.vintage = z.vintage AND t.period = z.period
WHERE z.frequency = 'q' GROUP BY 1, 2, 3
"""

TABLES["simple_loadings"] = """
SELECT z.model, z.vintage, z.series_id, sum(z * f) / nullif(sum(f * f) FILTER (z IS NOT NULL), 0) AS c0,
  CAST(0 AS DOUBLE) AS c1, CAST(0 AS DOUBLE) AS c2, CAST(0 AS DOUBLE) AS c3, CAST(0 AS DOUBLE) AS c4
FROM panel_z z JOIN mean_factor m ON m.model = z.model AND m.vintage = z.vintage AND m.period = z.period
WHERE z.frequency = 'm' GROUP BY 1, 2, 3
UNION ALL SELECT model, vintage, series_id, b, 2 * b, 3 * b, 2 * b, b FROM tent_loadings
"""

TABLES["ar_fits"] = """
SELECT *, (sq - total * total / n) / nullif(n - 1, 0) AS residual_variance
FROM (SELECT *, sx - b * sl AS total, sxx - 2 * b * sxl + b * b * sll AS sq
      FROM (SELECT model, vintage, series_id, count(*) AS n, sum(x) AS sx, sum(l) AS sl, sum(x * x) AS sxx,
              sum(x * l) AS sxl, sum(l * l) AS sll, sum(x * l) / nullif(sum(l * l), 0) AS b
            FROM (SELECT *, z AS x, lag(z) OVER (PARTITION BY model, vintage, series_id ORDER BY period) AS l
                  FROM panel_z)
            WHERE x IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2, 3))
"""

TABLES["factor_ar"] = """
SELECT model, vintage, count(*) AS n, sum(x * l) / nullif(sum(l * l), 0) AS b,
  var_samp(x) - 2 * (sum(x * l) / nullif(sum(l * l), 0)) * covar_samp(x, l)
  + (sum(x * l) / nullif(sum(l * l), 0)) * (sum(x * l) / nullif(sum(l * l), 0)) * var_samp(l) AS residual_variance
FROM (SELECT model, vintage, f AS x, lag(f) OVER (PARTITION BY model, vintage ORDER BY period) AS l FROM mean_factor)
WHERE x IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2
"""

TABLES["place"] = """
SELECT model, series_id, spec_pos - 1 AS i, category, frequency,
  CASE category WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 4 ELSE 5 END AS b
FROM spec_t
"""

TABLES["param_c"] = """
SELECT l.model, l.vintage AS est_vintage, p.series_id, p.i, p.frequency, p.category, j, v FROM (
  SELECT model, vintage, series_id, 0 AS j, c0 AS v FROM simple_loadings
  UNION ALL SELECT model, vintage, series_id, 1, c1 FROM simple_loadings
  UNION ALL SELECT model, vintage, series_id, 2, c2 FROM simple_loadings
  UNION ALL SELECT model, vintage, series_id, 3, c3 FROM simple_loadings
  UNION ALL SELECT model, vintage, series_id, 4, c4 FROM simple_loadings
  UNION ALL SELECT s.model, vintage, s.series_id, 5 * q.b, c0 / 2 FROM simple_loadings s
    JOIN place q ON q.model = s.model AND q.series_id = s.series_id) l
JOIN place p ON p.model = l.model AND p.series_id = l.series_id
"""

TABLES["all_params"] = """
SELECT model, est_vintage, 'C' AS name, i, j, v FROM param_c
UNION ALL SELECT a.model, a.vintage, e.name, k, k, CASE WHEN e.name = 'A' THEN a.b ELSE a.residual_variance END
FROM (SELECT r.*, CASE WHEN p.i < 20 THEN 30 + p.i ELSE 50 + 5 * (p.i - 20) END AS k
      FROM ar_fits r JOIN place p ON p.model = r.model AND p.series_id = r.series_id) a, (VALUES ('A'), ('Q')) AS e(name)
UNION ALL SELECT f.model, f.vintage, e.name, 0, 0, CASE WHEN e.name = 'A' THEN f.b ELSE f.residual_variance END
FROM factor_ar f, (VALUES ('A'), ('Q')) AS e(name)
UNION ALL SELECT z.model, z.vintage, e.name, p.i, 0, CASE WHEN e.name = 'Mx' THEN z.mx ELSE z.wx END
FROM (SELECT DISTINCT model, vintage, series_id, mx, wx FROM panel_z) z
JOIN place p ON p.model = z.model AND p.series_id = z.series_id, (VALUES ('Mx'), ('Wx')) AS e(name)
"""

TABLES["commons"] = """
SELECT c.model, c.est_vintage, c.series_id, l.period, sum(c.v * l.state) AS common_z
FROM param_c c JOIN (
  SELECT model, vintage, period, CAST(replace(name, 'f', '') AS INTEGER) AS j, state
  FROM (SELECT model, vintage, period, f0, f1, f2, f3, f4 FROM lags)
  UNPIVOT (state FOR name IN (f0, f1, f2, f3, f4))) l
  ON l.model = c.model AND l.vintage = c.est_vintage AND l.j = c.j
WHERE c.j < 5 GROUP BY 1, 2, 3, 4
"""

TABLES["common_units"] = """
SELECT c.*, s.wx * c.common_z + s.mx AS common
FROM commons c JOIN (SELECT DISTINCT model, vintage, series_id, mx, wx FROM panel_z) s
  ON s.model = c.model AND s.vintage = c.est_vintage AND s.series_id = c.series_id
"""
