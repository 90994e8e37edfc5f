"""Queries over scored nowcasts and news: accuracy, bias, impacts, comparison of models."""

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import compare, impact, reshape, score
from tidemark.plans import reports
from tidemark.sources import files
from tidemark.storage import materialise
from workload import fixtures as fx
from workload.registry import query

YEAR = fx.EXCLUDED_YEAR
SERIES = fx.EXTENDED_ONLY
ROW = "y_old y_new error abs_error perc_error impact_revisions impact_releases step_variance"
IS_YEAR = f"substr(quarter, 1, 4) = '{YEAR}'"


def metrics(spark, d):
    return score.accuracy(fx.nowcast(spark, d))


# ---------------------------------------------------------------- filters and scoring


@query("score", "SELECT * FROM nowcast_a", ROW)
def score_query(spark, d):
    return fx.nowcast(spark, d)


@query("with_actual", "SELECT n.*, a.actual FROM nowcast_b n JOIN actuals a USING (model, quarter)", ROW + " actual")
def with_actual(spark, d):
    return score.with_actual(fx.nowcast(spark, d, "b"), fx.actuals(spark, d))


@query("exclude_years", f"SELECT * FROM nowcast_a WHERE NOT {IS_YEAR}", ROW)
def exclude_years(spark, d):
    return score.exclude_years(fx.nowcast(spark, d), [YEAR])


@query("year_range", "SELECT * FROM nowcast_a WHERE CAST(substr(quarter, 1, 4) AS INTEGER) BETWEEN 1997 AND 1999", ROW)
def year_range(spark, d):
    return score.year_range(fx.nowcast(spark, d), 1997, 1999)


@query("mask_periods", f"""
SELECT * REPLACE (CASE WHEN NOT {IS_YEAR} THEN y_new END AS y_new, CASE WHEN NOT {IS_YEAR} THEN error END AS error)
FROM nowcast_a""", ROW)
def mask_periods(spark, d):
    return score.mask_periods(fx.nowcast(spark, d), ["y_new", "error"], cal.label_year("quarter") == YEAR)


@query("recover_actual", "SELECT model, quarter, y_new + error AS actual FROM final_a", "actual")
def recover_actual(spark, d):
    return score.recover_actual(fx.nowcast(spark, d))


# ---------------------------------------------------------------- windows


@query("week_index", """
SELECT *, CAST(row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS week FROM nowcast_a""", ROW)
def week_index(spark, d):
    return score.week_index(fx.nowcast(spark, d))


@query("final_rows", "SELECT * EXCLUDE (back) FROM final_a", ROW)
def final_rows(spark, d):
    return score.final_rows(fx.nowcast(spark, d))


@query("final_vs_actual", f"""
SELECT model, quarter, CAST(q_start + INTERVAL 4 MONTH - INTERVAL 1 DAY AS DATE) AS published,
  CASE WHEN NOT {IS_YEAR} THEN y_new END AS final_nowcast, CASE WHEN NOT {IS_YEAR} THEN y_new + error END AS actual
FROM final_a JOIN quarters USING (quarter)""", "final_nowcast actual")
def final_vs_actual(spark, d):
    return score.final_vs_actual(fx.nowcast(spark, d), [YEAR])


@query("nowcast_changes", "SELECT model, quarter, vintage, y_new - y_old AS change, step_variance FROM nowcast_a",
       "change step_variance")
def nowcast_changes(spark, d):
    return score.nowcast_changes(fx.nowcast(spark, d))


@query("chain_breaks", """
SELECT * FROM (SELECT *, lag(y_new) OVER (PARTITION BY model, quarter ORDER BY vintage) AS previous_y_new
  FROM (SELECT n.* FROM nowcast_a n JOIN available a ON a.model = n.model AND a.vintage = n.vintage))
WHERE abs(y_old - previous_y_new) > 1e-9""", ROW + " previous_y_new")
def chain_breaks(spark, d):
    """Breaks left where a model's vintage was lost."""
    kept = fx.nowcast(spark, d).join(fx.available_vintages(spark, d), ["model", "vintage"], "left_semi")
    return score.chain_breaks(kept)


@query("error_paths", """
SELECT model, quarter, CAST(row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS week,
  vintage, error, abs_error FROM nowcast_a""", "error abs_error")
def error_paths(spark, d):
    return score.error_paths(fx.nowcast(spark, d))


@query("tracking_dates", """
SELECT n.model, n.quarter, n.vintage, CAST(first_friday + CAST(7 * (row_number() OVER (PARTITION BY n.model, n.quarter ORDER BY n.vintage) - 1) AS INTEGER) AS DATE) AS track_date
FROM nowcast_b n JOIN (
  SELECT quarter, max(w) AS first_friday FROM quarters
  JOIN (SELECT CAST(unnest(generate_series(DATE '1994-01-07', DATE '2003-01-03', INTERVAL 7 DAY)) AS DATE) AS w)
    ON date_trunc('month', w) = q_start - INTERVAL 2 MONTH GROUP BY 1) USING (quarter)""")
def tracking_dates(spark, d):
    dated = score.assign_tracking_dates(fx.nowcast(spark, d, "b"))
    return dated.select("model", "quarter", "vintage", "track_date")


# ---------------------------------------------------------------- accuracy


@query("accuracy", "SELECT * FROM metrics_a", "rmse mae bias mpe")
def accuracy(spark, d):
    return metrics(spark, d)


@query("bias_shares", """
SELECT model, quarter, avg(error) AS mean_error, avg(CASE WHEN error > 0 THEN 1.0 ELSE 0.0 END) AS share_positive,
  avg(CASE WHEN error < 0 THEN 1.0 ELSE 0.0 END) AS share_negative FROM nowcast_a GROUP BY 1, 2""",
       "mean_error share_positive share_negative")
def bias_shares(spark, d):
    return score.bias_shares(fx.nowcast(spark, d))


def _yearly_sql(by_year: str, names: list[str]) -> str:
    means = ", ".join(f"avg({n}) AS {n}" for n in names)
    cols = ", ".join(names)
    return f"""
WITH y AS ({by_year})
SELECT model, year AS label, {cols} FROM y
UNION ALL SELECT model, '{score.ALL_YEARS}', {means} FROM y GROUP BY 1
UNION ALL SELECT model, '{score.excluding([YEAR])}', {means} FROM y WHERE year <> '{YEAR}' GROUP BY 1"""


@query("accuracy_by_year", _yearly_sql(
    "SELECT model, substr(quarter, 1, 4) AS year, avg(rmse) AS rmse, avg(mae) AS mae, avg(bias) AS bias "
    "FROM metrics_a GROUP BY 1, 2", ["rmse", "mae", "bias"]), "rmse mae bias")
def accuracy_by_year(spark, d):
    return score.accuracy_by_year(metrics(spark, d), [YEAR])


@query("volatility_by_year", _yearly_sql(
    "SELECT model, substr(quarter, 1, 4) AS year, avg(step_variance) AS final_variance FROM final_a GROUP BY 1, 2",
    ["final_variance"]), "final_variance")
def volatility_by_year(spark, d):
    return score.volatility_by_year(fx.nowcast(spark, d), [YEAR])


_SHARES = """SELECT model, substr(quarter, 1, 4) AS year,
  sum(impact_releases) / nullif(sum(impact_releases) + sum(impact_revisions), 0) AS releases_share,
  1 - sum(impact_releases) / nullif(sum(impact_releases) + sum(impact_revisions), 0) AS revisions_share
  FROM nowcast_a GROUP BY 1, 2"""


@query("release_revision_share", _yearly_sql(_SHARES, ["releases_share", "revisions_share"]),
       "releases_share revisions_share")
def release_revision_share(spark, d):
    return score.release_revision_share(fx.nowcast(spark, d), [YEAR])


@query("release_revision_sums", """
SELECT model, quarter, sum(impact_releases) AS releases, sum(impact_revisions) AS revisions
FROM nowcast_a GROUP BY 1, 2""", "releases revisions")
def release_revision_sums(spark, d):
    return score.release_revision_sums(fx.nowcast(spark, d))


_FINAL_YEAR = """SELECT model, CAST(substr(quarter, 1, 4) AS INTEGER) AS year, avg(abs_error) AS final_abs_error
FROM final_a GROUP BY 1, 2"""


@query("final_error_by_year", _FINAL_YEAR, "final_abs_error")
def final_error_by_year(spark, d):
    return score.final_error_by_year(fx.nowcast(spark, d))


@query("rolling_mean", f"""
SELECT *, avg(final_abs_error) OVER (PARTITION BY model ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
  AS moving_average FROM ({_FINAL_YEAR})""", "final_abs_error moving_average")
def rolling_mean(spark, d):
    return score.rolling_mean(score.final_error_by_year(fx.nowcast(spark, d)), "final_abs_error")


@query("final_error_by_quarter_of_year", f"""
SELECT model, right(quarter, 2) AS qtr, avg(abs_error) AS all_years,
  avg(abs_error) FILTER (NOT {IS_YEAR}) AS excl_years FROM final_a GROUP BY 1, 2""", "all_years excl_years")
def final_error_by_quarter_of_year(spark, d):
    return score.final_error_by_quarter_of_year(fx.nowcast(spark, d), [YEAR])


@query("inner_available", f"""
SELECT n.* FROM nowcast_a n WHERE (n.model, n.quarter) IN (SELECT (model, quarter) FROM metrics_a WHERE NOT {IS_YEAR})""", ROW)
def inner_available(spark, d):
    have = score.exclude_years(metrics(spark, d), [YEAR])
    return score.inner_available(fx.nowcast(spark, d), have)


@query("catalogue", "SELECT DISTINCT quarter, CAST(substr(quarter, 1, 4) AS INTEGER) AS year FROM nowcast_a")
def catalogue(spark, d):
    return files.catalogue(fx.nowcast(spark, d))


@query("quarters_of_year", f"""
SELECT DISTINCT quarter, CAST(substr(quarter, 1, 4) AS INTEGER) AS year FROM nowcast_a WHERE {IS_YEAR}""")
def quarters_of_year(spark, d):
    return files.quarters_of_year(fx.nowcast(spark, d), YEAR)


# ---------------------------------------------------------------- news impacts


def categorised(spark, d):
    return impact.with_category(fx.news(spark, d), fx.categories(spark, d))


@query("news_table", "SELECT * FROM news", "forecast actual weight impact")
def news_table(spark, d):
    return fx.news(spark, d)


@query("with_category", "SELECT * FROM news_cat", "forecast actual weight impact")
def with_category(spark, d):
    return categorised(spark, d)


@query("unmatched_series", """
SELECT DISTINCT series_id FROM news WHERE series_id NOT IN (SELECT series_id FROM categories)""")
def unmatched_series(spark, d):
    return impact.unmatched_series(fx.news(spark, d), fx.categories(spark, d))


_ORDINAL = """SELECT *, CAST(dense_rank() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER)
  AS vintage_ordinal FROM news_cat"""


@query("vintage_ordinal", _ORDINAL, "forecast actual weight impact")
def vintage_ordinal(spark, d):
    return files.with_vintage_ordinal(categorised(spark, d))


@query("impact_by_series", """
SELECT model, quarter, series_id, coalesce(sum(impact), 0) AS impact FROM news GROUP BY 1, 2, 3""", "impact")
def impact_by_series(spark, d):
    return impact.impact_by_series(fx.news(spark, d))


@query("impact_by_vintage_category", f"""
SELECT model, quarter, vintage, vintage_ordinal, category, coalesce(sum(impact), 0) AS impact
FROM ({_ORDINAL}) GROUP BY 1, 2, 3, 4, 5""", "impact")
def impact_by_vintage_category(spark, d):
    return impact.impact_by_vintage_category(files.with_vintage_ordinal(categorised(spark, d)))


@query("impact_by_quarter_category", """
SELECT model, quarter, category, coalesce(sum(impact), 0) AS impact FROM news_cat GROUP BY 1, 2, 3""", "impact")
def impact_by_quarter_category(spark, d):
    return impact.impact_by_quarter_category(categorised(spark, d))


@query("impact_by_year_category", """
SELECT model, year, quarter, category, coalesce(sum(impact), 0) AS impact
FROM (SELECT *, CAST(substr(quarter, 1, 4) AS INTEGER) AS year FROM news_cat)
GROUP BY GROUPING SETS ((model, year, quarter, category), (model, year, category))""", "impact")
def impact_by_year_category(spark, d):
    return impact.impact_by_year_category(categorised(spark, d))


_YEARLY = """SELECT model, CAST(substr(quarter, 1, 4) AS INTEGER) AS year, category, coalesce(sum(impact), 0) AS impact
FROM news_cat GROUP BY 1, 2, 3"""


@query("mean_abs_year_impact", f"""
SELECT model, category, avg(abs(impact)) AS all_years, avg(abs(impact)) FILTER (year <> {YEAR}) AS excl_years
FROM ({_YEARLY}) GROUP BY 1, 2""", "all_years excl_years")
def mean_abs_year_impact(spark, d):
    return impact.mean_abs_year_impact(categorised(spark, d), [YEAR])


@query("category_by_year", f"SELECT * FROM ({_YEARLY}) WHERE category = 'EUROPE'", "impact")
def category_by_year(spark, d):
    return impact.category_by_year(categorised(spark, d), "EUROPE")


_IDS = ", ".join(f"'{s}'" for s in SERIES)


def _by_quarter_sql(measure: str, name: str) -> str:
    return f"""
SELECT k.model, k.series_id, k.qtr, t.{name}
FROM (SELECT DISTINCT model, series_id, qtr FROM news
      JOIN (SELECT unnest(['q1', 'q2', 'q3', 'q4']) AS qtr) ON true WHERE series_id IN ({_IDS})) k
LEFT JOIN (SELECT model, series_id, right(quarter, 2) AS qtr, {measure} AS {name} FROM news GROUP BY 1, 2, 3) t
  ON t.model = k.model AND t.series_id = k.series_id AND t.qtr = k.qtr"""


@query("mean_abs_by_series_quarter", _by_quarter_sql("avg(abs(impact))", "mean_abs_impact"), "mean_abs_impact")
def mean_abs_by_series_quarter(spark, d):
    return impact.mean_abs_by_series_quarter(fx.news(spark, d), SERIES)


@query("impact_std_by_series_quarter", _by_quarter_sql("stddev_samp(impact)", "impact_sd"), "impact_sd")
def impact_std_by_series_quarter(spark, d):
    return impact.impact_std_by_series_quarter(fx.news(spark, d), SERIES)


@query("scaffold", """
SELECT k.model, k.category, k.qtr, t.rows
FROM (SELECT DISTINCT model, category, qtr FROM news_cat
      JOIN (SELECT unnest(['q1', 'q2', 'q3', 'q4', 'q5']) AS qtr) ON true) k
LEFT JOIN (SELECT model, category, right(quarter, 2) AS qtr, count(*) AS rows FROM news_cat GROUP BY 1, 2, 3) t
  USING (model, category, qtr)""")
def scaffold(spark, d):
    counts = categorised(spark, d).groupBy(
        "model", "category", cal.label_quarter("quarter").alias("qtr")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return reshape.scaffold(counts, ["model", "category"], "qtr", ["q1", "q2", "q3", "q4", "q5"])


@query("top_series", f"""
WITH m AS (SELECT model, series_id, avg(abs(impact)) FILTER (NOT {IS_YEAR}) AS excl_years,
             avg(abs(impact)) AS all_years FROM news GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY excl_years DESC, series_id) AS INTEGER) AS place
      FROM m WHERE excl_years IS NOT NULL)
SELECT model, series_id, place, 'excl_years' AS sample, excl_years AS impact FROM r WHERE place <= 10
UNION ALL SELECT model, series_id, place, 'all_years', all_years FROM r WHERE place <= 10""", "impact")
def top_series(spark, d):
    return impact.top_series(fx.news(spark, d), [YEAR], 10)


# ---------------------------------------------------------------- reshaping


@query("union_labelled", """
SELECT model, quarter, rmse, mae, bias, 'all' AS type FROM metrics_a
UNION ALL SELECT model, quarter, rmse, mae, bias, 'late' FROM metrics_a WHERE quarter >= '1999'""", "rmse mae bias")
def union_labelled(spark, d):
    table = reshape.drop_metric(metrics(spark, d), ["mpe"])
    return reshape.union_labelled({"all": table, "late": table.where(F.col("quarter") >= "1999")})


@query("melt_metrics", """
SELECT model, quarter, metric, value FROM metrics_a UNPIVOT (value FOR metric IN (rmse, mae, bias, mpe))""", "value")
def melt_metrics(spark, d):
    return reshape.melt(metrics(spark, d), ["model", "quarter"], ["rmse", "mae", "bias", "mpe"], "metric", "value")


@query("drop_metric", "SELECT model, quarter, rmse, mae, bias FROM metrics_a", "rmse mae bias")
def drop_metric(spark, d):
    return reshape.drop_metric(metrics(spark, d), ["mpe"])


@query("impact_matrix", """
SELECT model, quarter, series_id, CAST(vintage AS VARCHAR) AS vintage, coalesce(sum(impact), 0) AS impact
FROM news GROUP BY 1, 2, 3, 4""", "impact")
def impact_matrix(spark, d):
    """Series by all vintages, melted again so that every cell of the matrix is compared."""
    weekly = materialise(fx.news(spark, d), "news").groupBy("model", "quarter", "series_id", "vintage").agg(
        F.coalesce(F.sum("impact"), F.lit(0.0)).alias("impact")
    )
    # One name a week: as many columns as the calendar has.
    names = [str(r["vintage"]) for r in weekly.select("vintage").distinct().orderBy("vintage").collect()]
    wide = reshape.impact_matrix(weekly, names)
    return reshape.melt(wide, ["model", "quarter", "series_id"], names, "vintage", "impact").where("impact IS NOT NULL")


@query("duplicate_news_keys", """
SELECT model, quarter, vintage, series_id, count(*) AS n FROM news GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def duplicate_news_keys(spark, d):
    return reshape.duplicate_keys(fx.news(spark, d), ["model", "quarter", "vintage", "series_id"])


@query("ordered_vintages", "SELECT DISTINCT model, quarter, vintage FROM nowcast_a")
def ordered_vintages(spark, d):
    keys = fx.nowcast(spark, d).select("model", "quarter", "vintage").distinct()
    return reshape.ordered(keys, "model", "quarter", "vintage")


# ---------------------------------------------------------------- model comparison


def pairs(spark, d, positional=False):
    return compare.pair_models(fx.nowcast(spark, d, "a"), fx.nowcast(spark, d, "b"), positional)


_PAIRS = """SELECT a.model, a.quarter, a.vintage, a.error AS error_a, b.error AS error_b
FROM nowcast_a a JOIN nowcast_b b USING (model, quarter, vintage)"""
_POSITIONAL = """SELECT model, quarter, week, error_a, error_b
FROM (SELECT model, quarter, error AS error_a, CAST(row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS week FROM nowcast_a)
FULL JOIN (SELECT model, quarter, error AS error_b, CAST(row_number() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS week FROM nowcast_b)
USING (model, quarter, week)"""


@query("pair_models", _PAIRS, "error_a error_b")
def pair_models(spark, d):
    return pairs(spark, d)


@query("pair_models_by_position", _POSITIONAL, "error_a error_b")
def pair_models_by_position(spark, d):
    return pairs(spark, d, positional=True)


def _losses(source: str) -> str:
    return f"""SELECT *, error_a * error_a - error_b * error_b AS d_squared,
  abs(error_a) - abs(error_b) AS d_absolute, error_a - error_b AS d_signed FROM ({source})"""


@query("loss_differentials", _losses(_PAIRS), "error_a error_b d_squared d_absolute d_signed")
def loss_differentials(spark, d):
    return compare.loss_differentials(pairs(spark, d))


def _t(c: str) -> str:
    return f"avg({c}) / nullif(stddev_samp({c}) / sqrt(count({c})), 0)"


@query("one_sample_t", f"""
SELECT model, {_t('d_squared')} AS t, count(d_squared) AS n FROM ({_losses(_PAIRS)}) GROUP BY 1""", "t")
def one_sample_t(spark, d):
    return compare.one_sample_t(compare.loss_differentials(pairs(spark, d)), "d_squared", ["model"], p_value=False)


def _p(t: str, df: str) -> str:
    """Two-sided Student-t p-value for whole degrees of freedom as a finite trigonometric sum."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = (f"sin({angle}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * "
            f"pow(cos({angle}), 2 * k) for k in range(CAST({df} // 2 AS BIGINT))])")
    odd = (f"2 / pi() * ({angle} + coalesce(sin({angle}) * list_sum([sqrt(pi()) / 2 * "
           f"exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k + 1) "
           f"for k in range(CAST(({df} - 1) // 2 AS BIGINT))]), 0))")
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN ({df}) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


@query("one_sample_t_with_p", f"""
SELECT *, {_p('t', '(n - 1)')} AS p
FROM (SELECT model, {_t('d_squared')} AS t, count(d_squared) AS n FROM ({_losses(_PAIRS)}) GROUP BY 1)""", "t p")
def one_sample_t_with_p(spark, d):
    return compare.one_sample_t(compare.loss_differentials(pairs(spark, d)), "d_squared", ["model"])


def _compare_sql(source: str) -> str:
    samples = [
        ("Full sample", "true"), (f"Excluding {YEAR}", f"year <> {YEAR}"),
        (f"Pre-{YEAR}", f"year < {YEAR}"), (f"Post-{YEAR}", f"year > {YEAR}"),
    ]
    return " UNION ALL ".join(
        f"""SELECT model, '{label}' AS sample, count(*) AS observations, count(d_signed) AS pairs,
  {_t('d_squared')} AS t_squared, {_t('d_absolute')} AS t_absolute, {_t('d_signed')} AS t_signed
FROM (SELECT *, CAST(substr(quarter, 1, 4) AS INTEGER) AS year FROM ({_losses(source)})) WHERE {cond} GROUP BY 1"""
        for label, cond in samples
    )


_TS = "t_squared t_absolute t_signed"


@query("compare_models", _compare_sql(_PAIRS), _TS)
def compare_models(spark, d):
    return compare.compare_models(pairs(spark, d), YEAR, ["model"], p_value=False)


@query("compare_models_by_position", _compare_sql(_POSITIONAL), _TS)
def compare_models_by_position(spark, d):
    return compare.compare_models(pairs(spark, d, True), YEAR, ["model"], p_value=False)


@query("compare_models_with_p", f"""
SELECT *, {_p('t_squared', '(pairs - 1)')} AS p_squared, {_p('t_absolute', '(pairs - 1)')} AS p_absolute,
  {_p('t_signed', '(pairs - 1)')} AS p_signed FROM ({_compare_sql(_PAIRS)})""",
       _TS + " p_squared p_absolute p_signed")
def compare_models_with_p(spark, d):
    return compare.compare_models(pairs(spark, d), YEAR, ["model"])


# ---------------------------------------------------------------- report views


def views(spark, d):
    return fx.nowcast(spark, d), materialise(fx.news(spark, d), "news"), fx.categories(spark, d)


def stacked(frames):
    """The frames of a view under each other, every cell as one row: view, row key, column, value."""
    rows = []
    for name, df in frames.items():
        numbers = [c for c, kind in df.dtypes if kind in ("double", "bigint", "int") and c not in ("year", "week", "place", "vintage_ordinal")]
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(set(df.columns) - set(numbers))]
        cells = df.select(F.concat_ws("|", *keys).alias("key"), *[F.col(c).cast("double").alias(c) for c in numbers])
        rows.append(cells.unpivot(["key"], numbers, "field", "value").withColumn("part", F.lit(name)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("value IS NOT NULL").select("part", "key", "field", "value")


_LAST = "(SELECT max(quarter) FROM nowcast_a)"


@query("quarter_report", f"""
SELECT 'accuracy' AS part, model || '|' || quarter AS key, field, value FROM (
  SELECT model, quarter, rmse, mae, bias, mpe FROM metrics_a WHERE quarter = {_LAST}) UNPIVOT (value FOR field IN (rmse, mae, bias, mpe))
UNION ALL SELECT 'official', model || '|' || quarter, 'actual', y_new + error FROM final_a WHERE quarter = {_LAST}
UNION ALL SELECT 'bias', model || '|' || quarter, field, value FROM (
  SELECT model, quarter, avg(error) AS mean_error, CAST(avg(CASE WHEN error > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS share_positive,
    CAST(avg(CASE WHEN error < 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS share_negative FROM nowcast_a WHERE quarter = {_LAST} GROUP BY 1, 2)
  UNPIVOT (value FOR field IN (mean_error, share_positive, share_negative))""", "value")
def quarter_report(spark, d):
    """Accuracy, bias and official figure in the view of the last quarter."""
    table, news, mapping = views(spark, d)
    last = table.agg(F.max("quarter")).scalar()
    view = reports.quarter_report(table, news, mapping, last)
    return stacked({k: view[k] for k in ("accuracy", "official", "bias")})


_YEAR = "(SELECT max(CAST(substr(quarter, 1, 4) AS INTEGER)) FROM nowcast_a)"


@query("year_report", f"""
SELECT 'metrics' AS part, model || '|' || quarter AS key, field, value FROM (
  SELECT model, quarter, rmse, mae, bias, mpe FROM metrics_a WHERE CAST(substr(quarter, 1, 4) AS INTEGER) = {_YEAR})
  UNPIVOT (value FOR field IN (rmse, mae, bias, mpe))
UNION ALL SELECT 'final_errors', model || '|' || quarter, field, value FROM (
  SELECT model, quarter, error, abs_error FROM final_a WHERE CAST(substr(quarter, 1, 4) AS INTEGER) = {_YEAR})
  UNPIVOT (value FOR field IN (error, abs_error))""", "value")
def year_report(spark, d):
    """Metrics and final errors in the view of the last year."""
    table, news, mapping = views(spark, d)
    last = table.agg(F.max(cal.label_year("quarter"))).scalar()
    view = reports.year_report(table, news, mapping, last)
    return stacked({k: view[k] for k in ("metrics", "final_errors")})


@query("history_report", f"""
SELECT 'final_vs_actual' AS part, model || '|' || CAST(published AS VARCHAR) || '|' || quarter AS key, field, value FROM (
  SELECT model, quarter, CAST(q_start + INTERVAL 4 MONTH - INTERVAL 1 DAY AS DATE) AS published,
    CASE WHEN NOT {IS_YEAR} THEN y_new END AS final_nowcast, CASE WHEN NOT {IS_YEAR} THEN y_new + error END AS actual
  FROM final_a JOIN quarters USING (quarter)) UNPIVOT (value FOR field IN (final_nowcast, actual))""", "value")
def history_report(spark, d):
    """Final nowcasts beside the official figures in the view of all years."""
    table, news, mapping = views(spark, d)
    return stacked({"final_vs_actual": reports.history_report(table, news, mapping, [YEAR])["final_vs_actual"]})
