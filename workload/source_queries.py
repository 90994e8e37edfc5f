"""Stored tables: written to partitioned directories and read back."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, score
from tidemark.sources import files
from tidemark.storage import ensure_checkpoint_dir, materialise
from workload import fixtures as fx
from workload.registry import query

ROW = "y_old y_new error abs_error perc_error impact_revisions impact_releases step_variance"


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stored_results", "SELECT * FROM nowcast_a", ROW)
def stored_results(spark, d):
    path = _folder(spark, "results")
    files.write_results(fx.nowcast(spark, d), path)
    return files.read_results(spark, path)


@query("stored_metrics", "SELECT * FROM metrics_a", "rmse mae bias mpe")
def stored_metrics(spark, d):
    path = _folder(spark, "metrics")
    files.write_metrics(score.accuracy(fx.nowcast(spark, d)), path)
    return files.read_metrics(spark, path)


@query("stored_news", """
SELECT *, CAST(dense_rank() OVER (PARTITION BY model, quarter ORDER BY vintage) AS INTEGER) AS vintage_ordinal
FROM news""", "forecast actual weight impact")
def stored_news(spark, d):
    path = _folder(spark, "news")
    files.write_news(fx.news(spark, d), path)
    return files.read_news(spark, path)


@query("stored_params", "SELECT * FROM all_params", "v")
def stored_params(spark, d):
    """All matrices and vectors: C, A, Q, Mx and Wx."""
    path = _folder(spark, "params")
    files.write_params(fx.simple_params(spark, d), path)
    return files.read_params(spark, path)


@query("stored_vintages", "SELECT * FROM obs", "value")
def stored_vintages(spark, d):
    path = _folder(spark, "vintages")
    files.write_vintages(fx.obs(spark, d), path)
    return files.read_vintages(spark, path, fmt="parquet")


@query("csv_results", "SELECT * FROM nowcast_a", ROW)
def csv_results(spark, d):
    """Loose CSV files by quarter, each model's below its own folder, read back by name of column and quarter of file."""
    path = _folder(spark, "loose-results")
    rows = fx.nowcast(spark, d)
    out = rows.withColumn("file", F.concat(F.lit("nowcast_"), "quarter")).withColumnRenamed("step_variance", "variance").drop("quarter")
    out.repartition("model", "file").write.option("header", True).partitionBy("model", "file").csv(path)
    models = [r["model"] for r in fx.spec(spark, d).select("model").distinct().orderBy("model").collect()]
    read = [files.read_result_files(spark, f"{path}/model={m}/*/*.csv", m) for m in models]
    return reduce(DataFrame.unionByName, read).select(rows.columns)


#: Series of the CSV vintages of a year, by its remainder modulo 3: three headers.
_HEADERS = "CASE year(vintage) % 3 WHEN 0 THEN true WHEN 1 THEN series_id <> 'NATION_3' ELSE series_id < 'NATION_2' END"


@query("csv_vintages", f"""
WITH last AS (SELECT quarter, max(vintage) AS vintage FROM schedule GROUP BY 1),
whole AS (SELECT 'all' AS model, o.vintage, o.series_id, o.period, sum(o.value) AS value FROM vintage_obs o JOIN last USING (vintage) GROUP BY ALL),
kept AS (SELECT * FROM whole WHERE {_HEADERS}),
names AS (SELECT year(vintage) % 3 AS g, series_id FROM kept GROUP BY ALL),
cells AS (SELECT vintage, period FROM kept GROUP BY ALL)
SELECT 'all' AS model, c.vintage, n.series_id, c.period, k.value
FROM cells c JOIN names n ON n.g = year(c.vintage) % 3 LEFT JOIN kept k ON k.vintage = c.vintage AND k.period = c.period AND k.series_id = n.series_id""", "value")
def csv_vintages(spark, d):
    """The last vintage of every quarter as wide CSV files with one of three headers, read back as one long table."""
    path = _folder(spark, "csv-vintages")
    last = fx.schedule(spark, d).groupBy("quarter").agg(F.max("vintage").alias("vintage"))
    known = asof.value_as_of(fx.facts(spark, d), last).groupBy("vintage", "series_id", "period").agg(F.sum("value").alias("value"))
    kept = materialise(known.where(F.expr(_HEADERS)), "csv-cells")
    for k in range(3):
        wide = kept.where(F.year("vintage") % 3 == k).groupBy("vintage", F.col("period").alias("Date")).pivot("series_id").agg(F.first("value"))
        wide.repartition("vintage").sortWithinPartitions("vintage", "Date").write.mode("append").option("header", True).partitionBy("vintage").csv(path)
    return files.read_vintages(spark, path, "all")
