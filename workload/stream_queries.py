"""Streaming queries run to the end of their input and read back."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import calendar as cal
from tidemark.storage import ensure_checkpoint_dir, materialise
from tidemark.streaming import streams
from workload import fixtures as fx
from workload.registry import query


def _events(spark, d, files_per_batch=1000):
    return streams.read_table(spark, d, "events.parquet", fx.COLUMNS["events"], files_per_batch)


def _drain(spark, stream, mode):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    job = streams.write_batches(stream, f"{base}/out", f"{base}/state", mode)
    job.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return streams.read_batches(spark, f"{base}/out", schema)


@query("stream_vintages", """
SELECT event_type AS model, CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS period,
  arg_max(value, (ts, value)) AS value
FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3""", "value")
def stream_vintages(spark, d):
    """Daily value of every user as last reported, built from arriving events."""
    facts = _events(spark, d).select(
        F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("series_id"),
        F.col("ts").cast("date").alias("period"), F.col("ts").alias("release"), "value",
    )
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    updates = streams.vintage_updates(facts)
    streams.upsert_vintages(updates, f"{base}/out", f"{base}/state").awaitTermination()
    return streams.read_panel(spark, f"{base}/out", updates.schema).drop("release", "month")


@query("stream_weekly_windows", """
SELECT CAST(DATE '1970-01-01' + CAST(7 * floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS DATE) AS week_start,
  event_type, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2""", "total")
def stream_weekly_windows(spark, d, files_per_batch=1000):
    """Weekly windows over all events, in whatever order their files come."""
    timed = _events(spark, d, files_per_batch).select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,2)").alias("value")
    )
    stored = _drain(spark, streams.weekly_windows(timed, "ts", ["event_type"], "value", lateness=None), "update")
    final = streams.latest(stored, ["week_start", "event_type"], F.col("batch_id"))
    return final.select(
        F.col("week_start").cast("date").alias("week_start"), "event_type", "n",
        F.col("total").cast("double").alias("total"),
    )


@query("stream_running_accuracy", """
SELECT event_type AS model, year(ts) || '_q' || quarter(ts) AS quarter, sqrt(avg((20 - value) * (20 - value))) AS rmse,
  avg(abs(20 - value)) AS mae, avg(20 - value) AS bias, count(value) AS n
FROM events GROUP BY 1, 2""", "rmse mae bias")
def stream_running_accuracy(spark, d):
    """Errors of the events against a flat forecast of 20."""
    errors = _events(spark, d).select(
        F.col("event_type").alias("model"), cal.quarter_label(F.col("ts").cast("date")).alias("quarter"),
        (20 - F.col("value")).alias("error"),
    )
    return streams.accuracy_from_sums(_drain(spark, streams.running_accuracy(errors), "update"))


# Events that are handed over after all others, and how late the windows may still take them.
_LATE = "event_id % 7 = 3"
_LATENESS = 10
# More files than an arrival can have.
_WHOLE = 2**31 - 1


@query("stream_late_events", f"""
WITH e AS (SELECT *, {_LATE} AS late, CAST(DATE '1970-01-01' + CAST(7 * floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS DATE) AS week_start FROM events),
mark AS (SELECT max(ts) - INTERVAL {_LATENESS} DAY AS closed FROM e WHERE NOT late)
SELECT week_start, event_type, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM e, mark WHERE NOT late OR week_start + INTERVAL 7 DAY > closed GROUP BY 1, 2""", "total")
def stream_late_events(spark, d):
    """Weekly windows over events that arrive in several batches of files, the last of them late.

    Late rows count as long as their week has not closed behind the watermark.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = fx.table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"),
        F.expr(_LATE).alias("late"), F.dayofmonth("ts").alias("day"),
    )
    # Arrivals in order of time, then the late ones; each is written by all its tasks and read as one batch.
    for part in (*[f"NOT late AND day BETWEEN {a} AND {b}" for a, b in ((1, 9), (10, 18), (19, 28), (29, 31))], "late"):
        events.where(part).drop("late", "day").write.mode("append").parquet(f"{base}/in")
        timed = streams.read_files(spark, f"{base}/in", "ts timestamp, event_type string, value decimal(18,2)", files_per_batch=_WHOLE)
        windows = streams.weekly_windows(timed, "ts", ["event_type"], "value", f"{_LATENESS} days")
        streams.write_batches(windows, f"{base}/out", f"{base}/state", "update").awaitTermination()
    schema = T.StructType([*windows.schema.fields, T.StructField("batch_id", T.IntegerType())])
    final = streams.latest(streams.read_batches(spark, f"{base}/out", schema), ["week_start", "event_type"], F.col("batch_id"))
    return final.select(
        F.col("week_start").cast("date").alias("week_start"), "event_type", "n", F.col("total").cast("double").alias("total")
    )


@query("stream_chain_breaks", """
SELECT model, quarter, vintage, y_old, y_new, previous_y_new
FROM (SELECT *, lag(y_new) OVER (PARTITION BY model, quarter ORDER BY vintage) AS previous_y_new
  FROM (SELECT n.* FROM nowcast_a n JOIN available a ON a.model = n.model AND a.vintage = n.vintage))
WHERE abs(y_old - previous_y_new) > 1e-9""", "y_old y_new previous_y_new")
def stream_chain_breaks(spark, d):
    """The breaks of ``chain_breaks``, found while updates arrive: the odd weeks of three years after the even ones."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    kept = fx.nowcast(spark, d).join(fx.available_vintages(spark, d), ["model", "vintage"], "left_semi")
    week = (F.datediff("vintage", F.lit("1970-01-02").cast("date")) / 7).cast("int")
    rows = materialise(kept.select("model", "quarter", F.col("vintage").cast("timestamp").alias("vintage"), "y_old", "y_new", (week % 2).alias("even"), F.year("vintage").alias("year")), "updates")
    schema = "model string, quarter string, vintage timestamp, y_old double, y_new double"
    years = rows.agg(F.min("year").alias("first"), F.max("year").alias("last")).first()
    for low in range(years["first"], years["last"] + 1, 3):
        for even in (0, 1):
            rows.where(F.col("year").between(low, low + 2) & (F.col("even") == even)).drop("year", "even").write.mode("append").parquet(f"{base}/in")
            # A whole arrival is one batch; three years stay open, so no update is behind the watermark.
            found = streams.chain_breaks(streams.read_files(spark, f"{base}/in", schema, files_per_batch=_WHOLE), lateness="1200 days")
            streams.write_batches(found, f"{base}/out", f"{base}/state", "update").awaitTermination()
    stored = T.StructType([*found.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return streams.broken_links(streams.read_batches(spark, f"{base}/out", stored)).withColumn("vintage", F.col("vintage").cast("date"))
