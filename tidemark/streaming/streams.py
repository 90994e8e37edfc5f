"""Structured Streaming jobs that keep vintage and accuracy tables up to date.

Every micro-batch overwrites its own ``batch_id`` directory, so a batch that
is replayed after a failure replaces itself.  The panel of current values is
kept by merging a batch into the partitions it touches, and its directories are
merged level by level; the windowed and running tables hold one row per key and batch, of which readers take the last.
"""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.storage import read_note, replace_note

WEEK = "7 days"


def read_files(
    spark: SparkSession, path: str, schema: str, glob: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """File stream with a fixed schema; new files are picked up in bounded batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """File stream of the table ``folder/name``, be it one file or a folder of part files."""
    found = spark.read.schema(schema).parquet(f"{folder}/{name}").inputFiles()
    if found and found[0].rstrip("/").endswith(f"/{name}"):
        return read_files(spark, folder, schema, name, files_per_batch)
    return read_files(spark, f"{folder}/{name}", schema, "*.parquet", files_per_batch)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Write every micro-batch to ``path/batch_id=N``; ``once`` stops when the input is used up."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(store).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def latest(stored: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the largest ``order`` per key; partial aggregation keeps hot keys small."""
    rest = [c for c in stored.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("_best")
    return stored.groupBy(*keys).agg(best).select(*keys, "_best.*")


# ---------------------------------------------------------------- vintages


def vintage_updates(facts: DataFrame) -> DataFrame:
    """Observations as they arrive: model, series_id, period, release, value."""
    return facts.select("model", "series_id", "period", "release", "value").where(
        F.col("value").isNotNull()
    )


CELL = ["model", "series_id", "period"]
PARTITION = ["model", "month"]


def _merged(rows: DataFrame) -> DataFrame:
    """Latest release of every cell; ties go to the larger value."""
    return latest(rows.select(*CELL, "release", "value"), CELL, F.struct("release", "value"))


#: So many directories of one level become one of the next.
MERGE = 10
MANIFEST = "_manifest"


def live_directories(batches: int, merge: int) -> list[tuple[int, int]]:
    """(level, last batch) of the directories that hold the first ``batches`` batches, oldest first.

    A directory of a level covers ``merge`` ones of the level below: the digits of ``batches`` in base
    ``merge`` say how many there are of each, so a reader opens a number that grows with the logarithm.
    """
    level = 0
    while merge ** (level + 1) <= batches:
        level += 1
    found, done = [], 0
    for k in range(level, -1, -1):
        while done + merge**k <= batches:
            done += merge**k
            found.append((k, done - 1))
    return found


def _layout(schema: T.StructType) -> T.StructType:
    kinds = {f.name: f.dataType for f in schema.fields}
    return T.StructType(
        [T.StructField(c, kinds[c]) for c in ("series_id", "period", "release", "value")]
        + [T.StructField("model", kinds["model"]), T.StructField("month", T.DateType()), T.StructField("batch_id", T.IntegerType())]
    )


def _place(path: str, level: int) -> str:
    return f"{path}/merged-{level}" if level else path


def _latest_partitions(spark: SparkSession, path: str, schema: T.StructType, held: list[tuple[int, int]]) -> DataFrame:
    """Rows of some directories, each partition from the last one that has it."""
    out = None
    for level in sorted({k for k, _ in held}):
        base = _place(path, level)
        folders = [f"{base}/batch_id={n}" for k, n in held if k == level]
        rows = spark.read.schema(_layout(schema)).option("basePath", base).parquet(*folders)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], _layout(schema))
    # Directory names alone say which batch wrote a partition last.
    last = out.groupBy(*PARTITION).agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, [*PARTITION, "batch_id"], "left_semi")


def store_batch(batch: DataFrame, batch_id: int, path: str, merge: int = MERGE) -> None:
    """Merge one batch into the panel; every step can be repeated.

    The batch writes the merged partitions to a directory of its own.  When it fills up a level, the
    level's directories are written as one of the next level.  The manifest, replaced last and at once, says
    how many batches are in; what a batch reads follows from its number, so a replay reads what
    the first attempt read.  Directories that were merged stay until someone removes them, as
    readers of an older manifest may still use them.
    """
    spark = batch.sparkSession
    fresh = _merged(batch).withColumn("month", F.trunc("period", "MM"))
    if batch_id:
        before = _latest_partitions(spark, path, batch.schema, live_directories(batch_id, merge))
        held = before.join(fresh.select(*PARTITION).distinct(), PARTITION, "left_semi")
        fresh = _merged(held.select(*CELL, "release", "value").unionByName(fresh.select(*CELL, "release", "value"))).withColumn("month", F.trunc("period", "MM"))
    columns = ["series_id", "period", "release", "value", *PARTITION]
    fresh.select(*columns).write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{path}/batch_id={batch_id}")
    level = 1
    while (batch_id + 1) % merge**level == 0:
        step = merge ** (level - 1)
        parts = [(level - 1, batch_id - k * step) for k in range(merge)]
        whole = _latest_partitions(spark, path, batch.schema, parts).select(*columns)
        out = whole.hint("rebalance", *[F.col(c) for c in PARTITION])
        out.write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{_place(path, level)}/batch_id={batch_id}")
        level += 1
    replace_note(spark, f"{path}/{MANIFEST}", json.dumps({"batches": batch_id + 1, "merge": merge}))


def upsert_vintages(stream: DataFrame, path: str, checkpoint: str, once: bool = True, merge: int = MERGE) -> StreamingQuery:
    """Keep the current panel below ``path``: every batch merges into the partitions it touches (a model's month)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, path, merge)

    writer = stream.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_panel(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The panel that ``upsert_vintages`` keeps, as of the batches below ``before`` or of all in the manifest."""
    note = json.loads(read_note(spark, f"{path}/{MANIFEST}") or '{"batches": 0, "merge": 10}')
    batches = note["batches"] if before is None else min(before, note["batches"])
    rows = _latest_partitions(spark, path, schema, live_directories(batches, note["merge"]))
    return rows.select(*CELL, "release", "value", "month")


# ---------------------------------------------------------------- weekly windows


def weekly_windows(
    stream: DataFrame, time: str, keys: list[str], value: str, lateness: str | None = "14 days"
) -> DataFrame:
    """Sum and count per calendar week; rows later than the watermark are dropped.

    With ``lateness`` None there is no watermark: every row counts and every week stays open.
    """
    timed = stream if lateness is None else stream.withWatermark(time, lateness)
    return (
        timed.groupBy(F.window(time, WEEK).alias("week"), *keys)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"))
        .select(F.col("week.start").alias("week_start"), *keys, "n", "total")
    )


# ---------------------------------------------------------------- accuracy


def running_accuracy(stream: DataFrame) -> DataFrame:
    """Running sums behind the accuracy metrics of each quarter."""
    e = F.col("error")
    return stream.groupBy("model", "quarter").agg(
        F.count(e).alias("n"), F.sum(e).alias("sum_error"), F.sum(F.abs(e)).alias("sum_abs_error"),
        F.sum(e * e).alias("sum_square_error"),
    )


def accuracy_from_sums(stored: DataFrame) -> DataFrame:
    """Metrics of the latest state of every quarter."""
    state = latest(stored, ["model", "quarter"], F.col("batch_id"))
    n = F.col("n")
    return state.select(
        "model", "quarter", F.sqrt(F.col("sum_square_error") / n).alias("rmse"),
        (F.col("sum_abs_error") / n).alias("mae"), (F.col("sum_error") / n).alias("bias"), "n",
    )


# ---------------------------------------------------------------- order


CHAIN_DDL = "model string, quarter string, vintage timestamp, y_old double, y_new double, previous_y_new double, broken boolean"


def _closes(quarter: str) -> int:
    """Milliseconds at which the month of a quarter's publication is over, in UTC."""
    year, q = int(quarter[:4]), int(quarter[-1])
    month = year * 12 + 3 * q + 1
    return int(dt.datetime(month // 12, month % 12 + 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def chain_breaks(stream: DataFrame, tolerance: float = 1e-9, lateness: str = "30 days") -> DataFrame:
    """Whether each update starts from the figure of the one before it, said again when an earlier one arrives later.

    ``stream`` has model, quarter, vintage (a timestamp), y_old and y_new, one row an update, in any order.  The state
    of a quarter is its chain so far, some twenty updates; a timer removes it once the watermark has passed the
    quarter's publication.  Each batch gives the rows whose answer is new; of a row's answers the last one holds.  An
    update that is sent twice counts as it was sent last.
    """

    def follow(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        chain = {v: (a, b) for v, a, b in json.loads(state.get[0])} if state.exists else {}
        new = {}
        for part in parts:
            for v, a, b in zip(part["vintage"].astype("datetime64[us]").astype("int64"), part["y_old"], part["y_new"]):
                new[int(v)] = tuple(None if pd.isna(x) else float(x) for x in (a, b))
        chain.update(new)
        order = sorted(chain)
        rows = []
        for before, v in zip([None, *order], order):
            if v in new or before in new:
                last, (old, figure) = chain[before][1] if before is not None else None, chain[v]
                broken = last is not None and old is not None and abs(old - last) > tolerance
                rows.append((*key, pd.Timestamp(v, unit="us"), old, figure, last, broken))
        closing = _closes(key[1])
        if closing > state.getCurrentWatermarkMs():
            state.update((json.dumps([(v, *chain[v]) for v in order]),))
            state.setTimeoutTimestamp(closing)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAIN_DDL.split(", ")])

    timed = stream.select("model", "quarter", "vintage", "y_old", "y_new").withWatermark("vintage", lateness)
    return timed.groupBy("model", "quarter").applyInPandasWithState(follow, CHAIN_DDL, "chain string", "update", "EventTimeTimeout")


def broken_links(stored: DataFrame) -> DataFrame:
    """The updates that broke a chain, by the last answer to each."""
    final = latest(stored, ["model", "quarter", "vintage"], F.col("batch_id"))
    return final.where("broken").select("model", "quarter", "vintage", "y_old", "y_new", "previous_y_new")
