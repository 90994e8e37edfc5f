import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming import streams
from workload import fixtures as fx
from workload import stream_queries

DDL = "model string, series_id string, period date, release timestamp, value double"


def rows_of(first, n, model="m"):
    base = dt.datetime(2024, 1, 1)
    return [
        (model, f"s{k % 3}", dt.date(2024, 1, 1 + k % 4), base + dt.timedelta(days=first + k), float(first + k))
        for k in range(n)
    ]


def drain(spark, stream, base, mode):
    streams.write_batches(stream, f"{base}/out", f"{base}/state", mode).awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return streams.read_batches(spark, f"{base}/out", schema)


def put(spark, rows, path, ddl=DDL):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def test_upsert_equals_batch_over_several_runs(spark, tmp_path):
    src = str(tmp_path / "in")
    rows, sizes = [], []
    for first in (0, 20, 10):  # the last files carry older releases
        put(spark, rows_of(first, 8), src)
        rows += rows_of(first, 8)
        updates = streams.vintage_updates(streams.read_files(spark, src, DDL))
        streams.upsert_vintages(updates, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        panel = streams.read_panel(spark, f"{tmp_path}/out", updates.schema)
        sizes.append(panel.count())
    got = {(r["series_id"], r["period"]): r["value"] for r in panel.collect()}
    want = {}
    for _, s, p, rel, v in sorted(rows, key=lambda r: r[3]):
        want[(s, p)] = v
    assert got == want and sizes[-1] == len(want)


def test_directories_of_many_batches_are_few():
    for merge in (2, 3, 10):
        for n in range(0, 400):
            held = streams.live_directories(n, merge)
            covered = [k for level, last in held for k in range(last - merge**level + 1, last + 1)]
            assert covered == list(range(n))
            assert len(held) <= (merge - 1) * len(str(n)) * 4
    assert len(streams.live_directories(200, 10)) == 2 and len(streams.live_directories(10**6 - 1, 10)) == 54


def test_merged_levels_and_replays(spark, tmp_path):
    """Batches of one file each, merged by twos, against all rows at once; each batch is stored twice."""
    path, rows = str(tmp_path / "out"), []
    for k in range(9):
        new = rows_of(3 * k, 5, "ab"[k % 2]) + rows_of(2, 1, "c")
        rows += new
        batch = spark.createDataFrame(new, DDL)
        for _ in range(2):
            streams.store_batch(batch, k, path, merge=2)
        if k in (0, 3, 6, 8):
            got = {(r["model"], r["series_id"], r["period"]): r["value"] for r in streams.read_panel(spark, path, batch.schema).collect()}
            want = {}
            for m, s, p, rel, v in sorted(rows, key=lambda r: r[3]):
                want[m, s, p] = v
            assert got == want
    read = streams.read_panel(spark, path, batch.schema)
    folders = {f.split("/out/")[1].split("/model=")[0] for f in read.inputFiles()}
    assert folders <= {"merged-3/batch_id=7", "batch_id=8"} and len(folders) == 2
    at_four = streams.read_panel(spark, path, batch.schema, before=4)
    assert {f.split("/out/")[1].split("/model=")[0] for f in at_four.inputFiles()} == {"merged-2/batch_id=3"}
    assert streams.read_panel(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_a_batch_writes_only_the_partitions_it_touches(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in (rows_of(0, 4, "a") + rows_of(0, 4, "b"), rows_of(9, 2, "b")):
        put(spark, rows, src)
        updates = streams.vintage_updates(streams.read_files(spark, src, DDL))
        streams.upsert_vintages(updates, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out/batch_id=1").iterdir() if p.is_dir()) == ["model=b"]
    panel = streams.read_panel(spark, f"{tmp_path}/out", updates.schema)
    assert {r["model"]: r["n"] for r in panel.groupBy("model").agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 4}
    assert panel.where("model = 'b' AND value >= 9").count() == 2
    earlier = streams.read_panel(spark, f"{tmp_path}/out", updates.schema, before=1)
    assert earlier.count() == 8


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(0, 6), DDL)
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    part = next(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one/events.parquet").write_bytes(part.read_bytes())
    rows.repartition(3).write.parquet(str(tmp_path / "many/events.parquet"))
    for base in ("one", "many"):
        stream = streams.read_table(spark, str(tmp_path / base), "events.parquet", DDL)
        stored = drain(spark, streams.vintage_updates(stream), tmp_path / f"out-{base}", "append")
        assert stored.count() == 6


def test_running_accuracy_equals_batch(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "model string, quarter string, error double"
    for part in ([("a", "2017_q1", 1.0), ("a", "2017_q1", -3.0)], [("a", "2017_q1", 2.0), ("b", "2017_q2", 0.5)]):
        put(spark, part, src, ddl)
        stored = drain(spark, streams.running_accuracy(streams.read_files(spark, src, ddl)), tmp_path, "update")
    got = {r["model"]: (r["rmse"], r["mae"], r["bias"], r["n"]) for r in streams.accuracy_from_sums(stored).collect()}
    assert got["a"] == pytest.approx(((14 / 3) ** 0.5, 2.0, 0.0, 3)) and got["b"] == pytest.approx((0.5, 0.5, 0.5, 1))


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in (rows_of(0, 3), rows_of(60, 3), rows_of(1, 3)):
        put(spark, rows, src)
        stream = streams.weekly_windows(streams.read_files(spark, src, DDL), "release", ["model"], "value", "7 days")
        stored = drain(spark, stream, tmp_path, "update")
    final = streams.latest(stored, ["week_start", "model"], F.col("batch_id"))
    assert final.agg(F.sum("n")).first()[0] == 6


def test_weekly_windows_count_files_out_of_order(spark, tmp_path):
    """The query takes every event, however many batches the files make and whatever their order."""
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), k % 2, "e", 1.0) for k in range(200)], fx.COLUMNS["events"])
    for first in (150, 0, 100, 50):
        rows.where(f"event_id BETWEEN {first} AND {first + 49}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)  # files are taken in order of their time
    final = stream_queries.stream_weekly_windows(spark, str(tmp_path), files_per_batch=1)
    assert final.agg(F.sum("n")).first()[0] == 200
    assert final.count() == final.select("week_start").distinct().count() == 30


def test_an_arrival_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No arrival goes through one task, and each is one batch."""
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k % 2, "e", 1.0) for k in range(700)], fx.COLUMNS["events"])
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stream_queries, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        final = stream_queries.stream_late_events(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert final.agg(F.sum("n")).first()[0] > 600
    assert len(list(tmp_path.glob("stream-*/in/part-*"))) > 5


def test_chain_breaks_in_any_order_and_after_a_restart(spark, tmp_path):
    """Updates in three runs, some out of order, against the batch rule; closed quarters lose their state."""
    from tidemark.operators import score

    ddl = "model string, quarter string, vintage timestamp, y_old double, y_new double"
    rows = []
    for q, first in (("2020_q1", dt.datetime(2020, 1, 3)), ("2020_q2", dt.datetime(2020, 4, 3)), ("2021_q1", dt.datetime(2021, 1, 1))):
        y = 0.0
        for k in range(8):
            broken = k in (3, 6)
            rows.append(("m", q, first + dt.timedelta(days=7 * k), y + (0.5 if broken else 0.0), y + 1 + k / 8))
            y += 1 + k / 8
    arrivals = [rows[1:4] + rows[5:8], [rows[0], rows[4]] + rows[8:16], rows[16:]]
    for part in arrivals:
        put(spark, part, str(tmp_path / "in"), ddl)
        stream = streams.chain_breaks(streams.read_files(spark, str(tmp_path / "in"), ddl))
        got = drain(spark, stream, tmp_path, "update")
    batch = score.chain_breaks(spark.createDataFrame(rows, ddl))
    want = {(r["quarter"], r["vintage"], r["y_old"], r["previous_y_new"]) for r in batch.collect()}
    assert {(r["quarter"], r["vintage"], r["y_old"], r["previous_y_new"]) for r in streams.broken_links(got).collect()} == want
    assert len(want) == 6
    state = spark.read.format("statestore").load(f"{tmp_path}/state")
    assert {r["key"]["quarter"] for r in state.select("key").collect()} <= {"2020_q2", "2021_q1"}
