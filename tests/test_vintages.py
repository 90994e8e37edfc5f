import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import day, facts_frame, obs_frame
from tidemark.operators import asof, news
from tidemark.schema import OBS_DDL


def test_value_as_of_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in "abc":
        for p in ("2000-01-01", "2000-02-01"):
            for k in sorted(rng.choice(400, 12, replace=False)):
                rows.append((s, p, str(day("2000-01-05") + dt.timedelta(int(k))), round(float(rng.normal()), 3)))
    rows.append(rows[-1][:3] + (99.0,))  # a second value on the same day: the larger one counts
    dates = [day("1999-12-31")] + [day("2000-01-07") + dt.timedelta(int(k)) for k in rng.choice(500, 30, replace=False)]
    vintages = spark.createDataFrame([(v,) for v in dates], "vintage date")
    got = {(r["vintage"], r["series_id"], r["period"]): r["value"]
           for r in asof.value_as_of(facts_frame(spark, rows), vintages).collect()}
    want = {}
    for v in set(dates):
        for s, p, r, x in sorted(rows, key=lambda q: (q[2], q[3])):
            if day(r) <= v:
                want[(v, s, day(p))] = x
    assert got == want


def test_hole_in_the_schedule_breaks_both_pairs(spark):
    weeks = [day("2017-01-06") + dt.timedelta(7 * k) for k in range(5)]
    schedule = spark.createDataFrame([("2017_q1", w) for w in weeks], "quarter string, vintage date")
    obs = spark.createDataFrame(
        [("m", w, "a", day("2016-12-01"), float(k)) for k, w in enumerate(weeks) if k != 2], OBS_DDL
    )
    pairs = asof.pair_vintages(schedule, obs).collect()
    assert sorted((r["vintage_old"], r["vintage"], r["old"], r["new"]) for r in pairs) == [
        (weeks[0], weeks[1], 0.0, 1.0), (weeks[3], weeks[4], 3.0, 4.0),
    ]


def brute_changes(rows, weeks):
    """Cells that differ between consecutive weeks, from the last value released by each."""
    known = lambda v: {
        (s, day(p)): x for s, p, r, x in sorted(rows, key=lambda q: (q[2], q[3])) if day(r) <= v
    }
    out = {}
    for a, b in zip(weeks, weeks[1:]):
        old, new = known(a), known(b)
        for c in old.keys() | new.keys():
            if old.get(c) != new.get(c):
                out[(a, b, *c)] = (old.get(c), new.get(c))
    return out


def test_changed_cells_on_an_irregular_schedule(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in "abc":
        for p in ("2000-01-01", "2000-02-01", "2000-03-01"):
            for k in sorted(rng.choice(200, 14, replace=False)):
                rows.append((s, p, str(day("2000-01-05") + dt.timedelta(int(k))), float(rng.integers(0, 4))))
    rows.append((*rows[-1][:3], 9.0))  # a second value on the same day: the larger one counts
    # gaps of 1 to 40 days, several releases between two vintages; two quarters share some pairs
    weeks = sorted({day("1999-12-30") + dt.timedelta(int(k)) for k in np.cumsum(rng.integers(1, 40, 14))})
    schedule = spark.createDataFrame([("2000_q1", w) for w in weeks] + [("2000_q2", w) for w in weeks[4:]], "quarter string, vintage date")
    have = spark.createDataFrame([("m", w) for w in weeks], "model string, vintage date")
    facts = facts_frame(spark, rows)
    pairs = asof.vintage_pairs(schedule, have)
    cells = asof.changed_cells(facts, pairs).collect()
    for quarter, part in (("2000_q1", weeks), ("2000_q2", weeks[4:])):
        got = {(r["vintage_old"], r["vintage"], r["series_id"], r["period"]): (r["old"], r["new"]) for r in cells if r["quarter"] == quarter}
        assert got == brute_changes(rows, part)
    # The same rows as those that differ in the full listing, and the same counts of unchanged cells.
    full = news.vintage_diff(asof.pair_vintages(schedule, asof.value_as_of(facts, have), have))
    by_cell = {(r["quarter"], r["vintage"], r["status"]): r["n"] for r in full.groupBy("quarter", "vintage", "status").agg(F.count("*").alias("n")).collect()}
    counts = news.status_counts(asof.changed_cells(facts, pairs), asof.known_cells(facts, pairs.select("model", F.col("vintage_old").alias("vintage"))), pairs)
    assert {(r["quarter"], r["vintage"], r["status"]): r["cells"] for r in counts.collect()} == by_cell


def test_withdrawn_and_returning_cells(spark):
    rows = [("a", "2000-01-01", "2000-01-07", 1.0), ("a", "2000-01-01", "2000-01-14", None), ("a", "2000-01-01", "2000-01-21", 1.0)]
    facts = spark.createDataFrame([("m", s, day(p), day(r), v) for s, p, r, v in rows], "model string, series_id string, period date, release_date date, value double")
    weeks = [day("2000-01-07") + dt.timedelta(7 * k) for k in range(3)]
    have = spark.createDataFrame([("m", w) for w in weeks], "model string, vintage date")
    schedule = have.selectExpr("'2000_q1' AS quarter", "vintage")
    pairs = asof.vintage_pairs(schedule, have)
    status = [(r["vintage"], r["status"]) for r in news.vintage_diff(asof.changed_cells(facts, pairs)).orderBy("vintage").collect()]
    assert status == [(weeks[1], "withdrawn"), (weeks[2], "released")]
    assert {r["vintage"]: r["cells"] for r in asof.known_cells(facts, have).collect()} == dict(zip(weeks, (1, 0, 1)))


def test_missing_parameters_keep_their_rows(spark):
    schedule = spark.createDataFrame([("2017_q1", day("2016-12-30")), ("2017_q1", day("2017-01-06"))], "quarter string, vintage date")
    cat = spark.createDataFrame([("2017_q1", day("2017-01-06"))], "param_quarter string, est_vintage date")
    rows = asof.select_params(schedule, cat).orderBy("vintage").collect()
    assert [(r["est_vintage"], r["missing"]) for r in rows] == [(None, "no parameters for 2016_q4"), (day("2017-01-06"), None)]


def test_decomposition_counts_what_it_checked(spark):
    rows = [("m", "q", 1.0, 2.0, 0.25, 0.75), ("m", "q", 1.0, 2.0, 0.25, 0.5), ("m", "q", 1.0, 2.0, None, 0.5), ("m", "r", 0.0, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "model string, quarter string, y_old double, y_new double, impact_revisions double, impact_releases double")
    assert {r["quarter"]: (r["checked"], r["gaps"]) for r in news.check_decomposition(table).collect()} == {"q": (3, 2), "r": (1, 0)}


def _pairs(spark):
    old = obs_frame(spark, {"a": [1, 2, None], "b": [5, None, None], "gone": [7]}, vintage="2017-01-06")
    new = obs_frame(spark, {"a": [1, 3, 4], "b": [5, 6, 8], "gone": [None]}, vintage="2017-01-13")
    schedule = spark.createDataFrame(
        [("2017_q1", day("2017-01-06")), ("2017_q1", day("2017-01-13"))], "quarter string, vintage date"
    )
    return asof.pair_vintages(schedule, old.unionByName(new))


def test_cells_are_classified(spark):
    status = {(r["series_id"], r["period"].month): r["status"] for r in news.vintage_diff(_pairs(spark)).collect()}
    assert status == {
        ("a", 1): "unchanged", ("a", 2): "revised", ("a", 3): "released", ("b", 1): "unchanged",
        ("b", 2): "released", ("b", 3): "released", ("gone", 1): "withdrawn",
    }
    assert news.released_cells(_pairs(spark)).count() == 3 and news.revised_cells(_pairs(spark)).count() == 1
    view = {(r["series_id"], r["period"].month): r["revised"] for r in news.revised_view(_pairs(spark)).collect()}
    assert view[("a", 2)] == 3 and view[("a", 3)] is None


def test_two_periods_of_one_series_both_count(spark):
    pairs = _pairs(spark)
    forecasts = pairs.select("model", "quarter", "vintage", "series_id", "period", F.lit(1.0).alias("forecast"))
    weights = spark.createDataFrame([("m", "a", 2.0), ("m", "b", 0.5)], "model string, series_id string, weight double")
    rows = news.release_impacts(news.news(pairs, forecasts), weights, ["model", "series_id"])
    total = news.total_impact(rows).first()["impact_releases"]
    assert total == pytest.approx(2 * (4 - 1) + 0.5 * (6 - 1) + 0.5 * (8 - 1))


@pytest.mark.parametrize("hot", [False, True])
def test_asof_join_matches_merge_asof(spark, hot):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2000-01-01")
    key = lambda n: rng.choice(["x", "y", "z"], n, p=[0.9, 0.05, 0.05] if hot else None)
    left = pd.DataFrame({"k": key(300), "t": base + pd.to_timedelta(rng.integers(0, 900, 300), "D"), "id": range(300)})
    right = pd.DataFrame({"k": key(80), "t": base + pd.to_timedelta(rng.choice(900, 80, replace=False), "D"), "v": rng.normal(size=80)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k").set_index("id")["v"]
    dates = lambda df: spark.createDataFrame(df.assign(t=df["t"].dt.date))
    got = asof.asof_join(dates(left), dates(right).withColumnRenamed("t", "u"), ["k"], "t", "u", ["v"])
    rows = got.collect()
    assert len(rows) == 300
    for r in rows:
        w = want[r["id"]]
        assert (r["v"] is None and np.isnan(w)) or r["v"] == w


def test_backfill_prefers_base_and_adds_absent_series(spark):
    base = spark.createDataFrame(
        [("m", day("2010-01-01"), "a", day(f"2000-0{k}-01"), v) for k, v in [(1, 1.0), (2, None), (3, 3.0)]], OBS_DDL
    )
    extra = obs_frame(spark, {"a": [9, 9, 9, 9], "b": [None, 5, None, 6]})
    got = {(r["series_id"], r["period"].month): r["value"] for r in asof.backfill(base, extra).collect()}
    assert got == {("a", 1): 1, ("a", 2): 9, ("a", 3): 3, ("b", 1): None, ("b", 2): 5, ("b", 3): None}


def test_parameters_switch_at_quarter_start_and_stay(spark):
    schedule = spark.createDataFrame(
        [("2017_q1", day(d)) for d in ("2016-12-30", "2017-01-06", "2017-04-21")], "quarter string, vintage date"
    )
    cat = spark.createDataFrame(
        [("2016_q4", day("2016-10-07")), ("2017_q1", day("2017-01-06")), ("2017_q2", day("2017-04-07"))],
        "param_quarter string, est_vintage date",
    )
    got = {str(r["vintage"]): (r["params_used"], r["param_quarter"]) for r in asof.select_params(schedule, cat).collect()}
    assert got == {"2016-12-30": ("prev", "2016_q4"), "2017-01-06": ("curr", "2017_q1"), "2017-04-21": ("curr", "2017_q1")}


def test_schedule_has_22_fridays(spark):
    quarters = spark.createDataFrame([("2017_q1",), ("2018_q4",)], "quarter string")
    rows = asof.tracking_schedule(quarters).groupBy("quarter").agg(
        F.count("*").alias("n"), F.min("vintage").alias("lo"), F.max("vintage").alias("hi")
    ).collect()
    got = {r["quarter"]: (r["n"], str(r["lo"]), str(r["hi"])) for r in rows}
    assert got == {"2017_q1": (22, "2016-12-02", "2017-04-28"), "2018_q4": (22, "2018-08-31", "2019-01-25")}
