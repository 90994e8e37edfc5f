import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import day, month, obs_frame, series_of, spec_frame
from tidemark.functions import calendar as cal
from tidemark.operators import panel

CODES = ["lin", "chg", "ch1", "pch", "pc1", "pca", "log", "cch", "cca"]


def plain_transform(x, code, freq):
    """The formulas written out on a dense list with None for missing."""
    step = 1 if freq == "m" else 3
    out = []
    for t, v in enumerate(x):
        prev = x[t - step] if t >= step else None
        year = x[t - 12] if t >= 12 else None
        grid = freq == "m" or t % 3 == 2
        r = None
        if code == "lin":
            r = v
        elif code == "log":
            r = math.log(v) if v is not None and v > 0 else None
        elif not grid or v is None:
            r = None
        elif code == "chg" and prev is not None:
            r = v - prev
        elif code == "ch1" and year is not None:
            r = v - year
        elif code == "pch" and prev:
            r = 100 * (v / prev - 1)
        elif code == "pc1" and year:
            r = 100 * (v / year - 1)
        elif code == "pca" and prev:
            r = 100 * ((v / prev) ** (12 / step) - 1)
        elif code in ("cch", "cca") and prev is not None and v > 0 and prev > 0:
            r = 100 * (math.log(v) - math.log(prev)) * (12 / step if code == "cca" else 1)
        out.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_transformations_match_plain_formulas(spark, seed):
    rng = np.random.default_rng(seed)
    series, entries = {}, []
    for code in CODES:
        for freq in "mq":
            x = list(np.round(rng.normal(2, 2, 40), 3))
            x[5] = 0.0
            for t in rng.choice(np.arange(1, 39), 8, replace=False):
                x[t] = None
            if freq == "q":
                x = [v if t % 3 == 2 else None for t, v in enumerate(x)]
            series[f"{code}_{freq}"] = x
            entries.append((f"{code}_{freq}", freq, code, ["Global"]))
    series["edge"] = [1.0] * 40
    entries.append(("edge", "m", "lin", ["Global"]))
    obs, spec = obs_frame(spark, series), spec_frame(spark, entries)
    got = series_of(panel.transform_series(panel.dense_monthly(panel.with_spec(obs, spec))), "x")
    for name, x in series.items():
        code, freq = (name.split("_") + ["m"])[:2] if name != "edge" else ("lin", "m")
        want = plain_transform(x, code, freq)
        have = [got[name][month("2000-01-01", t)] for t in range(40)]
        for t, (a, b) in enumerate(zip(have, want)):
            assert (a is None) == (b is None), (name, t, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9), (name, t)


def test_unknown_codes_raise(spark):
    obs = obs_frame(spark, {"a": [1, 2, 3]})
    for freq, code in [("m", "zzz"), ("w", "lin")]:
        spec = spec_frame(spark, [("a", freq, code, ["Global"])])
        grid = panel.dense_monthly(panel.with_spec(obs, spec))
        with pytest.raises(Exception, match="zzz|unsupported frequency"):
            panel.transform_series(grid).collect()


def test_dense_grid_covers_panel_edges_and_horizon(spark):
    obs = obs_frame(spark, {"a": [1, None, None, 4], "b": [None, 2, None, None, None, 6]})
    dense = series_of(panel.dense_monthly(obs))
    assert sorted(dense["a"]) == sorted(dense["b"]) == [month("2000-01-01", t) for t in range(6)]
    assert dense["b"][day("2000-01-01")] is None and dense["b"][day("2000-02-01")] == 2
    longer = series_of(panel.extend_horizon(obs, 12))
    assert len(longer["a"]) == 18 and longer["a"][month("2000-01-01", 17)] is None


def test_standardise_and_back(spark):
    obs = obs_frame(spark, {"a": [1, 2, 3, 10], "flat": [5, 5, 5, 5]})
    z = panel.standardise(obs)
    got = series_of(z, "z")
    x = np.array([1, 2, 3, 10.0])
    assert [got["a"][month("2000-01-01", t)] for t in range(4)] == pytest.approx((x - x.mean()) / x.std(ddof=1))
    assert set(got["flat"].values()) == {None}
    back = series_of(panel.destandardise(z, panel.scale_stats(obs)), "x")
    assert back["a"][day("2000-04-01")] == pytest.approx(10)


def spline_through(values):
    """The spline by a dense solve: second derivatives m, third derivative continuous at the end knots."""
    out = np.array(values, float)
    t = np.flatnonzero(~np.isnan(out)).astype(float)
    n = len(t)
    if n < 2:
        return out
    y, h = out[t.astype(int)], np.diff(t)
    m = np.zeros(n)
    if n > 2:
        lhs, rhs = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            lhs[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        lhs[0, :3], lhs[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
        if n == 3:
            lhs[0], lhs[2] = (1, -1, 0), (0, 1, -1)
        m = np.linalg.solve(lhs, rhs)
    for k in range(n - 1):
        for x in range(int(t[k]) + 1, int(t[k + 1])):
            u, v = (t[k + 1] - x) / h[k], (x - t[k]) / h[k]
            out[x] = u * y[k] + v * y[k + 1] + ((u**3 - u) * m[k] + (v**3 - v) * m[k + 1]) * h[k] ** 2 / 6
    return out


def test_spline_against_a_dense_solve(spark):
    rng = np.random.default_rng(12)
    t = np.arange(40.0)
    series = {"cubic": 0.3 * t**3 - 2 * t**2 + t - 5, "all": rng.normal(size=40), "none": np.full(40, np.nan)}
    series["cubic"][[0, 1, 5, 6, 7, 12, 20, 39]] = np.nan
    for k in (1, 2, 3, 4, 5, 9, 25):
        x = np.full(40, np.nan)
        at = rng.choice(40, k, replace=False)
        x[at] = rng.normal(size=k) * 10
        series[f"k{k}"] = x
    frame = obs_frame(spark, {n: [None if np.isnan(v) else v for v in x] for n, x in series.items()})
    got = series_of(panel.interpolate_cubic(panel.dense_monthly(frame)))
    for name, x in series.items():
        if name in got:
            want = [None if np.isnan(v) else v for v in spline_through(x)]
            assert [got[name][month("2000-01-01", k)] for k in range(40)] == [w if w is None else pytest.approx(w, rel=1e-9, abs=1e-9) for w in want], name
    assert len(got) == len(series) - 1  # a series without values has no rows
    assert "InPandas" not in panel.interpolate_cubic(panel.dense_monthly(frame))._jdf.queryExecution().toString()


def test_cubic_operator_and_fill_methods(spark):
    x = [1.0, 8.0, None, 64.0, 125.0, None, 343.0, 512.0]
    got = series_of(panel.interpolate_cubic(panel.dense_monthly(obs_frame(spark, {"a": x}))))["a"]
    assert got[month("2000-01-01", 2)] == pytest.approx(27) and got[month("2000-01-01", 5)] == pytest.approx(216)
    series = {"a": [1, None, 3, 4, 5, None, 7, 8], "b": [None, None, 2, 2, 2, 2, 2, None], "c": [1, 1, 1, 1, 1, 1, 1, 1]}
    dense = panel.dense_monthly(obs_frame(spark, series))
    for method in (1, 2, 4, 5):
        rows = panel.fill_missing(dense, method).collect()
        assert all(r["value"] is not None for r in rows)
        for r in rows:
            t = (r["period"].year - 2000) * 12 + r["period"].month - 1
            if series[r["series_id"]][t] is not None:
                assert r["value"] == series[r["series_id"]][t] and not r["was_missing"]
    assert any(r["value"] is None for r in panel.fill_missing(dense, 3).collect())
    with pytest.raises(ValueError):
        panel.fill_missing(dense, 6)


def test_trim_uses_true_runs(spark):
    a = [None, None, 1, None, 1, 1, None]
    series = {f"s{k}": a for k in range(5)} | {"t": [1, None, 1, None, 1, 1, 1]}
    dense = panel.dense_monthly(obs_frame(spark, series))
    kept = sorted({r["period"] for r in panel.trim_edges(dense, 0.8).collect()})
    assert kept == [month("2000-01-01", t) for t in range(2, 6)]
    assert len({r["period"] for r in panel.trim_edges(dense, 1.0).collect()}) == 7


def test_smoothing_extends_ends(spark):
    x = [None, 2.0, 4.0, 6.0, 8.0, None]
    df = panel.dense_monthly(obs_frame(spark, {"a": x, "b": [1] * 6}))
    out = series_of(panel.fill_missing(df, 1, k=1))["a"]
    # the median of 2, 4, 6, 8 is 5; the window of the first row is (5, 5, 2)
    assert out[day("2000-01-01")] == pytest.approx(4.0)
    assert out[day("2000-06-01")] == pytest.approx(6.0)


def test_summary_uses_true_last_date_and_first_extreme(spark):
    obs = obs_frame(spark, {"a": [3, 1, None, 1, 3], "b": [2]})
    spec = spec_frame(spark, [("a", "m", "pch", ["Global"]), ("b", "q", "pca", ["Global"])])
    rows = {r["series_id"]: r for r in panel.summarise_series(obs, spec).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["observations"], a["last_period"]) == (4, month("2000-01-01", 4))
    assert a["min_period"] == day("2000-02-01") and a["max_period"] == day("2000-01-01")
    assert a["unit"] == "MoM %" and b["unit"] == "QoQ AR %" and b["sd"] is None


def test_calendar(spark):
    row = spark.range(1).select(
        cal.last_friday(F.lit(2017), F.lit(3)).alias("on_last_day"),
        cal.last_friday(F.lit(2017), F.lit(4)).alias("april"),
        cal.target_month(F.lit("2017q1")).alias("q"), cal.target_month(F.lit("2017_q4")).alias("q4"),
        cal.target_month(F.lit("2017m11")).alias("m"),
        cal.publication_month_end(F.lit("2016_q4")).alias("pub"),
        cal.previous_quarter(F.lit("2017_q1")).alias("prev"),
        cal.chart_window_start(F.lit("2017_q1")).alias("ws"), cal.chart_window_end(F.lit("2017_q1")).alias("we"),
        F.size(cal.fridays_between(F.lit(day("2017-01-07")), F.lit(day("2017-01-12")))).alias("none"),
        cal.fridays_between(F.lit(day("2017-01-06")), F.lit(day("2017-01-20"))).alias("three"),
    ).first()
    assert row["on_last_day"] == day("2017-03-31") and row["april"] == day("2017-04-28")
    assert row["q"] == day("2017-03-01") and row["q4"] == day("2017-12-01") and row["m"] == day("2017-11-01")
    assert row["pub"] == day("2017-01-31") and row["prev"] == "2016_q4"
    assert row["ws"] == day("2016-11-25") and row["we"] == day("2017-04-28")
    assert row["none"] == 0 and [str(x) for x in row["three"]] == ["2017-01-06", "2017-01-13", "2017-01-20"]
    with pytest.raises(Exception, match="horizon"):
        spark.range(1).select(cal.checked_target_month(F.lit("2019q1"), F.lit(day("2017-03-01")))).collect()


def test_monthly_last_skips_nulls(spark):
    rows = [("a", day("2000-01-03"), 1.0), ("a", day("2000-01-20"), 2.0), ("a", day("2000-01-25"), None)]
    raw = spark.createDataFrame(rows, "k string, d date, v double")
    assert [tuple(r) for r in panel.to_monthly_last(raw, ["k"], "d", "v").collect()] == [("a", day("2000-01-01"), 2.0)]
