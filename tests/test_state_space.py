import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import obs_frame
from tidemark.operators import factor, panel, state_space as ss


def steps_of():
    return ss.month_number(F.col("period"))


def dense_series(spark, lengths=(9, 40, 1), seed=4):
    rng = np.random.default_rng(seed)
    series = {}
    for k, n in enumerate(lengths):
        x = list(np.cumsum(rng.normal(size=n)) * 2 + 50 + rng.normal(size=n))
        for i in range(2, n - 1):
            if rng.random() < 0.2:
                x[i] = None
        series[f"s{k}"] = x
    padded = {name: x + [None] * (max(lengths) - len(x)) for name, x in series.items()}  # the grid ends with the panel
    return padded, panel.dense_monthly(obs_frame(spark, series))


def kalman(xs, q, r):
    """Filter and smoother step by step, the state before the first step included."""
    a, p, ll = [ss.START], [ss.SPREAD], 0.0
    for x in xs:
        level, spread = a[-1], p[-1] + q
        if x is not None:
            f = spread + r
            ll -= 0.5 * (np.log(f) + (x - level) ** 2 / f)
            level, spread = level + spread / f * (x - level), spread * r / f
        a.append(level)
        p.append(spread)
    s, v, lag = a[:], p[:], [None] * len(a)
    for t in range(len(xs) - 1, -1, -1):
        g = p[t] / (p[t] + q)
        s[t] = a[t] + g * (s[t + 1] - a[t])
        v[t] = p[t] + g * g * (v[t + 1] - p[t] - q)
        lag[t + 1] = g * v[t + 1]
    return a, p, ll, s, v, lag


@pytest.mark.parametrize("width", [3, 64])
def test_scan_and_smoother_equal_the_recursion(spark, width):
    series, obs = dense_series(spark)
    ends = {r["series_id"]: r for r in ss.local_level_scan(obs, steps_of(), 4.0, 25.0, width=width).collect()}
    steps = {}
    for r in ss.smooth_levels(obs, steps_of(), 4.0, 25.0, width=width).orderBy("t").collect():
        steps.setdefault(r["series_id"], []).append(r)
    assert set(ends) == set(steps) == set(series)
    for name, xs in series.items():
        a, p, ll, s, v, lag = kalman(xs, 4.0, 25.0)
        end = ends[name]
        assert (end["level"], end["variance"], end["loglik"]) == pytest.approx((a[-1], p[-1], ll))
        assert end["observations"] == sum(x is not None for x in xs)
        for k, r in enumerate(steps[name], 1):
            got = (r["filtered"], r["filtered_variance"], r["level"], r["variance"], r["lag_cov"])
            assert got == pytest.approx((a[k], p[k], s[k], v[k], lag[k]))


def test_scan_equals_the_fold(spark):
    _, obs = dense_series(spark, (30, 7, 12))
    cols = ["series_id", "level", "variance", "loglik", "observations"]
    fold = {r[0]: r[1:] for r in factor.local_level(obs, 4.0, 25.0).select(cols).collect()}
    scan = {r[0]: r[1:] for r in ss.local_level_scan(obs, steps_of(), 4.0, 25.0, width=4).select(cols).collect()}
    assert fold.keys() == scan.keys()
    for name in fold:
        assert scan[name] == pytest.approx(fold[name])


def test_no_list_is_longer_than_a_bucket(spark):
    _, obs = dense_series(spark, (200,))
    assert ss.bucketed(obs, steps_of(), width=5).select(F.max(F.size("xs"))).first()[0] == 5
    buckets = ss.bucketed(obs, steps_of(), width=5)
    assert ss.levels_of(buckets, 5) == 3
    items = buckets.select("series_id", ss._positions(buckets).alias("pos"), F.array(F.col("bucket")).alias("e"))
    got = ss.compositions(items, ["series_id"], F.concat, F.array().cast("array<bigint>"), 3, 5).orderBy("pos").collect()
    every = sorted(r["bucket"] for r in buckets.collect())
    assert [r["before"] for r in got] == [every[:k] for k in range(len(every))]


def fit(xs, rounds, threshold):
    q = r = np.var([x for x in xs if x is not None], ddof=1) * 0.5
    out = []
    for k in range(1, rounds + 1):
        a, p, ll, s, v, lag = kalman(xs, q, r)
        moved = sum((s[t] - s[t - 1]) ** 2 + v[t] + v[t - 1] - 2 * lag[t] for t in range(1, len(s)))
        missed = [(x - s[t]) ** 2 + v[t] for t, x in enumerate(xs, 1) if x is not None]
        out.append((q, r, ll))
        q, r = moved / len(xs), np.mean(missed)
        if k >= 4 and abs(out[-1][2] - out[-2][2]) < threshold * (abs(out[-1][2]) + abs(out[-2][2])) / 2:
            break
    return out


def test_fit_matches_plain_rounds_and_resumes(spark):
    series, obs = dense_series(spark, (40, 25, 30), 6)
    flat = obs.unionByName(panel.dense_monthly(obs_frame(spark, {"flat": [3.0] * 5})), allowMissingColumns=True)
    whole = ss.fit_local_level(flat, steps_of(), 5, 0.01, width=16)
    trace = {}
    for r in whole.orderBy("iteration").collect():
        trace.setdefault(r["series_id"], []).append(r)
    assert set(trace) == set(series)  # a series without variance isn't fitted
    for name, xs in series.items():
        want = fit(xs, 5, 0.01)
        assert [(r["level_var"], r["noise_var"], r["loglik"]) for r in trace[name]] == [pytest.approx(w, rel=1e-5) for w in want]
        assert not any(r["decreased"] for r in trace[name])
        assert all(b["loglik"] >= a["loglik"] - 1e-7 for a, b in zip(trace[name], trace[name][1:]))
        assert [r["converged"] for r in trace[name][:-1]] == [False] * (len(want) - 1)
    assert len({len(rows) for rows in trace.values()}) > 1  # they stop at different rounds
    part = ss.fit_local_level(flat, steps_of(), 4, 0.01, width=16)
    resumed = ss.fit_local_level(flat, steps_of(), 5, 0.01, width=16, trace=part)
    key = lambda r: (r["series_id"], r["iteration"])
    for a, b in zip(sorted(whole.collect(), key=key), sorted(resumed.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["loglik"] == pytest.approx(b["loglik"])


def test_empty_panel(spark):
    empty = panel.dense_monthly(obs_frame(spark, {"a": [1.0, 2.0]})).limit(0)
    assert ss.local_level_scan(empty, steps_of(), 4.0, 25.0).count() == 0
    assert ss.smooth_levels(empty, steps_of(), 4.0, 25.0).count() == 0
    assert ss.fit_local_level(empty, steps_of(), 2).count() == 0


def test_news_of_a_level_add_up(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(4):
        old = [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=30).cumsum()]
        new = [(v + 0.5 if rng.random() < 0.2 else v) if v is not None else (float(rng.normal()) if rng.random() < 0.4 else None) for v in old]
        rows += [(f"u{k}", t, a, b) for t, (a, b) in enumerate(zip(old, new), 100)]
        rev = [b if a is not None else None for a, b in zip(old, new)]
        want[f"u{k}"] = [kalman(x, 0.2, 1.0)[0][-1] for x in (old, rev, new)]
        smooth = kalman(rev, 0.2, 1.0)[3]
        want[f"u{k}"].append({100 + t: smooth[t + 1] for t, (a, b) in enumerate(zip(old, new)) if a is None and b is not None})
    rows += [("same", t, 1.0 * t, 1.0 * t) for t in range(100, 105)] + [("gone", 100, 1.0, None), ("gone", 101, 2.0, 2.0)]
    cells = spark.createDataFrame(rows, "u string, t bigint, old double, new double")
    for width in (4, 64):
        head, detail = ss.level_news(cells, ["u"], F.col("t"), 0.2, 1.0, width)
        got = {r["u"]: r for r in head.collect()}
        assert set(got) == {*want, "same", "gone"}
        for u, (y_old, y_rev, y_new, forecasts) in want.items():
            r = got[u]
            assert (r["y_old"], r["y_rev"], r["y_new"]) == pytest.approx((y_old, y_rev, y_new))
            assert (r["impact_revisions"], r["impact_releases"]) == pytest.approx((y_rev - y_old, y_new - y_rev), abs=1e-9)
            released = {d["t"]: d["forecast"] for d in detail.where((F.col("u") == u) & (F.col("kind") == "release")).collect()}
            assert released == {t: pytest.approx(f) for t, f in forecasts.items()} and len(released) == r["releases"] > 1
        for u in ("same", "gone"):
            assert (got[u]["impact_revisions"], got[u]["impact_releases"], got[u]["revisions"], got[u]["releases"]) == (0, 0, 0, 0)
