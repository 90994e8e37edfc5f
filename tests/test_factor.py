import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import day, month
from tidemark.operators import factor
from tidemark.schema import OBS_DDL


def frame(spark, x, names=None, model="m"):
    names = names or [f"s{i}" for i in range(x.shape[1])]
    rows = [
        (model, day("2005-01-07"), n, month("2000-01-01", t), None if np.isnan(x[t, i]) else float(x[t, i]))
        for t in range(len(x)) for i, n in enumerate(names)
    ]
    return spark.createDataFrame(rows, OBS_DDL).withColumnRenamed("value", "z")


def leading(cov):
    v = np.linalg.eigh(cov)[1][:, -1]
    return -v if v.sum() < 0 else v


def test_gram_over_common_periods(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    got = {(r["series_i"], r["series_j"]): (r["n"], r["cov"]) for r in factor.panel_gram(frame(spark, x)).collect()}
    assert len(got) == 15
    for i in range(5):
        for j in range(i, 5):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, cov = got[(f"s{i}", f"s{j}")]
            assert n == ok.sum() and cov == pytest.approx(np.cov(x[ok, i], x[ok, j])[0, 1])


def test_first_factor_matches_eigh(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 1)) * [1, 2, 0.5] + rng.normal(size=(30, 3))
    y = rng.normal(size=(25, 2)) * [3, 1] + 1e6  # far from zero: raw moments would lose the digits
    z = frame(spark, x).unionByName(frame(spark, y, ["a", "b"], "other"))
    loadings, scores = factor.first_factor(z)
    got = {(r["model"], r["series_id"]): r["loading"] for r in loadings.collect()}
    v, w = leading(np.cov(x, rowvar=False)), leading(np.cov(y, rowvar=False))
    assert [got["m", f"s{i}"] for i in range(3)] == pytest.approx(list(v))
    assert [got["other", n] for n in "ab"] == pytest.approx(list(w), abs=1e-7)
    assert [r["f"] for r in scores.where("model = 'm'").orderBy("period").collect()] == pytest.approx(list(x @ v))


def test_blocks_are_solved_side_by_side(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 1)) * [1, 2, 0.5, 1] + rng.normal(size=(30, 4))
    spec = spark.createDataFrame(
        [("m", f"s{i}", ["all", "even" if i % 2 == 0 else "odd"]) for i in range(4)], "model string, series_id string, blocks array<string>"
    )
    by = ["model", "vintage", "block"]
    loadings, scores = factor.first_factor(factor.in_blocks(frame(spark, x), spec), by=by)
    got = {(r["block"], r["series_id"]): r["loading"] for r in loadings.collect()}
    for block, cols in (("all", [0, 1, 2, 3]), ("even", [0, 2]), ("odd", [1, 3])):
        assert [got[block, f"s{i}"] for i in cols] == pytest.approx(list(leading(np.cov(x[:, cols], rowvar=False))))
    assert scores.groupBy("block").count().count() == 3


def test_close_eigenvalues_and_blocks_without_variance(spark):
    def gram(rows):
        keyed = [("m", day("2005-01-07"), a, b, 9, v) for a, b, v in rows]
        return spark.createDataFrame(keyed, "model string, vintage date, series_i string, series_j string, n int, cov double")

    near = factor.leading_vector(gram([("a", "a", 1.0), ("a", "b", -0.5), ("b", "b", 1.0), ("b", "c", -0.5), ("a", "c", -0.5), ("c", "c", 1.001)]))
    x = np.array([r["loading"] for r in near.orderBy("series_id").collect()])
    g = np.array([[1, -0.5, -0.5], [-0.5, 1, -0.5], [-0.5, -0.5, 1.001]])
    assert np.linalg.norm(x) == pytest.approx(1) and np.linalg.norm(g @ x - (x @ g @ x) * x) < 1e-6
    # the largest eigenvalue counts, not the largest in size
    signed = factor.leading_vector(gram([("a", "a", -3.0), ("a", "b", 0.0), ("b", "b", 1.0)])).collect()
    assert {r["series_id"]: round(abs(r["loading"]), 9) for r in signed} == {"a": 0.0, "b": 1.0}
    flat = factor.leading_vector(gram([("a", "a", 0.0), ("a", "b", None), ("b", "b", 0.0)])).collect()
    assert len(flat) == 2 and all(r["loading"] is None for r in flat)


def test_several_factors_match_eigh(spark):
    """Blocks side by side: flat spectrum, a value far below 0, fewer series than directions, no variance."""
    rng = np.random.default_rng(5)
    flat = np.cov(rng.normal(size=(40, 14)), rowvar=False)
    q = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    signed = q @ np.diag([-9.0, 5, 4, 3.9, 1, 0.5, 0.2, 0, -0.1, -6]) @ q.T
    blocks = {"flat": flat, "signed": signed, "pair": np.array([[2.0, 0.5], [0.5, 1.0]]), "none": np.zeros((3, 3))}
    rows = [
        (name, day("2005-01-07"), f"s{i:02}", f"s{j:02}", 9, float(g[i, j]))
        for name, g in blocks.items() for i in range(len(g)) for j in range(i, len(g))
    ]
    gram = spark.createDataFrame(rows, "model string, vintage date, series_i string, series_j string, n int, cov double")
    got = factor.leading_vectors(gram, 3).orderBy("model", "factor", "series_id").collect()
    for name, g in blocks.items():
        values, vectors = np.linalg.eigh(g)
        for k in range(1, 4):
            mine = [r for r in got if r["model"] == name and r["factor"] == k]
            if k > len(g) or name == "none":
                assert not mine
            else:
                v = vectors[:, -k] * (-1 if vectors[:, -k].sum() < 0 else 1)
                assert [r["loading"] for r in mine] == pytest.approx(list(v), abs=1e-6)
                assert mine[0]["value"] == pytest.approx(values[-k])
    assert factor.leading_vectors(gram.where("n < 0"), 2).count() == 0


def test_autoregression_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = 1e7 + np.cumsum(rng.normal(size=50))
    rows = [("m", day("2005-01-07"), "a", month("2000-01-01", t), float(v)) for t, v in enumerate(x)]
    got = factor.ar1(spark.createDataFrame(rows, OBS_DDL), ["model", "series_id"], "value").first()
    b = (x[1:] * x[:-1]).sum() / (x[:-1] ** 2).sum()
    assert got["n"] == 49 and got["b"] == pytest.approx(b)
    assert got["residual_variance"] == pytest.approx(np.var(x[1:] - b * x[:-1], ddof=1), rel=1e-6)


def test_convergence_rule_starts_with_the_fourth_iteration(spark):
    rows = [("m", day("2005-01-07"), i + 1, v) for i, v in enumerate([-100.0, -100.0, -100.0, -100.0, -120.0])]
    trace = spark.createDataFrame(rows, "model string, est_vintage date, iteration int, loglik double")
    got = factor.em_converged(trace).orderBy("iteration").collect()
    assert [r["converged"] for r in got] == [False, False, False, True, False]
    assert [r["decreased"] for r in got] == [False, False, False, False, True]


def test_mean_by_block_keeps_every_row(spark):
    z = frame(spark, np.arange(6.0).reshape(3, 2))
    assert factor.factor_lags(z.groupBy("model", "vintage", "period").agg(F.avg("z").alias("f"))).count() == 3


def test_blocks_are_taken_one_after_the_other(spark):
    """Overlapping blocks against numpy, with a quarterly member and holes."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 1)) * [1, 2, 0.5, 1, 0.3, 1.5, 1] + rng.normal(size=(60, 7))
    x[:, 6][np.arange(60) % 3 != 2] = np.nan  # a quarterly series
    members = {"all": [0, 1, 2, 3, 4, 5, 6], "left": [0, 1, 2, 6], "mid": [2, 3, 4], "right": [4, 5, 3]}
    names = [f"s{k}" for k in range(7)]
    spec = spark.createDataFrame([("m", names[k], [b for b, m in members.items() if k in m]) for k in range(7)], "model string, series_id string, blocks array<string>")
    assert factor.waves(spec, list(members)) == [["all"], ["left"], ["mid"], ["right"]]
    assert factor.waves(spec, ["all", "left", "right", "mid"]) == [["all"], ["left", "right"], ["mid"]]
    z = frame(spark, x, names).withColumn("frequency", F.when(F.col("series_id") == "s6", "q").otherwise("m"))
    for order in (["all", "left", "mid"], ["all", "left", "right"]):
        rest = x.copy()
        for block in order:
            m = [k for k in members[block] if k != 6]
            v = leading(np.cov(rest[:, m], rowvar=False))
            f = rest[:, m] @ v
            lags = np.stack([f[4 - k : 60 - k] for k in range(5)], axis=1)
            new = rest.copy()
            new[4:, m] -= lags[:, :1] * v
            if 6 in members[block]:
                tent = lags @ [1, 2, 3, 2, 1]
                seen = ~np.isnan(rest[4:, 6])
                new[4:, 6] -= (rest[4:, 6][seen] @ tent[seen]) / (tent[seen] @ tent[seen]) * tent
            rest = new
        left, loadings, factors = factor.block_chain(z, spec, order)
        got = {(r["series_id"], r["period"]): r["residual"] for r in left.collect()}
        for k, n in enumerate(names):
            for t in range(60):
                want = rest[t, k]
                assert got[n, month("2000-01-01", t)] == (None if np.isnan(want) else pytest.approx(want, abs=1e-6))
        assert {r["block"] for r in loadings.select("block").distinct().collect()} == set(order) == {r["block"] for r in factors.select("block").distinct().collect()}
