"""Checks against published result files; the glob patterns come from the environment."""

import os

import pytest

from tidemark.operators import compare, score
from tidemark.sources import files

NAMES = ["GOLDEN_RESULTS_A", "GOLDEN_RESULTS_B", "GOLDEN_METRICS_A", "GOLDEN_METRICS_B"]
PATHS = [os.environ.get(n) for n in NAMES]
pytestmark = pytest.mark.skipif(not all(PATHS), reason="published result files not given")


@pytest.fixture(scope="module")
def tables(spark):
    a, b = (files.read_result_files(spark, p, "x").cache() for p in PATHS[:2])
    return a, b, [files.read_metric_files(spark, p, "x") for p in PATHS[2:]]


def test_metrics_agree(tables):
    for results, metrics in zip(tables[:2], tables[2]):
        want = {r["quarter"]: r for r in metrics.collect()}
        got = {r["quarter"]: r for r in score.accuracy(results).collect()}
        assert len(want) == 34 and got.keys() == want.keys()
        for q in want:
            for c in ("rmse", "mae", "bias", "mpe"):
                assert got[q][c] == pytest.approx(want[q][c], abs=1e-9, rel=1e-9)


def test_yearly_means(tables):
    expected = [(3.2195, 1.8745, 2.9550, 1.6849, -0.0231, 0.0403), (3.1821, 1.8075, 2.9247, 1.6273, -0.0960, 0.0097)]
    for results, want in zip(tables[:2], expected):
        rows = {r["label"]: r for r in score.accuracy_by_year(score.accuracy(results), [2020]).collect()}
        every, some = rows[score.ALL_YEARS], rows["Average excl. 2020"]
        got = (every["rmse"], some["rmse"], every["mae"], some["mae"], every["bias"], some["bias"])
        assert got == pytest.approx(want, abs=1e-4)


def test_chain_breaks_and_step_variance(tables):
    for results, rows in zip(tables[:2], (650, 652)):
        assert results.count() == rows and score.chain_breaks(results, 1e-6).count() == 44
        off = score.nowcast_changes(results).join(
            results.select("quarter", "vintage", results["step_variance"].alias("given")), ["quarter", "vintage"]
        ).where("abs(step_variance - given) > 1e-9")
        assert off.count() == 0


def test_model_comparison(tables):
    a, b, _ = tables
    positional = {
        "Full sample": (652, 650, -0.765919, 1.819420, 4.409300),
        "Excluding 2020": (575, 573, 6.401208, 6.481126, 2.780380),
        "Pre-2020": (228, 228, 5.615409, 3.890477, -2.963733),
        "Post-2020": (347, 345, 5.977687, 5.631063, 3.927810),
    }
    by_vintage = {
        "Full sample": (650, 650, -0.763748, 1.848993, 4.562498),
        "Excluding 2020": (573, 573, 6.428062, 6.678045, 3.122396),
        "Pre-2020": (228, 228, 5.615409, 3.890477, -2.963733),
        "Post-2020": (345, 345, 6.005404, 5.826010, 4.382202),
    }
    for mode, want in ((True, positional), (False, by_vintage)):
        table = compare.compare_models(compare.pair_models(a, b, mode), 2020)
        for r in table.collect():
            got = (r["observations"], r["pairs"], r["t_squared"], r["t_absolute"], r["t_signed"])
            assert got == pytest.approx(want[r["sample"]], abs=1e-5)
            assert 0 <= r["p_squared"] <= 1
