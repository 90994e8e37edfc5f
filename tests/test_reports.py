import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import day
from tidemark.functions.student import student_p
from tidemark.operators import compare, impact, reshape, score
from tidemark.plans import reports
from tidemark.schema import NEWS_DDL

RAW = (
    "model string, quarter string, vintage date, y_old double, y_new double, impact_revisions double, "
    "impact_releases double, params_used string"
)


def nowcast(spark, rows, actual=2.0):
    raw = spark.createDataFrame(
        [("m", q, day(v), o, n, 0.25 * (n - o), 0.75 * (n - o), "curr") for q, v, o, n in rows], RAW
    )
    quarters = {r[0] for r in rows}
    actuals = spark.createDataFrame(
        [("m", q, 0.0 if q == "2020_q3" else actual) for q in quarters], "model string, quarter string, actual double"
    )
    return score.score(raw, actuals)


ROWS = [
    ("2019_q4", "2019-10-04", 1.0, 1.5), ("2019_q4", "2019-10-11", 1.5, 2.5), ("2020_q1", "2020-01-03", 0.0, 4.0),
    ("2020_q3", "2020-07-03", 1.0, 1.0), ("2021_q1", "2021-01-08", 3.0, 1.0), ("2021_q1", "2021-01-15", 1.1, 2.0),
]


def test_scores(spark):
    rows = {(r["quarter"], str(r["vintage"])): r for r in nowcast(spark, ROWS).collect()}
    a = rows[("2019_q4", "2019-10-04")]
    assert (a["error"], a["abs_error"], a["perc_error"], a["step_variance"]) == (0.5, 0.5, 0.25, 0.0625)
    assert rows[("2020_q3", "2020-07-03")]["perc_error"] is None


def test_accuracy_and_yearly_means(spark):
    table = nowcast(spark, ROWS)
    acc = {r["quarter"]: r for r in score.accuracy(table).collect()}
    assert acc["2019_q4"]["rmse"] == pytest.approx(0.5) and acc["2019_q4"]["bias"] == 0
    assert acc["2020_q3"]["mpe"] is None
    got = {r["label"]: r["mae"] for r in score.accuracy_by_year(score.accuracy(table), [2020]).collect()}
    assert got["2020"] == pytest.approx(1.5) and got["2019"] == pytest.approx(0.5) and got["2021"] == pytest.approx(0.5)
    assert got[score.ALL_YEARS] == pytest.approx(2.5 / 3) and got["Average excl. 2020"] == pytest.approx(0.5)


def test_final_rows_breaks_and_gap(spark):
    table = nowcast(spark, ROWS)
    final = {r["quarter"]: r["y_new"] for r in score.final_rows(table).collect()}
    assert final == {"2019_q4": 2.5, "2020_q1": 4.0, "2020_q3": 1.0, "2021_q1": 2.0}
    breaks = score.chain_breaks(table).collect()
    assert [(r["quarter"], r["y_old"], r["previous_y_new"]) for r in breaks] == [("2021_q1", 1.1, 1.0)]
    shown = {r["quarter"]: (r["final_nowcast"], r["actual"], str(r["published"])) for r in score.final_vs_actual(table, [2020]).collect()}
    assert shown["2020_q1"] == (None, None, "2020-04-30") and shown["2019_q4"] == (2.5, 2.0, "2020-01-31")


def test_single_row_groups_have_no_spread(spark):
    news = spark.createDataFrame(
        [("m", "2019_q1", day("2019-01-04"), "a", day("2018-12-01"), 0.0, 1.0, 1.0, 1.0)], NEWS_DDL
    )
    rows = {r["qtr"]: r["impact_sd"] for r in impact.impact_std_by_series_quarter(news, ["a"]).collect()}
    assert rows == {"q1": None, "q2": None, "q3": None, "q4": None}


def news_frame(spark):
    rows = []
    for k, s in enumerate("abcdefghijkl"):
        for year, size in ((2019, 1.0), (2020, 50.0)):
            # a..l tie in pairs outside 2020
            rows.append(("m", f"{year}_q1", day(f"{year}-01-04"), s, day(f"{year}-01-01"), 0.0, 1.0, 1.0, (-1) ** k * (k // 2) * size))
    return spark.createDataFrame(rows, NEWS_DDL)


def test_top_series_breaks_ties_by_name(spark):
    rows = impact.top_series(news_frame(spark), [2020], 3).where(F.col("sample") == "excl_years").orderBy("place").collect()
    assert [(r["series_id"], r["impact"]) for r in rows] == [("k", 5.0), ("l", 5.0), ("i", 4.0)]


def test_category_default_and_unmatched(spark):
    mapping = spark.createDataFrame([("a", "Prices"), ("b", "Labor")], "series_id string, category string")
    got = impact.with_category(news_frame(spark), mapping)
    assert got.where("category = 'Other'").select("series_id").distinct().count() == 10
    assert impact.unmatched_series(news_frame(spark), mapping).count() == 10
    sums = impact.impact_by_year_category(got).where("quarter IS NULL").collect()
    assert {(r["year"], r["category"]) for r in sums} == {(y, c) for y in (2019, 2020) for c in ("Prices", "Labor", "Other")}


def test_matrix_rejects_duplicates(spark):
    news = news_frame(spark)
    wide = reshape.impact_matrix(news, ["2019-01-04", "2020-01-03"])
    assert wide.where("series_id = 'l' AND quarter = '2019_q1'").first()["2019-01-04"] == -5.0
    with pytest.raises(Exception, match="more than one impact"):
        reshape.impact_matrix(news.unionByName(news), ["2019-01-04"]).collect()


def p_of(spark, rows):
    frame = spark.createDataFrame(rows, "t double, df double")
    return [r["p"] for r in frame.select(student_p("t", "df").alias("p")).collect()]


def t_density(x, df):
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def simpson_tail(t, df, width=60.0, n=20000):
    """Two-sided tail by quadrature of the density on a mapped axis, for moderate df."""
    h = width / n
    total = 0.0
    for k in range(n + 1):
        total += t_density(t + k * h, df) * (1 if k in (0, n) else 4 if k % 2 else 2)
    return 2 * total * h / 3


def test_p_values(spark):
    ts = (0.0, 0.3, 1.0, 2.5, -6.4, 40.0)
    assert p_of(spark, [(t, 1.0) for t in ts]) == pytest.approx([1 - 2 / math.pi * math.atan(abs(t)) for t in ts], abs=1e-12)
    assert p_of(spark, [(t, 2.0) for t in ts]) == pytest.approx([1 - abs(t) / math.sqrt(2 + t * t) for t in ts], abs=1e-12)
    assert p_of(spark, [(2.0, 10.0)])[0] == pytest.approx(0.07338803, rel=1e-6)
    assert p_of(spark, [(float("nan"), 5.0), (1.0, 0.0), (None, 3.0), (1.0, None)]) == [None] * 4


def test_p_values_of_every_size(spark):
    got = p_of(spark, [(t, float(df)) for df in (9, 30, 101, 1000) for t in (0.5, 2.0, 3.5)])
    want = [simpson_tail(t, df) for df in (9, 30, 101, 1000) for t in (0.5, 2.0, 3.5)]
    assert got == pytest.approx(want, rel=1e-5, abs=1e-9)
    # On both sides of the switch, and towards the normal distribution.
    for t in (0.1, 1.0, 1.96, 3.0, 5.0):
        below, above = p_of(spark, [(t, 1000.0), (t, 1001.0)])
        assert 0 <= below - above < 2e-3 * below
        large = p_of(spark, [(t, float(df)) for df in (10**3, 10**4, 10**5, 10**6, 10**9)])
        normal = math.erfc(t / math.sqrt(2))
        assert all(a >= b - 1e-12 for a, b in zip(large, large[1:])) and large[-1] == pytest.approx(normal, rel=1e-7)
        assert large[1] == pytest.approx(simpson_tail(t, 10**4, 12.0), rel=1e-7)


def test_pairing_by_vintage_and_position(spark):
    a = nowcast(spark, ROWS)
    b = a.where("vintage <> DATE '2021-01-08'")
    assert compare.pair_models(a, b).count() == 5
    pos = compare.pair_models(a, b, positional=True)
    assert pos.count() == 6 and pos.where("error_b IS NULL").count() == 1
    table = {r["sample"]: (r["observations"], r["pairs"]) for r in compare.compare_models(pos, 2020).collect()}
    assert table == {"Full sample": (6, 5), "Excluding 2020": (4, 3), "Pre-2020": (2, 2), "Post-2020": (2, 1)}


def test_report_views(spark):
    table, news = nowcast(spark, ROWS), news_frame(spark)
    mapping = spark.createDataFrame([("a", "Prices")], "series_id string, category string")
    for view in (
        reports.quarter_report(table, news, mapping, "2019_q1"), reports.year_report(table, news, mapping, 2019),
        reports.history_report(table, news, mapping, [2020]),
    ):
        for name, df in view.items():
            assert df.columns and df.count() >= 0, name
