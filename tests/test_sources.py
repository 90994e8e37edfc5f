import pytest
from pyspark.sql import functions as F

from tests.helpers import day
from tidemark.schema import NEWS_DDL, PARAMS_DDL
from tidemark.sources import files
from tests.test_reports import ROWS, nowcast

HEADER = "Model,Series ID,SeriesName,Frequency,Units,Transformation,Category,Block1-Global,Block2-Soft\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_spec_sheet(spark, tmp_path):
    path = write(tmp_path / "spec.csv", HEADER + (
        "1,Q,Quarterly,q,Index,pca,Output,1,\n1,M,Monthly,m,USD,pch,Prices,1,1\n0,X,Unused,m,USD,lin,Prices,0,\n"
        "1,D,Daily,d,USD,lin,Prices,1,0\n1,Z,Odd,zz,USD,lin,Prices,1,0\n"
    ))
    rows = files.read_spec(spark, path, "base").orderBy("spec_pos").collect()
    assert [(r["series_id"], r["spec_pos"], r["blocks"]) for r in rows] == [
        ("D", 1, ["Global"]), ("M", 2, ["Global", "Soft"]), ("Q", 3, ["Global"]),
    ]


def test_spec_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Units"):
        files.read_spec(spark, write(tmp_path / "a.csv", HEADER.replace("Units,", "") + "1,A,A,m,lin,P,1,1\n"), "base")
    bad = files.read_spec(spark, write(tmp_path / "b.csv", HEADER + "1,A,A,m,USD,lin,P,0,1\n"), "base")
    with pytest.raises(Exception, match="global block"):
        bad.collect()


def test_vintage_files_may_hold_different_series(spark, tmp_path):
    write(tmp_path / "2017-01-06.csv", "Date,A,B\n2016-11-01,1,\n2016-12-01,2,5\n")
    write(tmp_path / "2017-01-13.csv", "Date,B,C\n2016-12-01,6,7\n")
    rows = files.read_vintages(spark, str(tmp_path), "base").collect()
    got = {(str(r["vintage"]), r["series_id"], str(r["period"])): r["value"] for r in rows}
    assert got == {
        ("2017-01-06", "A", "2016-11-01"): 1, ("2017-01-06", "A", "2016-12-01"): 2,
        ("2017-01-06", "B", "2016-11-01"): None, ("2017-01-06", "B", "2016-12-01"): 5,
        ("2017-01-13", "B", "2016-12-01"): 6, ("2017-01-13", "C", "2016-12-01"): 7,
    }


def test_headers_are_read_by_file(spark, tmp_path):
    write(tmp_path / "2017-01-06.csv", '\ufeff"Date","A, total",B\r\n2016-11-01,1,nan\r\n\r\n2016-12-01,"2",5\r\n')
    write(tmp_path / "2017-01-13.csv", "B,Date\n6,2016-12-01")
    for day_ in range(10, 30):
        write(tmp_path / f"2018-01-{day_}.csv", f"Date,S{day_}\n2017-12-01,{day_}\n")
    table = files.read_vintages(spark, str(tmp_path), "base")
    got = {(str(r["vintage"]), r["series_id"], str(r["period"])): r["value"] for r in table.where("vintage < '2018-01-01'").collect()}
    assert got == {
        ("2017-01-06", "A, total", "2016-11-01"): 1, ("2017-01-06", "A, total", "2016-12-01"): 2, ("2017-01-06", "B", "2016-11-01"): None,
        ("2017-01-06", "B", "2016-12-01"): 5, ("2017-01-13", "B", "2016-12-01"): 6,
    }
    assert table.select("series_id").distinct().count() == 22
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Union" not in plan  # one scan whatever the headers
    write(tmp_path / "2019-01-04.csv", "Day,A\n2018-12-01,1\n")
    assert table.where("vintage = '2017-01-13'").count() == 1  # a file of another vintage is not opened
    with pytest.raises(Exception, match="no column Date"):
        files.read_vintages(spark, str(tmp_path), "base").collect()
    write(tmp_path / "2019-01-04.csv", "Date,A\n2018-12-01,1,2\n")
    with pytest.raises(Exception, match="more or fewer fields"):
        files.read_vintages(spark, str(tmp_path), "base").collect()
    with pytest.raises(ValueError, match="no vintage files"):
        files.read_vintages(spark, str(tmp_path / "2017-01-06.csv").replace(".csv", ".txt") if (tmp_path / "2017-01-06.txt").write_text("x") else "", "base")


def test_nan_becomes_null(spark):
    wide = spark.createDataFrame([(day("2017-01-01"), float("nan"), 1.0)], "Date date, a double, b double")
    got = {r["series_id"]: r["value"] for r in files.wide_to_long(wide, []).collect()}
    assert got == {"a": None, "b": 1.0}


def test_result_files_take_the_quarter_from_the_name(spark, tmp_path):
    head = "vintage,y_old,y_new,error,abs_error,perc_error,impact_revisions,impact_releases,variance,params_used\n"
    write(tmp_path / "nowcast_2017_q1.csv", head + "2016-12-09,2.4,2.3,-1.6,1.6,-2.2,0.003,-0.15,0.006,prev\n")
    write(tmp_path / "nowcast_2017_q2_b.csv", head + "2017-03-10,2.4,2.3,-1.6,1.6,-2.2,0.003,-0.15,0.006,prev\n")
    rows = files.read_result_files(spark, f"{tmp_path}/*.csv", "base").collect()
    assert sorted(r["quarter"] for r in rows) == ["2017_q1", "2017_q2"] and rows[0]["y_new"] == 2.3


def test_round_trips_replace_only_their_own_partitions(spark, tmp_path):
    path = str(tmp_path / "results")
    table = nowcast(spark, ROWS)
    files.write_results(table, path)
    files.write_results(table.where("quarter = '2020_q1'").withColumn("y_new", F.lit(9.0)), path)
    back = files.read_results(spark, path)
    assert back.count() == 6 and back.where("y_new = 9").count() == 1
    assert [r["quarter"] for r in files.catalogue(back).collect()] == ["2019_q4", "2020_q1", "2020_q3", "2021_q1"]


def test_news_and_params_round_trip(spark, tmp_path):
    rows = [("m", "2019_q1", day(v), "a", day("2018-12-01"), 0.0, 1.0, 1.0, 1.0) for v in ("2019-01-04", "2019-01-18")]
    files.write_news(spark.createDataFrame(rows, NEWS_DDL), str(tmp_path / "news"))
    got = {str(r["vintage"]): r["vintage_ordinal"] for r in files.read_news(spark, str(tmp_path / "news")).collect()}
    assert got == {"2019-01-04": 1, "2019-01-18": 2}
    files.write_params(spark.createDataFrame([("m", day("2019-01-04"), "A", 0, 1, 0.5)], PARAMS_DDL), str(tmp_path / "p"))
    assert files.read_params(spark, str(tmp_path / "p")).first()["v"] == 0.5


def test_numbers_that_are_none_are_errors(spark, tmp_path):
    for k, bad in enumerate(('"1,234.5"', "abc")):
        folder = tmp_path / f"v{k}"
        folder.mkdir()
        write(folder / "2017-01-06.csv", f"Date,A\n2016-11-01,1\n2016-12-01,{bad}\n")
        with pytest.raises(Exception, match="not a number"):
            files.read_vintages(spark, str(folder), "base").collect()


def test_columns_are_read_by_name(spark, tmp_path):
    head = "y_new,vintage,y_old,error,abs_error,perc_error,impact_revisions,impact_releases,variance_so_far,params_used\n"
    write(tmp_path / "nowcast_2017_q1.csv", head + "2.3,2016-12-09,2.4,-1.6,1.6,,0.003,-0.15,0.006,prev\n")
    row = files.read_result_files(spark, f"{tmp_path}/*.csv", "base").first()
    assert (row["y_new"], row["y_old"], row["perc_error"], row["step_variance"]) == (2.3, 2.4, None, 0.006)
    with pytest.raises(ValueError, match="rmse"):
        files.read_metric_files(spark, f"{tmp_path}/*.csv", "base")


def test_files_with_another_header_are_errors(spark, tmp_path):
    write(tmp_path / "metrics_2017_q1.csv", "quarter,rmse,mae,bias,mpe\n2017_q1,1,2,3,4\n")
    write(tmp_path / "metrics_2017_q2.csv", "quarter,mae,rmse,bias,mpe\n2017_q2,1,2,3,4\n")
    with pytest.raises(Exception):
        files.read_metric_files(spark, f"{tmp_path}/*.csv", "base").collect()


def test_stored_vintages_are_read_back(spark, tmp_path):
    rows = [(m, day(v), "a", day("2016-12-01"), x) for m, v, x in (("m", "2017-01-06", 1.0), ("m", "2017-01-13", None), ("n", "2017-01-06", 3.0))]
    table = spark.createDataFrame(rows, "model string, vintage date, series_id string, period date, value double")
    files.write_vintages(table, str(tmp_path / "v"))
    assert sorted(map(str, files.read_vintages(spark, str(tmp_path / "v"), fmt="parquet").collect())) == sorted(map(str, table.collect()))
    assert files.read_vintages(spark, str(tmp_path / "v"), "n", "parquet").first()["value"] == 3.0


def test_duplicate_cells_are_errors(spark):
    from tidemark.operators import panel

    table = spark.createDataFrame([("m", day("2017-01-06"), "a", day("2016-12-01"), x) for x in (1.0, 2.0)], "model string, vintage date, series_id string, period date, value double")
    with pytest.raises(Exception, match="more than one value"):
        panel.obs_wide(table, ["a"]).collect()
