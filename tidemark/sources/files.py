"""Sources and sinks: specs, vintages, results, news and parameters as Parquet or CSV."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.schema import FREQUENCIES, METRICS_DDL, NEWS_DDL, NOWCAST_DDL, PARAMS_DDL, PANEL

# The columns of a spec sheet and the form of its block columns.
SPEC_FIELDS = ["SeriesID", "SeriesName", "Frequency", "Units", "Transformation", "Category"]
BLOCK_PREFIX = r"Block[0-9]+-"
# Other names of a result column.
RESULT_NAMES = {"variance": "step_variance", "variance_so_far": "step_variance"}


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files that share a header, as text columns.

    A file whose header differs from the first one's, or a row with more or fewer fields, is an error.
    """
    names = spark.read.option("header", True).csv(paths).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(paths).toDF(*[n.strip() for n in names])


def _typed(column: str | Column, kind: str, blanks: tuple[str, ...], what: str) -> Column:
    text = F.trim(F.col(f"`{column}`") if isinstance(column, str) else column)
    value = text.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"{column}: not a {what}: " if isinstance(column, str) else f"not a {what}: "), text)).cast(kind)
    return F.when(text.isNull() | F.lower(text).isin(*blanks), F.lit(None).cast(kind)).when(value.isNull(), bad).otherwise(value)


def number(column: str | Column) -> Column:
    """A text column as numbers; empty and NaN are NULL, anything else that is no number is an error."""
    return _typed(column, "double", ("", "nan"), "number")


def day(column: str | Column) -> Column:
    """A text column as dates; anything that is no date is an error."""
    return _typed(column, "date", ("",), "date")


# ---------------------------------------------------------------- spec


def parse_spec(raw: DataFrame, model: str, position: str | None = None) -> DataFrame:
    """Turn a wide spec sheet into one row per series in use.

    ``position`` names the file-order column; without it the read order is
    used.  Fails when a required column is missing or when a series in use
    does not load on the first block.
    """
    sheet = raw.toDF(*[c.replace(" ", "") for c in raw.columns])
    for field in ["Model", *SPEC_FIELDS]:
        if field not in sheet.columns:
            raise ValueError(f"spec has no column {field}")
    blocks = [c for c in sheet.columns if "block" in c.lower()]
    if not blocks:
        raise ValueError("spec has no block column")
    flags = {c: F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)) for c in blocks}
    names = {c: re.sub(BLOCK_PREFIX, "", c) for c in blocks}
    order = F.col(position) if position else F.monotonically_increasing_id()
    used = sheet.withColumn("_file_pos", order).where(F.col("Model").cast("int") == 1)
    global_ok = F.when(flags[blocks[0]] == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not on the global block: "), F.col("SeriesID"))).cast("boolean")
    )
    loads = F.array(*[F.when(flags[c] == 1, F.lit(names[c])) for c in blocks])
    rows = used.where(global_ok).select(
        F.lit(model).alias("model"), F.col("SeriesID").alias("series_id"),
        F.col("SeriesName").alias("series_name"), F.col("Frequency").alias("frequency"),
        F.col("Units").alias("units"), F.col("Transformation").alias("transformation"),
        F.col("Category").alias("category"), F.array_compact(loads).alias("blocks"), "_file_pos",
    )
    return order_spec(rows)


def order_spec(rows: DataFrame) -> DataFrame:
    """Number the series by decreasing frequency, in file order inside a frequency.

    Series with an unknown frequency code are dropped.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in FREQUENCIES]), F.col("frequency"))
    known = rows.withColumn("_rank", rank).where(F.col("_rank") > 0)
    place = Window.partitionBy("model").orderBy("_rank", "_file_pos")
    return known.withColumn("spec_pos", F.row_number().over(place)).drop("_rank", "_file_pos")


def read_spec(spark: SparkSession, path: str, model: str, fmt: str = "csv") -> DataFrame:
    return parse_spec(_read(spark, path, fmt), model)


# ---------------------------------------------------------------- vintages


def wide_to_long(wide: DataFrame, keys: list[str], date: str = "Date") -> DataFrame:
    """One column per series to one row per cell; NaN becomes NULL."""
    series = [c for c in wide.columns if c not in [*keys, date]]
    plain = wide.select(
        *keys, F.col(date).cast("date").alias("period"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in series],
    )
    cells = plain.unpivot([*keys, "period"], series, "series_id", "value")
    return cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _vintage_day(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*(/[^/]*)?$", 1).cast("date")


#: Fixed value: a comma that no quotes surround.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """Fields of a line of a CSV file, without quotes around them."""
    return F.transform(F.split(line, _COMMA, -1), lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"))


def _csv_vintages(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all CSV vintages below a directory, each by the header of its own file.

    A file is one row, read by one task; its cells are named by position in its first line.  A
    filter on the vintage needs the file's path alone, so other files are not opened.
    """
    files = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path, wholetext=True)
    if not files.inputFiles():
        raise ValueError(f"no vintage files below {path}")
    name = F.col("_metadata.file_path")
    lines = F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")
    file = files.select(_vintage_day(name).alias("vintage"), name.alias("_file"), lines.alias("_lines"))
    # Cut the header once a file, not once a row.
    file = file.select("vintage", "_file", _fields(F.get("_lines", F.lit(0))).alias("_head"), F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line"))
    rows = file.where(F.trim("_line") != "").withColumn("_cells", _fields(F.col("_line")))
    place = F.array_position("_head", "Date")
    stop = lambda says: F.raise_error(F.concat(F.col("_file"), F.lit(says)))
    date = F.when(place == 0, stop(" has no column Date").cast("string")).when(
        F.size("_cells") != F.size("_head"), stop(": a row has more or fewer fields than the header").cast("string")
    ).otherwise(F.get("_cells", (place - 1).cast("int")))
    cells = rows.select("vintage", day(date).alias("period"), F.explode(F.arrays_zip(F.col("_head").alias("series_id"), F.col("_cells").alias("text"))).alias("c"))
    return cells.where("c.series_id <> 'Date'").select("vintage", "period", "c.series_id", number(F.col("c.text")).alias("value"))


def read_vintages(spark: SparkSession, path: str, model: str | None = None, fmt: str = "csv") -> DataFrame:
    """All vintages of a directory as one long table.

    CSV files, and Parquet files with one column per series, are dated by their name (``2017-01-06.csv``)
    or a ``vintage=`` directory and belong to ``model``; files may hold different series.  What
    ``write_vintages`` stored is read back as it is, of one model or of all.
    """
    if fmt == "csv":
        long = _csv_vintages(spark, path)
    else:
        stored = spark.read.format(fmt).option("mergeSchema", True).load(path)
        if {"series_id", "period", "value"} <= set(stored.columns):
            long = stored.select("model", "vintage", "series_id", "period", "value")
            return long.where(F.col("model") == model) if model else long
        wide = stored.withColumn("vintage", _vintage_day(F.input_file_name())).drop("model")
        long = wide_to_long(wide, ["vintage"])
    return long.select(F.lit(model).alias("model"), "vintage", "series_id", "period", "value")


def write_vintages(obs: DataFrame, path: str) -> None:
    """Long panel by (model, vintage) directory; only the vintages present are replaced."""
    _write(obs, path, PANEL)


# ---------------------------------------------------------------- results


def quarter_of_file() -> Column:
    """``yyyy_qN`` out of the name of the file a row came from, or of its directory."""
    return F.regexp_extract(F.input_file_name(), r"(\d{4}_q[1-4])[^/]*(/[^/]*)?$", 1)


def _named(raw: DataFrame, texts: list[str], dates: list[str], numbers: list[str]) -> DataFrame:
    """Columns by name, whatever their order in the file; each with the quarter in its file's name."""
    known = {RESULT_NAMES.get(c.lower(), c.lower()): c for c in raw.columns}
    missing = [c for c in [*texts, *dates, *numbers] if c not in known]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return raw.select(
        quarter_of_file().alias("quarter"),
        *[day(known[c]).alias(c) for c in dates],
        *[number(known[c]).alias(c) for c in numbers],
        *[F.col(f"`{known[c]}`").alias(c) for c in texts],
    )


def read_result_files(spark: SparkSession, pattern: str, model: str) -> DataFrame:
    """Loose per-quarter CSV files; the quarter is taken from the file name."""
    numbers = "y_old y_new error abs_error perc_error impact_revisions impact_releases step_variance".split()
    rows = _named(read_csv(spark, pattern), ["params_used"], ["vintage"], numbers)
    return rows.select(F.lit(model).alias("model"), "quarter", "vintage", *numbers, "params_used")


def read_metric_files(spark: SparkSession, pattern: str, model: str) -> DataFrame:
    numbers = "rmse mae bias mpe".split()
    return _named(read_csv(spark, pattern), [], [], numbers).select(F.lit(model).alias("model"), "quarter", *numbers)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOWCAST_DDL).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_DDL).parquet(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return with_vintage_ordinal(spark.read.schema(NEWS_DDL).parquet(path))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS_DDL).parquet(path)


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    # rebalancing on the directory columns keeps the files per directory few, and AQE
    # splits a directory that holds a large part of the rows
    out = df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    _write(df, path, ["model", "quarter"])


def write_metrics(df: DataFrame, path: str) -> None:
    _write(df, path, ["model"])


def write_news(df: DataFrame, path: str) -> None:
    # the vintage stays a column: a directory per weekly update would hold a handful of rows
    _write(df, path, ["model", "quarter"])


def write_params(df: DataFrame, path: str) -> None:
    _write(df, path, ["model", "est_vintage"])


# ---------------------------------------------------------------- catalogue


def catalogue(results: DataFrame) -> DataFrame:
    """Sorted distinct quarters with their years."""
    found = results.select("quarter").distinct()
    return found.select("quarter", cal.label_year("quarter").alias("year")).orderBy("quarter")


def quarters_of_year(results: DataFrame, year: int) -> DataFrame:
    return catalogue(results).where(F.col("year") == year)


def with_vintage_ordinal(news: DataFrame) -> DataFrame:
    """Position of a vintage among the vintages of its quarter.

    Ranks the short list of distinct vintages and joins it back instead of
    ordering the news rows themselves.
    """
    order = Window.partitionBy("model", "quarter").orderBy("vintage")
    weeks = news.select("model", "quarter", "vintage").distinct()
    ranked = weeks.withColumn("vintage_ordinal", F.row_number().over(order))
    return news.join(ranked, ["model", "quarter", "vintage"])
