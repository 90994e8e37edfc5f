"""Token counts through a digest cache.

Each text is looked up by the SHA-256 of its normalised content under the digest of the
tokenizer file.  Texts that the cache does not know are encoded once per distinct content
and their counts are appended, so a second run over the same corpus encodes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.encoding import file_digest, library_encoder

CACHE_DDL = "digest binary, n_tokens bigint, version string"


def read_cache(spark, folder: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; an empty table at the first use of a folder."""
    spark.createDataFrame([], CACHE_DDL).coalesce(1).write.mode("append").partitionBy("version").parquet(folder)
    return spark.read.schema(CACHE_DDL).parquet(folder).filter(F.col("version") == version)


def _counter(path: str):
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array([len(i) // 4 for i in ids], pa.int64())], schema=schema
                )

    return count


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    version: str | None = None,
) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``.

    ``cache`` is a folder that all executors share; a digest that it holds twice counts once.
    ``normalise`` must not change the count of a text under this tokenizer; the default
    leaves texts as they are.  A NULL text is empty: no bytes, no tokens.  Rows keep their
    number: equal texts, equal or NULL keys and repeated rows each give their own row.  All
    other columns are ignored.  ``n_bytes`` is of the text before normalising.
    """
    version = version or file_digest(tokenizer)
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("text"))
    content = normalise(F.col("text"))
    keyed = plain.select(key, F.octet_length("text").cast("bigint").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    distinct = (
        plain.select(content.alias("text"))
        .groupBy(F.unhex(F.sha2("text", 256)).alias("digest"))
        .agg(F.first("text").alias("text"))
    )
    known = read_cache(spark, cache, version)
    misses = distinct.join(known, "digest", "left_anti").select("digest", "text")
    counted = misses.mapInArrow(_counter(tokenizer), "digest binary, n_tokens bigint")
    counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    # Two writers may have stored a digest twice: one count each, on the partitioning of the join.
    known = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(known, "digest", "left").select(key, "n_bytes", "n_tokens")
