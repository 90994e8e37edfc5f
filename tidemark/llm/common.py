"""Small helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import ensure_checkpoint_dir

#: The six characters that separate words, space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text that a task turns into arrays at a time; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column with NULL read as the empty text."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text; NULL texts become empty."""
    column = batch.column(batch.schema.get_field_index(text))
    start, size, found = 0, 0, []
    for k, value in enumerate(column):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        found.append(raw)
        size += len(raw)
        if size >= limit:
            yield batch.slice(start, k + 1 - start), found
            start, size, found = k + 1, 0, []
    if found:
        yield batch.slice(start), found


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
