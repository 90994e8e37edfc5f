"""SimHash fingerprints and near-duplicate groups found with pivot distance tables.

Fingerprints are 64 bits over 3-word shingles; two link when at most ``RADIUS`` bits differ.
For every distinct fingerprint its Hamming distances to ``PIVOTS`` fixed reference
fingerprints are tabled once.  By the triangle inequality a pair whose distances to any pivot
differ by more than the radius cannot link: such pairs are discarded before the verification.

The table is dealt so that no two linked rows can miss each other: a fingerprint has four
16-bit quarters, and of two that differ in at most two bits at least two quarters agree, which
gives six keys of 32 bits.  A key is refined by the cell of the distance to the first pivot;
rows near the edge of a cell go to both neighbours.  Equal fingerprints are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, stored, text_of
from tidemark.llm.components import connected_components

RADIUS = 2
SEED = 42
SHINGLE = 3
PIVOTS = 8
#: Width of a pivot cell; two rows whose distances differ by the radius share a cell at least.
CELL = 8

_REFERENCE = [int(x) - (1 << 64 if int(x) >> 63 else 0) for x in mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        hashes = np.array([digest(g, SEED) for g in grams[at : at + (1 << 16)]], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): signed 64-bit SimHash of every row; NULL texts are empty and have fingerprint 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([simhash(t.encode()) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64), pa.int64())], names=[key, "fp"])

    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("text"))
    return plain.mapInArrow(make, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


def distance_table(prints: DataFrame) -> DataFrame:
    """(fp, d0, d1, ...): Hamming distances of distinct fingerprints to the reference fingerprints."""
    return prints.select("fp", *(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).alias(f"d{k}") for k, p in enumerate(_REFERENCE)))


def _quarters(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, a < b, that differ in at most ``RADIUS`` bits."""
    table = distance_table(prints)
    q = _quarters(F.col("fp"))
    keys = [
        F.struct(F.lit(n).alias("part"), (F.shiftleft(q[i], 16) + q[j]).alias("block"), c.alias("cell"))
        for n, (i, j) in enumerate(combinations(range(4), 2))
        for c in (_cell(F.col("d0") - 1), _cell(F.col("d0") + 1))
    ]
    dealt = table.withColumn("k", F.explode(F.array_distinct(F.array(*keys)))).select("k.part", "k.block", "k.cell", *table.columns)
    left, right = dealt.alias("x"), dealt.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    close = F.greatest(*(F.abs(x(f"d{k}") - y(f"d{k}")) for k in range(PIVOTS))) <= RADIUS
    verified = F.bit_count(x("fp").bitwiseXOR(y("fp"))) <= RADIUS
    on = (x("part") == y("part")) & (x("block") == y("block")) & (x("cell") == y("cell")) & (x("fp") < y("fp"))
    return left.join(right, on & close & verified).select(x("fp").alias("a"), y("fp").alias("b"))


def _cell(distance: Column) -> Column:
    return F.floor((distance + CELL) / CELL).cast("int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): groups of documents that chains of links connect.

    ``component`` is the smallest key of the group.  Documents of equal fingerprint, those
    without words included, are always one group.  Repeated rows and keys keep their rows; a
    NULL key is never the smallest unless the group has no other.  Other columns are ignored.
    """
    prints = stored(fingerprints(docs, key, text), "simhashes")
    classes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = connected_components(links(classes.select("fp")))
    grouped = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
    grouped = grouped.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    member = grouped.join(smallest, "root").select("fp", "component")
    return prints.join(member, "fp").select(key, "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each group the one with the smallest key.

    A key names a document, so of rows that repeat a key one stays.  Rows without a key cannot
    be told from each other and all stay.
    """
    groups = near_duplicates(docs.filter(F.col(key).isNotNull()), key, text)
    first = groups.filter(F.col(key) == F.col("component")).select(key).distinct()
    kept = docs.join(first, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))
