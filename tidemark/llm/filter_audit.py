"""What each filter takes away in every order of the filters.

Each document is a mask of the filters that it fails, so all orders follow from the counts of
the masks.  Orders are numbered lexicographically (by their Lehmer code).  A mask falls to its
filter f at step s in the orders that begin with s - 1 filters it passes and then f; those with
one such beginning are an interval of ranks.  The counts of a mask are added at the start of each
of its intervals and taken off at the end, and a running sum over the ranks gives every order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, stored, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of the UTF-8 form of a code point
_COPY = 1 << FILTERS.index("E")


def failed(text: bytes) -> int:
    """Mask of the filters A to D that a text fails; E depends on the other documents."""
    words = text.split()
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    c = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text.translate(None, _LATER_BYTES))
    d = len(text.translate(None, SYMBOLS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch):
            columns = [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([failed(t) for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), *columns], names=["id", "part", "digest", "mask"])


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of each run of orders in which a mask falls at a step."""
    found = []
    for mask in range(1, 1 << len(FILTERS)):
        fails = [k for k in range(len(FILTERS)) if mask >> k & 1]
        passes = [k for k in range(len(FILTERS)) if not mask >> k & 1]
        for before in range(len(passes) + 1):
            for head in permutations(passes, before):
                for last in fails:
                    left, rank = list(range(len(FILTERS))), 0
                    for k in (*head, last):
                        rank += left.index(k) * factorial(len(left) - 1)
                        left.remove(k)
                    found.append((mask, before + 1, rank, rank + factorial(len(left))))
    return found


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, labelled ones among them.

    A text is digested once; equal rows are counted together before anything is joined, so a large
    group of copies is a few rows.  The first key of each text is joined on (digest, key), which
    no group of copies makes hot.
    """
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(docs, text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    marks = plain.mapInArrow(_marked, f"id {kind}, part string, digest binary, mask int")
    copies = stored(marks.groupBy("digest", "id", "part").agg(F.count("*").alias("n"), F.first("mask").alias("mask")), "audit-copies")
    firsts = copies.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("leads", F.lit(True))
    known = labels.groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    rows = copies.join(firsts, ["digest", "id"], "left").join(known, "id", "left")
    mask = F.col("mask") + F.when(F.col("leads").isNull() & F.col("id").isNotNull(), _COPY).otherwise(0)
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return rows.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), count("q").alias("good"), count("t").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts for each (part, filter_order, step) of the 120 orders, as if each order filtered the documents.

    ``kept`` and ``removed`` (after and in the step), ``redundant`` (fail the filter, gone before),
    ``unique_fails`` (fail no other filter), ``good_lost`` and ``toxic_lost`` (removed with the
    label) and ``shapley`` (removed by the filter over all orders).  NULL parts are the part '',
    NULL texts empty.  A row without a key is a copy of none and none of it; rows that repeat a key
    are separate documents with the same label, and equal texts under one key aren't copies.  A label
    that is given twice holds if one row says so.  Texts are digested whole, whatever their length;
    an empty table has no parts and no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    counts = stored(mask_counts(docs, labels, key, text, part), "audit-counts")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))))
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    runs = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, intervals())) + " AS t(mask, step, start, stop)")
    lost = ["n", "good", "toxic"]
    ends = [F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in lost)) for at, sign in (("start", 1), ("stop", -1))]
    changes = counts.join(runs, "mask").select("part", "step", F.explode(F.array(*ends)).alias("c")).select("part", "step", "c.*")
    changes = changes.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in lost))

    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    order = F.split(F.lit(",".join(ORDERS)), ",")[F.col("rank")]
    summed = grid.join(changes, ["part", "step", "rank"], "left")
    summed = summed.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(along) for c in lost}).withColumn("filter_order", order)
    summed = summed.withColumn("at", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("n").over(steps)).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("fails")[F.col("at")] - F.col("n")).alias("redundant"),
        F.col("alone")[F.col("at")].alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "at")).alias("shapley"),
    )
