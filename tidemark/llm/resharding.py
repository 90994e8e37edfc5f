"""Moving a sharded table to new shards with the fewest bytes moved.

The rows of the old shards lie in blocks, one per file.  A minimum-cost flow takes them to the
new shards: a row costs nothing where it stays and its block's mean size where it moves, and
every new shard takes ``rows / shards`` rows, at most one more than any other.  The flow is
solved for classes of blocks of a shard with about the same row size, so its size depends on
the shards and not on the data.  Files that lose rows are written again, all others stay.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.common import stored

OLD, SIZE, NEW, SLOT = "__old_shard", "__size", "__new_shard", "__slot"


def lay_out(docs: DataFrame, folder: str, shard, text: str = "text") -> None:
    """Write a table in shards: one directory for each value of the column ``shard``, no shuffle."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1
    docs.withColumns({SIZE: size, OLD: shard.cast("int")}).write.partitionBy(OLD).parquet(folder)


def _with(docs: DataFrame, *names: str) -> StructType:
    whole = {SIZE: LongType(), SLOT: LongType(), OLD: IntegerType(), NEW: IntegerType()}
    return StructType([*docs.schema.fields, *(StructField(n, whole[n]) for n in names)])


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The rows of a laid-out table with their file and place in it."""
    rows = spark.read.schema(_with(docs, SIZE, OLD)).parquet(folder)
    return rows.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def block_table(rows: DataFrame) -> DataFrame:
    """(__file, shard, rows, bytes, class): one row for each file; the class is the row size to a quarter power of two."""
    blocks = rows.groupBy("__file", F.col(OLD).alias("shard")).agg(F.count("*").alias("rows"), F.sum(SIZE).alias("bytes"))
    return blocks.withColumn("class", F.floor(F.log2(F.col("bytes") / F.col("rows")) * 4).cast("int"))


class Flow:
    """Minimum-cost flow by shortest augmenting paths."""

    def __init__(self, nodes: int):
        self.arcs: list[list[list]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def run(self, source: int, sink: int) -> int:
        moved = 0
        while True:
            best, via = [math.inf] * len(self.arcs), [None] * len(self.arcs)
            best[source] = 0
            queue, waiting = deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for arc in self.arcs[a]:
                    b, room, cost, _ = arc
                    if room and best[a] + cost < best[b]:
                        best[b], via[b] = best[a] + cost, arc
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if via[sink] is None:
                return moved
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = via[at][3][0]
            amount = min(arc[1] for arc in path)
            for arc in path:
                arc[1] -= amount
                arc[3][1] += amount
            moved += amount


def transfers(classes: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(shard, class, new shard, rows) from (shard, class, rows, bytes): the plan that moves the fewest bytes.

    Row counts of the new shards differ by at most one; which of them get the odd rows is part
    of the optimum.
    """
    total = sum(c[2] for c in classes)
    base, odd = divmod(total, shards)
    source, extra, sink = 0, 1, 2
    flow = Flow(3 + shards + len(classes))
    new = lambda j: 3 + j
    for j in range(shards):
        flow.add(new(j), sink, base, 0)
        flow.add(new(j), extra, 1, 0)
    flow.add(extra, sink, odd, 0)
    arcs = []
    for k, (shard, kind, rows, size) in enumerate(classes):
        node = 3 + shards + k
        flow.add(source, node, rows, 0)
        for j in range(shards):
            arcs.append((shard, kind, j, flow.add(node, new(j), rows, 0 if j == shard else -(-size // rows))))
    if flow.run(source, sink) != total:
        raise ValueError("the new shards can't take all rows")
    return [(shard, kind, j, arc[3][1]) for shard, kind, j, arc in arcs if arc[3][1]]


def placements(blocks: DataFrame, shards: int) -> DataFrame:
    """(__file, first, end, __new_shard, base): where runs of rows of each file go.

    A row at place r of a file, first <= r < end, gets slot ``base + r`` in its new shard.
    The classes (a few dozen for each old shard) go through the driver, the files do not.
    """
    spark = blocks.sparkSession
    found = blocks.groupBy("shard", "class").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("shard", "class").collect()
    plan = transfers([(r["shard"], r["class"], r["rows"], r["bytes"]) for r in found], shards)
    taken: dict[tuple[int, int], int] = {}
    filled = [0] * shards
    runs = []
    for shard, kind, new, rows in sorted(plan, key=lambda p: (p[0], p[1], p[2] != p[0], p[2])):
        start = taken.get((shard, kind), 0)
        runs.append((shard, kind, start, start + rows, new, filled[new] - start))
        taken[shard, kind] = start + rows
        filled[new] += rows
    moves = spark.createDataFrame(runs, f"shard int, class int, lo bigint, hi bigint, {NEW} int, shift bigint")
    line = Window.partitionBy("shard", "class").orderBy("__file").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("till", F.sum("rows").over(line)).withColumn("since", F.col("till") - F.col("rows"))
    both = placed.join(moves, ["shard", "class"]).filter("lo < till AND hi > since")
    return both.select(
        "__file",
        (F.greatest("lo", "since") - F.col("since")).alias("first"),
        (F.least("hi", "till") - F.col("since")).alias("end"),
        NEW,
        (F.col("shift") + F.col("since")).alias("base"),
        (F.col(NEW) != F.col("shard")).alias("moved"),
    )


def reshard(docs: DataFrame, old: str, new: str, shards: int) -> DataFrame:
    """Move the table laid out below ``old`` to ``shards`` shards; returns its rows with __new_shard and __slot.

    ``docs`` gives the columns.  Files that lose rows are written again below ``new``, in the
    shards their rows belong to; the other files are read where they are.  Columns keep whatever
    names they have (names that begin with two underscores are the library's).  Slots of a shard
    count from 0 without a gap.  Repeated rows, NULLs and an empty table need no special care:
    a row is known by its file and its place there.
    """
    spark = docs.sparkSession
    rows = read_shards(spark, old, docs)
    runs = stored(placements(stored(block_table(rows), "blocks"), shards), "placements")
    hit = runs.groupBy("__file").agg(F.max("moved").alias("hit"))
    runs = stored(runs.join(hit, "__file"), "placements")

    def put(where: str) -> DataFrame:
        # The documents may have columns of any name, so those of the runs get names of their own.
        run = runs.filter(where).select(F.col("__file").alias("__of"), NEW, *(F.col(c).alias(f"__run_{c}") for c in ("first", "end", "base")))
        at = (F.col("__row") >= F.col("__run_first")) & (F.col("__row") < F.col("__run_end"))
        there = rows.join(run, (F.col("__file") == F.col("__of")) & at)
        return there.select(*docs.columns, SIZE, NEW, (F.col("__run_base") + F.col("__row")).alias(SLOT))

    put("hit").write.partitionBy(NEW).parquet(new)
    return spark.read.schema(_with(docs, SIZE, NEW, SLOT)).parquet(new).select(*docs.columns, SIZE, NEW, SLOT).unionByName(put("NOT hit"))
