"""Connected components of an edge table, by rounds of joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node that each node of ``edges`` can reach; nodes without an edge are not in the result."""
    stars = pointers(edges, a, b)
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def pointers(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As ``connected_components``, without the smallest nodes themselves.

    Until every node points to the centre of a star, each round hands a node's smallest neighbour
    to its larger neighbours, then to its smaller ones and itself (large-star and small-star),
    which takes a number of rounds that grows with the logarithm of the longest path.  Each round
    is one job and a table in the shared folder, so lost executors cost one round.  A node with
    very many neighbours is only ever aggregated, never listed.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stored(pairs.distinct(), "links")
    while not _all_stars(links):
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # Every b is smaller than its a: each node points to smaller ones.
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        links = stored(small.select("e.*").filter("a <> b").distinct(), "stars")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the smallest b of each a as m; a row travels once, or twice if it is filtered later."""
    dealt = pairs.repartition("a")
    return dealt.join(dealt.groupBy("a").agg(F.min("b").alias("m")).hint("merge"), "a")


def _all_stars(links: DataFrame) -> bool:
    """Whether each a of the distinct ``links`` (a, b), a > b, has one b alone, and no b points on."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre")))).alias("e"))
    odd = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).filter("up > 1 OR up = 1 AND centre = 1")
    return odd.agg(F.count("*")).first()[0] == 0
