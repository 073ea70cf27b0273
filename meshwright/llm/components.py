"""Connected components of a graph given by links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.shared import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node reachable) of every node of `links` (a long, b long).

    Large-star and small-star steps in turn: each node hooks its greater
    neighbours, then all of its smaller ones, to the least it knows. The links
    of a round are written to the shared folder; rounds grow with the logarithm
    of the longest chain. A node's least neighbours are written too, so that Spark
    can split the links of a node with very many of them. Loops are ignored; an
    empty table gives an empty one.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = cut(ordered)
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # The greater neighbours of a node without smaller ones stay where they are.
        least = cut(now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")))
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = cut(joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("links did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Enough to tell whether a round changed anything."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
