"""Dealing a graph's nodes to parts of equal work with few edges between them.

A node's work is its in-degree plus one. Nodes are first dealt in a zigzag by
descending work, so the parts start out even. Then, in each round, nodes look for
the part that most of their neighbours (sources and destinations) are in; those
whose turn it is (half of them, by a hash, so that neighbours don't just change
places) ask to move there. A part admits no more work than it has room for: the
wishes are summed up by part, gain and a hash of the node, a table of bounded size,
and taken from the greatest gain down while they fit. So no part ever exceeds its
capacity, whatever leaves it.

All choices are made by whole numbers, so a round's result depends on nothing but
the graph. Labels travel as pairs of numbers; a round is two aggregations that
Spark combines on the map side, so a node of any degree is a row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.ordering import position
from meshwright.functions.storage import cut, written
from meshwright.graph import Graph

#: Fixed values of the hash: a prime and three factors below it.
PRIME, BY_ID, BY_ROUND, SHIFT = 2147483647, 48271, 69621, 12345
#: Hash classes of the wishes of one part and gain.
CLASSES = 64
#: Labels of at most this many bytes are sent to all tasks.
BROADCAST_BYTES = 64 << 20


def mixed(node: str, round_: int) -> str:
    """SQL of a whole number below PRIME from a node and a round, in any dialect that has %."""
    x = f"((({node}) % {PRIME}) * {BY_ID} + {round_ * BY_ROUND + SHIFT}) % {PRIME}"
    return f"(({x}) * (({x}) % 65521 + 1) % {PRIME})"


def level(gain: str) -> str:
    """SQL of a gain's number of binary digits."""
    return f"length(bin({gain}))"


def loads(graph: Graph) -> DataFrame:
    """id and work of every node."""
    return graph.in_degrees().select("id", (F.col("degree") + 1).alias("work"))


def hashed(graph: Graph, parts: int) -> DataFrame:
    """id and part by a hash of the id alone: what partitioning is measured against."""
    return graph.nodes.select("id", F.expr(f"CAST({mixed('id', 0)} % {parts} AS int)").alias("part"))


def dealt(work: DataFrame, parts: int) -> DataFrame:
    """id, work and part: zigzag by descending work."""
    ranked = position(work.withColumns({"less": -F.col("work"), "mix": F.expr(mixed("id", 0))}), ["less", "mix", "id"], "rank")
    turn = F.col("rank") % (2 * parts)
    return ranked.select("id", "work", F.least(turn, 2 * parts - 1 - turn).cast("int").alias("part"))


def _neighbours(graph: Graph) -> DataFrame:
    """id, other and n: each edge from both of its ends, loops aside; of an undirected graph, whose edges come in both directions, each from one end for two."""
    e = graph.edges.where("src <> dst")
    n = F.lit(1 if graph.directed else 2).cast("long").alias("n")
    ends = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), n)
    return ends.unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), n)) if graph.directed else ends


def _sent(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size * 16 <= BROADCAST_BYTES else df


def step(labels: DataFrame, neighbours: DataFrame, parts: int, capacity: int, round_: int, nodes: int) -> DataFrame:
    """`labels` (id, work, part) after one round; `nodes` is their number."""
    there = labels.select(F.col("id").alias("other"), "part")
    votes = neighbours.join(_sent(there, nodes), "other").select("id", "part", "n")
    # A node's own part is among its votes, if with none.
    own = labels.select("id", "part", F.lit(0).cast("long").alias("n"))
    votes = votes.unionByName(own).groupBy("id", "part").agg(F.sum("n").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("part")).alias("less"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("all"))
    known = labels.join(best, "id").select("id", "work", "part", (-F.col("best.less")).alias("to"), (F.col("best.n") - F.col("all")[F.col("part")]).alias("gain"), F.expr(mixed("id", round_)).alias("mix"))
    # Classes by the hash's later digits, turns by its last one.
    asks = (F.col("gain") > 0) & (F.col("mix") % 2 == 0)
    known = cut(known.withColumns({"asks": asks, "level": F.expr(level("gain")), "class": ((F.col("mix") / 2).cast("long") % CLASSES).cast("int")}))
    room = labels.groupBy("part").agg((capacity - F.sum("work")).alias("room")).withColumnRenamed("part", "to")
    by = Window.partitionBy("to").orderBy(F.desc("level"), "class")
    wishes = known.where("asks").groupBy("to", "level", "class").agg(F.sum("work").alias("work"))
    admitted = wishes.withColumn("so_far", F.sum("work").over(by)).join(room, "to", "left").where(F.col("so_far") <= F.coalesce("room", F.lit(capacity)))
    moving = known.join(_sent(admitted.select("to", "level", "class", F.lit(True).alias("yes")), parts * 64 * CLASSES), ["to", "level", "class"], "left")
    return moving.select("id", "work", F.when(F.col("asks") & F.col("yes"), F.col("to")).otherwise(F.col("part")).cast("int").alias("part"))


def partition(graph: Graph, parts: int, rounds: int = 4, slack: int = 5) -> DataFrame:
    """id and part of every node, after `rounds` rounds; no part has more than `slack` per cent above an equal share of the work, unless single nodes do."""
    if parts < 1:
        raise ValueError("there must be at least one part")
    labels = cut(dealt(loads(graph), parts))
    total = labels.agg(F.sum("work"), F.count("*")).first()
    capacity = (total[0] or 0) * (100 + slack) // (100 * parts)
    neighbours = written(_neighbours(graph), "neighbours")
    for round_ in range(1, rounds + 1):
        labels = cut(step(labels, neighbours, parts, capacity, round_, total[1]))
    return labels.select("id", "part")


def quality(graph: Graph, placed: DataFrame) -> DataFrame:
    """part, nodes, work and cut of a placement (id, part): `cut` counts the edges into a part from others."""
    size = loads(graph).join(placed, "id").groupBy("part").agg(F.count("*").alias("nodes"), F.sum("work").alias("work"))
    a, b = placed.select(F.col("id").alias("src"), F.col("part").alias("from")), placed.select(F.col("id").alias("dst"), "part")
    crossing = graph.edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy("part").agg(F.sum((F.col("from") != F.col("part")).cast("long")).alias("cut"))
    return size.join(crossing, "part", "left").select("part", "nodes", "work", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"))

