"""What a batch of seed nodes needs of a graph, layer by layer.

The last layer needs the seeds' incoming edges; the layer before it the incoming
edges of their sources as well; and so on. Each step is a semi-join of the edges
with the nodes needed so far, and the next node set; only ids are written in
between, and the edges that a layer uses. A node's full in-degree counts wherever it
is needed, so results are those of a run over the whole graph.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.storage import cut
from meshwright.graph import Graph

#: Node sets of at most so many ids are sent to all tasks, so that the edges are filtered where they are read.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class NodeSet:
    """Distinct ids (column id), written out, and how many there are."""

    ids: DataFrame
    size: int

    @classmethod
    def of(cls, ids: DataFrame) -> NodeSet:
        ids = cut(ids.select("id").distinct())
        return cls(ids, ids.count())

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of `df` whose `column` is among the ids."""
        side = self.ids.withColumnRenamed("id", column)
        return df.join(F.broadcast(side) if self.size <= MOST_SENT else side, column, "left_semi")


@dataclass(frozen=True)
class Block:
    """One layer's part: the nodes it gives, the nodes whose features it takes, the edges between them."""

    targets: NodeSet
    sources: NodeSet
    edges: DataFrame

    def of(self, graph: Graph) -> Graph:
        return replace(graph, nodes=self.targets.ids, edges=self.edges, declared_edges=None)


def blocks(graph: Graph, seeds: DataFrame, layers: int) -> list[Block]:
    """A block for each layer, the first layer's first, so that the last one gives the `seeds` (id) that the graph has."""
    wanted = NodeSet.of(seeds.select(F.col("id").cast("long").alias("id")).join(graph.nodes.select("id"), "id", "left_semi"))
    found: list[Block] = []
    for _ in range(layers):
        edges = cut(wanted.keep(graph.edges, "dst"))
        sources = NodeSet.of(wanted.ids.unionByName(edges.select(F.col("src").alias("id"))))
        found.insert(0, Block(wanted, sources, edges))
        wanted = sources
    return found


def hops(graph: Graph, seeds: DataFrame, layers: int) -> DataFrame:
    """hop and id: 0 for the seeds, then the nodes that are first needed so many layers before the last."""
    found = blocks(graph, seeds, layers)
    sets = [NodeSet.of(seeds.join(graph.nodes.select("id"), "id", "left_semi")).ids] if not found else [found[-1].targets.ids, *(b.sources.ids for b in reversed(found))]
    every = sets[0].select("id", F.lit(0).alias("hop"))
    for i, ids in enumerate(sets[1:], 1):
        every = every.unionByName(ids.select("id", F.lit(i).alias("hop")))
    return every.groupBy("id").agg(F.min("hop").alias("hop")).select("hop", "id")
