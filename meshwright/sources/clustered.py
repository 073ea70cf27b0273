"""A graph in files by destination: one node's edges are read without looking at the others.

Edges are numbered by destination and source and written in that order, so a file's
row groups and pages hold narrow ranges of both `dst` and `edge_id`, which Parquet
keeps with them. A filter on either skips all else, and so do joins with few nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.graph import MOST_COLLECTED, Graph

#: Bytes of a row group, and rows of a page: what a point read looks at.
GROUP_BYTES = 16 << 20
PAGE_ROWS = 4096


def write(graph: Graph, folder: str) -> None:
    """The edges with their ids, and the nodes, below `folder`."""
    edges = graph.with_edge_ids().edges
    ordered = edges.repartitionByRange("dst", "edge_id").sortWithinPartitions("dst", "edge_id")
    ordered.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/edges")
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/nodes")


@dataclass(frozen=True)
class Clustered:
    """What was written, with point reads beside the whole graph."""

    graph: Graph

    @classmethod
    def open(cls, spark: SparkSession, folder: str, directed: bool = True) -> Clustered:
        return cls(Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), directed))

    def in_edges(self, first: int, last: int | None = None) -> DataFrame:
        """The edges into one node, or into all of an id range."""
        return self.graph.edges.where(F.col("dst").between(first, first if last is None else last))

    def edge(self, edge_id: int) -> DataFrame:
        return self.graph.edges.where(F.col("edge_id") == edge_id)

    def _collected(self, v: int, column: str) -> list:
        rows = self.in_edges(v).select("edge_id", column).limit(MOST_COLLECTED + 1).collect()
        if len(rows) > MOST_COLLECTED:
            raise ValueError(f"node {v} has too many incoming edges for the driver")
        return [x[1] for x in sorted(rows, key=lambda r: r[0])]

    def in_neighbours_of(self, v: int) -> list[int]:
        return self._collected(v, "src")

    def in_weights_of(self, v: int) -> list[float]:
        return self._collected(v, "weight") if self.graph.has_edge_weights else []

    def in_degree(self, v: int) -> int:
        return self.in_edges(v).count()

    def _one(self, edge_id: int, column: str):
        got = self.edge(edge_id).select(column).first()
        if got is None:
            raise IndexError(f"no edge {edge_id}")
        return got[0]

    def source_of(self, edge_id: int) -> int:
        return self._one(edge_id, "src")

    def weight_of(self, edge_id: int) -> float:
        if not self.graph.has_edge_weights:
            self._one(edge_id, "src")
            return 1.0
        weight = self._one(edge_id, "weight")
        return 1.0 if weight is None else weight
