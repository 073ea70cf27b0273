"""A static graph as two DataFrames.

nodes: id bigint, and any of h array<double>, label int, split string.
edges: src, dst bigint; edge_id bigint, weight float and efeat array<double> where known.
An edge table serves both directions of traversal: grouped by dst it gives
in-neighbours (CSC), grouped by src out-neighbours (CSR).
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ordering import position, running_sum

# The messages of invalid arrays.
BAD_COL_PTR = "colPtr size must be equal to numNodes + 1"
BAD_WEIGHTS = "weights size must match rowInd size"
BAD_ROW_IND = "rowInd is shorter than colPtr says"
BAD_EDGE_FEATURES = "edgeFeatures rows must match rowInd size"

#: Edge ids of a column that one row writes out.
SPAN = 4096
#: Edges of one node that the driver takes.
MOST_COLLECTED = 1_000_000


@runtime_checkable
class GraphBase(Protocol):
    """What every graph tells about itself."""

    def num_nodes(self) -> int: ...
    def num_edges(self) -> int: ...

    directed: bool
    has_edge_weights: bool
    has_edge_features: bool


@runtime_checkable
class InNeighbourGraph(GraphBase, Protocol):
    """A graph that can be traversed from a node to the sources of its incoming edges."""

    def in_degrees(self) -> DataFrame: ...
    def in_neighbours(self) -> DataFrame: ...
    def in_weights(self) -> DataFrame: ...
    def inv_sqrt_degrees(self, self_loops: bool = False) -> DataFrame: ...


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    #: The count given with CSC arrays; counted from the edges where none was given.
    declared_edges: int | None = None

    # --- construction

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """A directed graph; without `nodes`, its nodes are the ends of its edges."""
        edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
        if nodes is None:
            nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(nodes.withColumn("id", F.col("id").cast("long")), edges)

    @classmethod
    def undirected(cls, edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """Each pair is stored in both directions, a loop once; both rows share `undirected_id` where edges have an id."""
        g = cls.from_edges(edges, nodes)
        e = g.edges.withColumnRenamed("edge_id", "undirected_id")
        back = e.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}).select(*e.columns)
        return cls(g.nodes, e.unionByName(back), directed=False)

    @classmethod
    def from_csc(cls, spark: SparkSession, num_nodes: int, num_edges: int, col_ptr: list[int], row_ind: list[int], weights: list[float] = (), edge_features=None, directed: bool = True, strict: bool = False) -> Graph:
        """From arrays on the driver (small graphs and tests). An edge's id is its position in `row_ind`."""
        check_csc(num_nodes, num_edges, col_ptr, row_ind, weights, edge_features, strict)
        dst = [v for v in range(num_nodes) for _ in range(col_ptr[v], col_ptr[v + 1])]
        rows = [(i, row_ind[i], dst[i], float(weights[i]) if weights else None, [float(x) for x in edge_features[i]] if edge_features else None) for i in range(len(dst))]
        kinds = "edge_id long, src long, dst long, weight float, efeat array<double>"
        edges = spark.createDataFrame(rows, kinds)
        edges = edges.drop(*(["weight"] if not weights else []), *(["efeat"] if not edge_features else []))
        return cls(spark.range(num_nodes).select("id"), edges, directed, num_edges)

    @classmethod
    def from_csc_table(cls, table: DataFrame) -> Graph:
        """From one row of arrays (num_nodes, num_edges, col_ptr, row_ind, weights), for graphs that fit one; else `from_csc_tables`.

        Each array is written out once, and no row carries one on.
        """
        col_ptr = table.select(F.posexplode("col_ptr").alias("position", "value"))
        bad = F.when(F.element_at("col_ptr", -1) > F.size("row_ind"), BAD_ROW_IND).when((F.size("weights") > 0) & (F.size("weights") != F.size("row_ind")), BAD_WEIGHTS)
        both = F.arrays_zip(F.col("row_ind").alias("src"), F.coalesce("weights", F.expr("CAST(array() AS array<float>)")).alias("weight"))
        each = table.select(F.posexplode(F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(both)).alias("edge_id", "x"))
        entries = each.select(F.col("edge_id").cast("long").alias("edge_id"), F.col("x.src").alias("src"), F.col("x.weight").alias("weight"))
        edges = cls.from_csc_tables(col_ptr.select(F.col("position").cast("long").alias("position"), "value"), entries).edges
        nodes = table.select(F.explode(F.expr("CASE WHEN num_nodes > 0 THEN sequence(0L, num_nodes - 1) ELSE array() END")).alias("id"))
        return cls(nodes, edges)

    @classmethod
    def from_csc_tables(cls, col_ptr: DataFrame, entries: DataFrame) -> Graph:
        """From two tables of any size: offsets (position, value; N + 1 of them) and entries (edge_id, src[, weight, efeat]).

        A column's span of edge ids is written out in chunks of SPAN, so a node of
        any in-degree is spread over many rows, and joined with the entries.
        """
        after = col_ptr.select((F.col("position") - 1).alias("dst"), F.col("value").alias("e"))
        spans = col_ptr.select(F.col("position").alias("dst"), F.col("value").alias("b")).join(after, "dst")
        # sequence(5, 4) counts down, so empty columns are left out first.
        chunks = spans.where("e > b").select("dst", "b", "e", F.explode(F.expr(f"sequence(b div {SPAN}, (e - 1) div {SPAN})")).alias("c"))
        ids = chunks.select("dst", F.explode(F.expr(f"sequence(greatest(b, c * {SPAN}), least(e, (c + 1) * {SPAN}) - 1)")).alias("edge_id"))
        return cls(spans.select(F.col("dst").alias("id")), entries.join(ids, "edge_id").select("edge_id", "src", "dst", *(x for x in ("weight", "efeat") if x in entries.columns)))

    # --- metadata

    @property
    def has_edge_weights(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def has_edge_features(self) -> bool:
        """Whether edges have features, of at least one number."""
        return self.edge_feature_dim() > 0

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        """Of an undirected graph the pairs."""
        if self.declared_edges is not None:
            return self.declared_edges
        return self.edges.count() if self.directed else self.edges.where("src <= dst").count()

    def num_directed_entries(self) -> int:
        return self.edges.count()

    def edge_feature_dim(self) -> int:
        first = self.edges.select(F.size("efeat")).first() if "efeat" in self.edges.columns else None
        return max(0, first[0]) if first else 0

    # --- adjacency

    def _degrees(self, by: str) -> DataFrame:
        found = self.edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def in_degrees(self) -> DataFrame:
        """id and degree of every node; each of several equal edges counts."""
        return self._degrees("dst")

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degree(self, v: int) -> int:
        return self.edges.where(F.col("dst") == v).count()

    def _with_ids(self) -> DataFrame:
        """The edges with edge_id: their position by dst, then src, unless they have one."""
        return self.edges if "edge_id" in self.edges.columns else position(self.edges, ["dst", "src"], "edge_id")

    def with_edge_ids(self) -> Graph:
        return replace(self, edges=self._with_ids())

    def in_neighbours(self) -> DataFrame:
        """id, edge_id, neighbour: a row for each incoming edge."""
        return self._with_ids().select(F.col("dst").alias("id"), "edge_id", F.col("src").alias("neighbour"))

    def out_neighbours(self) -> DataFrame:
        return self._with_ids().select(F.col("src").alias("id"), "edge_id", F.col("dst").alias("neighbour"))

    def in_neighbours_of(self, v: int, most: int = MOST_COLLECTED) -> list[int]:
        """One node's sources, by edge id; its in-degree is checked first."""
        self._check_degree(v, most)
        return [x[0] for x in self._with_ids().where(F.col("dst") == v).orderBy("edge_id").select("src").collect()]

    def _check_degree(self, v: int, most: int) -> None:
        if self.in_degree(v) > most:
            raise ValueError(f"node {v} has too many incoming edges for the driver")

    def in_weights_of(self, v: int, most: int = MOST_COLLECTED) -> list[float]:
        """One node's incoming weights, by edge id; none where the graph has no weights."""
        if not self.has_edge_weights:
            return []
        self._check_degree(v, most)
        return [x[0] for x in self._with_ids().where(F.col("dst") == v).orderBy("edge_id").select("weight").collect()]

    def in_weights(self) -> DataFrame:
        """id, edge_id and weight of incoming edges; no rows where the graph has no weights."""
        e = self._with_ids()
        return e.select(F.col("dst").alias("id"), "edge_id", F.col("weight") if self.has_edge_weights else F.lit(None).cast("float").alias("weight")).where(F.lit(self.has_edge_weights))

    def weights(self) -> DataFrame:
        """edge_id and weight of all edges, 1.0 where there is none."""
        e = self._with_ids()
        return e.select("edge_id", (F.coalesce("weight", F.lit(1.0)) if self.has_edge_weights else F.lit(1.0)).cast("double").alias("weight"))

    def weights_data(self) -> DataFrame | None:
        """edge_id and weight of all edges; None where the graph has no weights."""
        return self._with_ids().select("edge_id", "weight") if self.has_edge_weights else None

    def edge_feature_data(self) -> DataFrame | None:
        """edge_id and efeat of all edges; None where the graph has no edge features."""
        return self._with_ids().select("edge_id", "efeat") if self.has_edge_features else None

    def source_of(self, edge_id: int) -> int:
        got = self._with_ids().where(F.col("edge_id") == edge_id).select("src").first()
        if got is None:
            raise IndexError(f"no edge {edge_id}")
        return got[0]

    def weight_of(self, edge_id: int) -> float:
        got = self.weights().where(F.col("edge_id") == edge_id).select("weight").first()
        if got is None:
            raise IndexError(f"no edge {edge_id}")
        return got[0]

    def inv_sqrt_degrees(self, self_loops: bool = False, by: str = "dst") -> DataFrame:
        """id and 1 / sqrt(in-degree, plus one with `self_loops`); 0 where that is 0.

        `by="src"` counts outgoing edges, as many where the graph is undirected and whole.
        """
        d = F.col("degree") + int(self_loops)
        return self._degrees(by).select("id", F.when(d > 0, 1 / F.sqrt(d.cast("double"))).otherwise(0.0).alias("inv_sqrt"))

    # --- export

    def col_ptr(self) -> DataFrame:
        """position and value of the N + 1 CSC offsets, by ascending node id."""
        starts = running_sum(self.in_degrees(), ["id"], F.col("degree"), "value")
        ranked = position(starts, ["id"], "position").select("position", "value")
        last = self.nodes.agg(F.count("*").alias("position")).crossJoin(self.edges.agg(F.count("*").alias("value")))  # one row each
        return ranked.unionByName(last)

    def to_csc_tables(self) -> tuple[DataFrame, DataFrame]:
        """The offsets (position, value) and the entries (edge_id, src, and weight and efeat where there are any), as tables."""
        numbered = self.with_edge_ids()
        return numbered.col_ptr(), numbered.edges.select("edge_id", "src", *(x for x in ("weight", "efeat") if x in self.edges.columns))

    @contextmanager
    def kept(self):
        """The graph with its edges and nodes in memory, spilling to disk, for as long as the block runs."""
        nodes, edges = self.nodes.persist(), self.edges.persist()
        try:
            yield replace(self, nodes=nodes, edges=edges)
        finally:
            edges.unpersist()
            nodes.unpersist()

    def to_csc(self, most_edges: int = 10_000_000) -> dict:
        """The CSC arrays on the driver, of a graph whose size is checked first."""
        n = self.num_directed_entries()
        if n > most_edges:
            raise ValueError(f"{n} edges are too many for the driver")
        e = self._with_ids().orderBy("edge_id").collect()
        return {
            "num_nodes": self.num_nodes(),
            "num_edges": self.num_edges(),
            "col_ptr": [x[0] for x in self.col_ptr().orderBy("position").select("value").collect()],
            "row_ind": [x["src"] for x in e],
            "weights": [x["weight"] for x in e] if self.has_edge_weights else None,
            "edge_features": [x["efeat"] for x in e] if "efeat" in self.edges.columns else None,
        }

    def dense_adjacency(self, most_nodes: int = 2000) -> DataFrame:
        """src, dst, n of all node pairs: for comparisons on graphs of a checked size."""
        if self.num_nodes() > most_nodes:
            raise ValueError("too many nodes for a dense adjacency")
        ids = self.nodes.select("id")
        pairs = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
        return pairs.join(self.edges.groupBy("src", "dst").agg(F.count("*").alias("n")), ["src", "dst"], "left").na.fill(0, ["n"])


def check_csc(num_nodes, num_edges, col_ptr, row_ind, weights=(), edge_features=None, strict: bool = False) -> None:
    """Raise ValueError for arrays that don't fit; `strict` also looks at their contents."""
    if len(col_ptr) != num_nodes + 1:
        raise ValueError(BAD_COL_PTR)
    if weights and len(weights) != len(row_ind):
        raise ValueError(BAD_WEIGHTS)
    if edge_features is not None and len(edge_features) != len(row_ind):
        raise ValueError(BAD_EDGE_FEATURES)
    if strict:
        if col_ptr[0] != 0 or any(a > b for a, b in zip(col_ptr, col_ptr[1:], strict=False)) or col_ptr[-1] != len(row_ind):
            raise ValueError("colPtr must ascend from 0 to the size of rowInd")
        if num_edges != len(row_ind) or any(not 0 <= x < num_nodes for x in row_ind):
            raise ValueError("rowInd must hold numEdges node ids")
