"""Runs models over graphs, layer by layer, as one lazy DataFrame plan.

The only planning done here is what Catalyst cannot do: whether a layer's linear
map goes before or after the aggregation (A(HW) = (AH)W for linear aggregates:
the narrower side is shuffled), how edges are dealt, and when the lineage of a
deep model is cut. Joins, pushdown, pruning and partial aggregation are Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.arrays import activate, added, zeros
from meshwright.functions.storage import cut
from meshwright.graph import Graph
from meshwright.layers import KNOWN_LAYERS, Activation, Aggregation, EGATLayer, GNNModel, Layer
from meshwright.operators.aggregate import aggregate, hubs, most_in, reduce_by_key
from meshwright.operators.attention import attend
from meshwright.operators.frontier import blocks
from meshwright.operators.transform import linear
from meshwright.plans import cost


@dataclass(frozen=True)
class SparkEngine:
    """`strategy`: edge, vertex, feature, split (hubs' edges dealt to all tasks), colocated (for graphs in that layout), or auto (by the cost of each, where `statistics` of the graph are given; else edge, and Spark broadcasts what it knows to be small).

    `order`: auto, transform_first or aggregate_first. `checkpoint_every`: cut the
    lineage after so many layers by checkpoint() into the shared folder (0: never). `validate`: look at the features' size before running.
    `compress`: features meet edges as 8-bit numbers, within half a 127th of each
    node's greatest (attention layers excepted), or with "columns" of each column's
    greatest, and are summed as whole numbers.
    """

    model: GNNModel = GNNModel()
    strategy: str = "auto"
    order: str = "auto"
    use_edge_weights: bool = False
    checkpoint_every: int = 0
    validate: bool = False
    compress: bool | str = False
    statistics: cost.Statistics | None = None

    supported_layers = KNOWN_LAYERS

    def run(self, graph: Graph, features: DataFrame, edge_features: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
        """id and h of every node after all layers, or of the `seeds` (id) only.

        `features` (id, h) must have a row for every node; `edge_features`
        (edge_id, efeat) go before those that the graph holds. With seeds, each
        layer takes just the nodes and edges that they need of it.
        """
        graph, state = self.prepared(graph, features, edge_features)
        if seeds is not None:
            return self._run_seeds(graph, state, seeds)
        norms: dict[bool | str, DataFrame] = {}
        for i, layer in enumerate(self.model.layers):
            state = self.step(graph, state, layer, norms)
            if self.checkpoint_every and (i + 1) % self.checkpoint_every == 0 and i + 1 < len(self.model):
                state = cut(state)
        return state

    def with_model(self, model: GNNModel) -> SparkEngine:
        return replace(self, model=model)

    def prepared(self, graph: Graph, features: DataFrame, edge_features: DataFrame | None = None) -> tuple[Graph, DataFrame]:
        """The graph with the edge features, and the state (id, h) before the first layer, both checked against the model."""
        if edge_features is not None:
            graph = replace(graph, edges=graph.with_edge_ids().edges.drop("efeat").join(edge_features.select("edge_id", "efeat"), "edge_id"))
        if self.model.needs_edge_features and not graph.has_edge_features:
            raise ValueError("the model requires edge features")
        state = features.select(F.col("id").cast("long").alias("id"), F.col("h").cast("array<double>").alias("h"))
        if self.validate and not self.model.empty:
            bad = state.agg(F.min(F.size("h")), F.max(F.size("h")), F.count("*")).first()
            if tuple(bad) != (self.model.input_dim, self.model.input_dim, graph.num_nodes()):
                raise ValueError("node features must have a row for every node and the model's input dimension")
        return graph, state

    def _run_seeds(self, graph: Graph, state: DataFrame, seeds: DataFrame) -> DataFrame:
        parts = blocks(graph, seeds, len(self.model))
        if not parts:
            return state.join(seeds.select("id").distinct(), "id", "left_semi")
        needed = parts[0].sources
        # All later nodes are among the first layer's, and their degrees are those of the whole graph.
        near = replace(graph, nodes=needed.ids, edges=needed.keep(graph.edges, "dst"))
        norms = {x.self_loops: cut(near.inv_sqrt_degrees(x.self_loops)) for x in self.model.layers if getattr(x, "aggregation", None) is Aggregation.GCN_NORM}
        state = needed.keep(state, "id")
        for i, (layer, block) in enumerate(zip(self.model.layers, parts, strict=True)):
            state = self.step(block.of(graph), state, layer, norms)
            if self.checkpoint_every and (i + 1) % self.checkpoint_every == 0 and i + 1 < len(parts):
                state = cut(state)
        return state

    def transforms_first(self, layer: Layer) -> bool:
        """Whether the narrower side is the layer's output; equal sides aggregate first."""
        if not layer.aggregation.linear or self.order == "aggregate_first":
            return False
        return self.order == "transform_first" or layer.out_dim < layer.in_dim

    def strategy_of(self, layer: Layer, graph: Graph) -> str:
        """The layer's strategy: the one that was named, or the cheapest for the width of what is shuffled."""
        if self.strategy != "auto":
            return self.strategy
        if self.statistics is None:
            return "edge"
        spark = graph.edges.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        machines = -(-spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.executor.cores", "8")))
        return cost.choose(self.statistics, layer.out_dim if self.transforms_first(layer) else layer.in_dim, tasks, machines)

    def step(self, graph: Graph, state: DataFrame, layer: Layer, norms: dict[bool | str, DataFrame]) -> DataFrame:
        if isinstance(layer, EGATLayer):
            return attend(graph, state, layer)
        kind = layer.aggregation
        loops = kind is Aggregation.GCN_NORM and layer.self_loops
        if kind is Aggregation.GCN_NORM and loops not in norms:
            # An undirected graph's edges are counted where they lie.
            norms[loops] = graph.inv_sqrt_degrees(loops, "src" if self.strategy == "colocated" and not graph.directed else "dst")
        strategy = self.strategy_of(layer, graph)
        options = {"self_loops": loops, "use_edge_weights": self.use_edge_weights, "strategy": strategy, "degrees": norms.get(loops), "compress": self.compress}
        if self.compress == "columns":
            if "most_in" not in norms:
                norms["most_in"] = self.statistics.most_in if self.statistics else most_in(graph.edges)
            options["most_messages"] = norms["most_in"] + int(loops)
        if strategy == "split":
            if "hubs" not in norms:
                norms["hubs"] = cut(hubs(graph.edges))
            options["heavy"] = norms["hubs"]
        own = getattr(layer, "w_self", None)
        if getattr(layer, "w_edge", None) is not None:
            # Edge features are reduced like messages: W (h, e) = W_neigh h + W_edge e, whatever is added up.
            m = aggregate(graph, state, kind, layer.in_dim, **options)
            e = reduce_by_key(graph.edges.select(F.col("dst").alias("id"), F.col("efeat").cast("array<double>").alias("h")), "id", layer.w_edge.rows, kind)
            m = m.join(e.withColumnRenamed("m", "e"), "id", "left").withColumn("e", F.coalesce("e", zeros(layer.w_edge.rows)))
            parts = [("m", layer.w_neigh), ("e", layer.w_edge)]
            if own is not None:
                m, parts = m.join(state, "id"), [*parts, ("h", own)]
            return linear(m, parts, layer.bias, layer.activation)
        if not self.transforms_first(layer):
            m = aggregate(graph, state, kind, layer.in_dim, **options)
            parts = [("m", layer.w_neigh)]
            if own is not None:
                m, parts = m.join(state, "id"), [*parts, ("h", own)]
            return linear(m, parts, layer.bias, layer.activation)
        m = aggregate(graph, linear(state, [("h", layer.w_neigh)]), kind, layer.out_dim, **options)
        z = F.col("m")
        if own is not None:
            m = m.join(linear(state, [("h", own)]).withColumnRenamed("h", "s"), "id")
            z = added(z, F.col("s"), layer.out_dim)
        if layer.bias:
            z = added(z, F.array(*map(F.lit, layer.bias)), layer.out_dim)
        return m.select("id", (z if layer.activation is Activation.NONE else F.transform(z, lambda x: activate(x, layer.activation))).alias("h"))
