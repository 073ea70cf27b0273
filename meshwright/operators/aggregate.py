"""Neighbourhood aggregation: an equi-join on the source, a grouped aggregate on the destination.

Features travel as one array a node. The aggregate is unrolled into one built-in
aggregate for each feature, up to BLOCK of them, so that Spark combines them on
the map side within generated code; wider arrays go in blocks. A node of any
in-degree is reduced by partial sums before the shuffle, never collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from meshwright.functions.arrays import added, dequantise, quantise, scaled, zeros
from meshwright.functions.storage import cut
from meshwright.graph import Graph
from meshwright.layers import Aggregation
from meshwright.operators import packed

BLOCK = 64
#: Features of at most this many bytes may be broadcast (their size is checked first).
BROADCAST_BYTES = 64 << 20
#: A source of more than one edge in so many is a hub.
HUBS = 1024
#: Features of a row that is summed as packed whole numbers.
PACKED = 128
STRATEGIES = ("edge", "vertex", "feature", "split", "colocated")


def gather(graph: Graph, features: DataFrame, broadcast: bool = False) -> DataFrame:
    """The edges, each with its source's features as h."""
    side = features.select(F.col("id").alias("src"), "h")
    return graph.edges.join(F.broadcast(side) if broadcast else side, "src")


def with_self_loops(graph: Graph) -> DataFrame:
    """src, dst (and weight) of the edges and of one more edge from each node to itself."""
    keep = ["src", "dst", *(["weight"] if graph.has_edge_weights else [])]
    loops = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), *([F.lit(1.0).cast(dict(graph.edges.dtypes)["weight"]).alias("weight")] if graph.has_edge_weights else []))
    return graph.edges.select(*keep).unionByName(loops)


def hubs(edges: DataFrame, most: int = HUBS) -> DataFrame:
    """src: the sources of more than one edge in `most`, of which there are fewer than that."""
    counts = cut(edges.groupBy("src").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * most > total).select("src", F.lit(True).alias("hub"))


def _split(edges: DataFrame, side: DataFrame, heavy: DataFrame) -> DataFrame:
    """`edges` with `side` (src, ...), joined by the source: of `heavy` sources (src, hub) each partition gets a copy and its share of the edges."""
    heavy, copies = F.broadcast(heavy), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.join(heavy, "src", "left").withColumn("copy", F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(copies)).cast("int")).otherwise(0)).drop("hub")
    last = F.when(F.col("hub"), F.lit(copies - 1)).otherwise(0)
    each = side.join(heavy, "src", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), last))).drop("hub")
    return dealt.join(each, ["src", "copy"]).drop("copy")


def _reduce(kind: Aggregation, x: Column) -> Column:
    if kind is Aggregation.MAX:
        return F.max(x)
    if kind is Aggregation.MEAN:
        return F.avg(x)
    return F.sum(x)


def _feature(k: int) -> Column:
    return F.col("h")[k]


def _reduced(grouped: GroupedData, kind: Aggregation, xs: list[Column]) -> tuple[DataFrame, Column]:
    """The columns of `xs` reduced in each group, and the array of the results.

    Means are sums and counts: what is shuffled has the counts side by side, which are
    equal but for nulls and so compress to next to nothing; between an average's sums they don't.
    """
    if kind is not Aggregation.MEAN:
        return grouped.agg(*(_reduce(kind, x).alias(f"s{k}") for k, x in enumerate(xs))), F.array(*(f"s{k}" for k in range(len(xs))))
    sums = grouped.agg(*(F.sum(x).alias(f"s{k}") for k, x in enumerate(xs)), *(F.count(x).alias(f"c{k}") for k, x in enumerate(xs)))
    return sums, F.array(*(F.col(f"s{k}") / F.nullif(F.col(f"c{k}"), F.lit(0)) for k in range(len(xs))))


def reduce_by_key(messages: DataFrame, key: str, dim: int, kind: Aggregation, feature: Callable[[int], Column] = _feature) -> DataFrame:
    """`key` and m: the messages' h arrays of each key reduced feature by feature; up to BLOCK features may be other expressions."""
    if dim <= BLOCK:
        if not dim:
            return messages.select(key).distinct().select(key, zeros(0).alias("m"))
        sums, m = _reduced(messages.groupBy(key), kind, [feature(k) for k in range(dim)])
        return sums.select(key, m.alias("m"))
    blocks = -(-dim // BLOCK)
    parts = messages.select(key, F.posexplode(F.array(*(F.slice("h", b * BLOCK + 1, BLOCK) for b in range(blocks)))).alias("b", "h"))
    sums, m = _reduced(parts.groupBy(key, "b"), kind, [F.get("h", F.lit(k)) for k in range(BLOCK)])
    whole = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", m.alias("m")))).alias("m"))
    return whole.select(key, F.slice(F.flatten(F.col("m.m")), 1, dim).alias("m"))


def reduce_by_feature(messages: DataFrame, key: str, kind: Aggregation) -> DataFrame:
    """The same in the long layout: a row for each feature, reduced by key and position, for features of any width."""
    each = messages.select(key, F.posexplode("h").alias("k", "x")).groupBy(key, "k").agg(_reduce(kind, F.col("x")).alias("x"))
    # A node's features come together again: as many as its width, whatever its degree.
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m")).select(key, F.col("m.x").alias("m"))


def aggregate(
    graph: Graph,
    features: DataFrame,
    kind: Aggregation,
    dim: int,
    self_loops: bool = False,
    use_edge_weights: bool = False,
    strategy: str = "edge",
    degrees: DataFrame | None = None,
    compress: bool | str = False,
    most_messages: int | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """id and m of every node: its in-neighbours' h reduced, the zero vector where it has none.

    `self_loops` adds one message of each node to itself, beside any loop there
    is; GCN_NORM then counts it in the degree. `use_edge_weights` multiplies
    messages by the edge's weight (1 where there is none); means still divide by
    the number of messages. `degrees` (id, inv_sqrt) can be passed in to be used
    for several layers. Strategies: "edge" joins by the source and combines
    partial results of edge partitions; "vertex" first deals edges by destination
    and broadcasts the features if their size allows, so that each node is
    reduced in its own partition without a further shuffle; "feature" reduces in
    the long layout, by destination and feature; "split" deals copies of
    the features of `heavy` sources (by default the `hubs`) and their edges to all
    partitions, so no task gets all edges of a hub; "colocated" is for graphs in that layout: features
    are joined where the edges lie. `compress` sends features to the edges as 8-bit
    numbers with a scale for each node; compress="columns" has a scale for each column, so
    that sums are of whole numbers, several to a long, no node having more than
    `most_messages` (counted unless given). Weighted messages, maxima, rows of more than
    PACKED features and strategies other than "edge" take the scale for each node.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    # Where a node's own message is just added to the sum, the edges stay in their layout.
    own = self_loops and strategy == "colocated" and kind in (Aggregation.SUM, Aggregation.GCN_NORM)
    edges = with_self_loops(graph) if self_loops and not own else graph.edges
    side = features.select("id", "h")
    if kind is Aggregation.GCN_NORM:
        # The source's factor goes into its features, the destination's into the sum.
        norm = degrees if degrees is not None else graph.inv_sqrt_degrees(self_loops)
        side = side.join(norm, "id").select("id", scaled(F.col("h"), F.col("inv_sqrt"), dim).alias("h"))
    factored, small = side, False
    if strategy == "vertex":
        edges = edges.repartition("dst")
        # A row for every node, so the features needn't be computed to be counted.
        small = graph.num_nodes() * dim * 8 <= BROADCAST_BYTES
    if compress == "columns" and strategy == "edge" and kind is not Aggregation.MAX and not (use_edge_weights and graph.has_edge_weights) and dim <= PACKED:
        if most_messages is None:
            most_messages = most_in(edges)
        found = packed.reduce_packed(edges, side, kind, dim, most_messages)
        return _finished(graph, found, norm if kind is Aggregation.GCN_NORM else None, factored if own else None, dim)
    side = side.withColumnRenamed("id", "src")
    if compress:
        side = side.select("src", quantise(F.col("h")).alias("q"))
    if strategy == "split":
        messages = _split(edges, side, heavy if heavy is not None else hubs(edges))
    else:
        messages = edges.join(F.broadcast(side) if small else side.hint("shuffle_hash") if strategy == "colocated" else side, "src")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if use_edge_weights and graph.has_edge_weights else None
    if strategy != "feature" and dim <= BLOCK:
        # Scales and weights go into the sums' terms, in generated code.
        of = (lambda k: F.col("q.q")[k].cast("double") * F.col("q.scale")) if compress else _feature
        found = reduce_by_key(messages, "dst", dim, kind, of if weight is None else lambda k: of(k) * weight)
    else:
        h = dequantise(F.col("q")) if compress else F.col("h")
        messages = messages.select("dst", (h if weight is None else F.transform(h, lambda x: x * weight)).alias("h"))
        found = reduce_by_feature(messages, "dst", kind) if strategy == "feature" else reduce_by_key(messages, "dst", dim, kind)
    return _finished(graph, found, norm if kind is Aggregation.GCN_NORM else None, factored if own else None, dim)


def most_in(edges: DataFrame) -> int:
    """The greatest number of edges that one node gets."""
    return edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _finished(graph: Graph, found: DataFrame, norm: DataFrame | None, own: DataFrame | None, dim: int) -> DataFrame:
    """id and m of every node from the reduced messages (dst, m), with the nodes' `own` features added and the destination's factor."""
    out = graph.nodes.select("id").join(found.withColumnRenamed("dst", "id"), "id", "left")
    if own is not None:
        mine = own.select("id", F.col("h").alias("mine"))
        out = out.join(mine, "id").select("id", F.when(F.col("m").isNull(), F.col("mine")).otherwise(added(F.col("m"), F.col("mine"), dim)).alias("m"))
    if norm is not None:
        out = out.join(norm, "id").withColumn("m", scaled(F.col("m"), F.col("inv_sqrt"), dim))
    return out.select("id", F.coalesce("m", zeros(dim)).alias("m"))
