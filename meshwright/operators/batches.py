"""Aggregation in batches of destinations, each of a bounded number of message bytes.

The destinations are cut into ranges of ids by prefix sums of their in-degrees. A
range's result is written as it is finished; a run that was stopped goes on with the
ranges that are missing, and a lost one is made again alone. Where the edges lie in
files by destination (sources/clustered.py), a range reads only its own part of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ordering import running_sum
from meshwright.functions.storage import exists, written
from meshwright.graph import Graph
from meshwright.layers import Aggregation
from meshwright.operators.aggregate import aggregate

#: Bytes of a message beside its features.
MESSAGE = 16
#: Ranges that one run may have: they are dealt with one after the other.
MOST_RANGES = 10_000


def ranges(graph: Graph, dim: int, budget: int) -> DataFrame:
    """first, last (ids), nodes, messages and message_bytes of consecutive ranges of destinations.

    No range has more than `budget` message bytes, but for one node that has more alone.
    """
    each = 8 * dim + MESSAGE
    step = max(1, budget // 2)
    size = F.col("degree") * each
    before = running_sum(graph.in_degrees(), ["id"], size, "before")
    # All but the last node of a step end within it: the step and a light node fit the budget, a heavy one stands alone.
    key = [F.expr(f"before div {step}").alias("step"), (size > budget - step).alias("heavy")]
    found = before.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("nodes"), F.sum("degree").alias("messages"))
    return found.select("first", "last", "nodes", "messages", (F.col("messages") * each).alias("message_bytes"))


def aggregate_in_batches(graph: Graph, features: DataFrame, kind: Aggregation, dim: int, budget: int, folder: str, done: Callable[[int, int], None] | None = None, **options) -> DataFrame:
    """`aggregate` with at most `budget` message bytes at a time, read back from `folder`, where finished ranges lie.

    The folder must belong to this graph, these features and options. `done` is told
    each range (first, last) that was made in this run.
    """
    spark = graph.nodes.sparkSession
    cuts = ranges(graph, dim, budget).select("first", "last").orderBy("first").limit(MOST_RANGES + 1).collect()
    if len(cuts) > MOST_RANGES:
        raise ValueError(f"the budget makes more than {MOST_RANGES} ranges")
    if kind is Aggregation.GCN_NORM and options.get("degrees") is None:
        # Counted once, not for each range.
        options["degrees"] = written(graph.inv_sqrt_degrees(options.get("self_loops", False)), "degrees")
    paths = []
    for first, last in cuts:
        path = f"{folder.rstrip('/')}/range-{first}-{last}"
        paths.append(path)
        if not exists(spark, f"{path}/_SUCCESS"):
            near = replace(graph, nodes=graph.nodes.where(F.col("id").between(first, last)), edges=graph.edges.where(F.col("dst").between(first, last)), declared_edges=None)
            aggregate(near, features, kind, dim, **options).write.mode("overwrite").parquet(path)
            if done:
                done(first, last)
    return read(spark, paths)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    schema = "id long, m array<double>"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
