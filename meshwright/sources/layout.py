"""A graph laid out so that its edges needn't move again.

Edges are written in buckets by their source, nodes in as many by id; a bucket is a
file. Spark then joins features with edges where the edges lie, and sums up by
destination on the map side; only those sums travel, and as they are dealt by the
same hash into as many partitions, the next layer finds them in place.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from meshwright.functions.storage import scratch
from meshwright.graph import Graph


def _bucketed(df: DataFrame, column: str, buckets: int, name: str, folder: str) -> DataFrame:
    # Dealt by the buckets' own hash first, so each bucket is one file.
    dealt = df.repartition(buckets, column)
    dealt.write.bucketBy(buckets, column).sortBy(column).option("path", folder).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def colocated(graph: Graph, buckets: int | None = None, folder: str | None = None, prefix: str | None = None) -> Graph:
    """`graph` read from tables in buckets: {prefix}_edges and {prefix}_nodes, in `folder`.

    There are as many buckets as spark.sql.shuffle.partitions, unless told; the two
    should agree when a model runs, or Spark deals again what doesn't fit. A
    bucket's features are held in memory while its edges are read. Without a
    folder, the tables' files go to the shared folder and are deleted when the
    application ends; the tables' names stay in the session's catalog until `drop`.
    """
    spark = graph.nodes.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, prefix = folder or scratch(spark, "layout"), prefix or f"colocated_{uuid.uuid4().hex}"
    nodes = _bucketed(graph.nodes, "id", buckets, f"{prefix}_nodes", f"{folder}/nodes")
    edges = _bucketed(graph.edges, "src", buckets, f"{prefix}_edges", f"{folder}/edges")
    return replace(graph, nodes=nodes, edges=edges)


def opened(spark: SparkSession, prefix: str, directed: bool = True) -> Graph:
    """The graph of tables that `colocated` has written."""
    return Graph(spark.table(f"{prefix}_nodes"), spark.table(f"{prefix}_edges"), directed)


def drop(spark: SparkSession, prefix: str) -> None:
    """Forget the tables; their files stay."""
    for what in ("nodes", "edges"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{what}")
