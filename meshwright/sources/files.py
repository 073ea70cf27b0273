"""Graphs, features and weights from files, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.functions.ordering import position
from meshwright.functions.storage import cut
from meshwright.graph import Graph
from meshwright.layers import EGATLayer, GCNLayer, GNNModel, GraphSAGELayer, Activation, Aggregation
from meshwright.matrix import DenseMatrix

#: File splits whose first line numbers are sent to all tasks.
MOST_SPLITS = 100_000


def edge_list(spark: SparkSession, path: str, sep: str = "\t", weighted: bool = False, comment: str = "#") -> DataFrame:
    """src, dst (and weight) of a text edge list, as public graph collections publish them."""
    schema = "src bigint, dst bigint" + ", weight float" * weighted
    return spark.read.csv(path, schema=schema, sep=sep, comment=comment, mode="FAILFAST")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csc(spark: SparkSession, path: str) -> Graph:
    """A graph from a Parquet row of CSC arrays (num_nodes, num_edges, col_ptr, row_ind, weights)."""
    return Graph.from_csc_table(spark.read.parquet(path))


def write_csc_tables(graph: Graph, folder: str) -> None:
    """A graph of any size as two Parquet tables: `folder`/col_ptr and `folder`/entries."""
    col_ptr, entries = graph.to_csc_tables()
    col_ptr.write.parquet(f"{folder}/col_ptr")
    entries.write.parquet(f"{folder}/entries")


def read_csc_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph.from_csc_tables(spark.read.parquet(f"{folder}/col_ptr"), spark.read.parquet(f"{folder}/entries"))


def read_edge_features(spark: SparkSession, path: str, id_column: str = "edge_id", feature_column: str = "efeat") -> DataFrame:
    """edge_id and efeat of a Parquet table with a list column."""
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("edge_id"), F.col(feature_column).cast("array<double>").alias("efeat"))


def numbered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of CSV files without a header, with `row`, their number from 0 over all files in the order of the names.

    Spark reads each split of a file in order and numbers the rows of a partition by
    position, whatever splits it holds; so a line's number is that of its split's
    first line, plus how far it is behind it. Only counts of the splits are shuffled.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    lines = spark.read.csv(path, schema=schema, mode="FAILFAST").select("*", *split, F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_from").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = cut(splits.select("_file", "_from", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_start")))
    side = F.broadcast(starts) if starts.count() <= MOST_SPLITS else starts
    return lines.join(side, ["_file", "_from"]).withColumn("row", F.col("_start") + F.col("_at")).drop("_file", "_from", "_at", "_start")


def ogb_folder(spark: SparkSession, folder: str, dim: int) -> tuple[Graph, DataFrame]:
    """A graph and its nodes (id, h, label) from the raw CSV files that the Open Graph Benchmark publishes.

    edge.csv.gz holds src,dst; node-feat.csv.gz `dim` features a line and
    node-label.csv.gz one label, both by node number. Each may be a file or a
    folder of files, whose lines are numbered in the order of their names.
    """
    edges = spark.read.csv(f"{folder}/edge.csv.gz", schema="src bigint, dst bigint", mode="FAILFAST")
    feats = numbered_csv(spark, f"{folder}/node-feat.csv.gz", ", ".join(f"x{k} double" for k in range(dim)))
    labels = numbered_csv(spark, f"{folder}/node-label.csv.gz", "label int")
    nodes = feats.select(F.col("row").alias("id"), F.array(*(f"x{k}" for k in range(dim))).alias("h")).join(labels.select(F.col("row").alias("id"), "label"), "id", "left")
    return Graph.from_edges(edges, nodes), nodes


def citation_files(spark: SparkSession, content: str, cites: str) -> tuple[Graph, DataFrame]:
    """A graph and its nodes (id, name, h, label) from citation files as Planetoid's sources have them.

    A line of `content` is a name, features and a class, between tabs; a line of
    `cites` the cited name and the citing one. Nodes are numbered by name and
    classes by theirs; a citation of an unknown name is left out.
    """
    parts = spark.read.text(content).select(F.split("value", "\t").alias("p")).where("size(p) > 2")
    rows = parts.select(F.col("p")[0].alias("name"), F.expr("transform(slice(p, 2, size(p) - 2), x -> CAST(x AS double))").alias("h"), F.element_at("p", -1).alias("class"))
    classes = position(rows.select("class").distinct(), ["class"], "label")
    nodes = position(rows, ["name"], "id").join(classes, "class").select("id", "name", "h", F.col("label").cast("int").alias("label"))
    links = spark.read.csv(cites, schema="cited string, citing string", sep="\t", mode="FAILFAST")
    src, dst = nodes.select(F.col("name").alias("citing"), F.col("id").alias("src")), nodes.select(F.col("name").alias("cited"), F.col("id").alias("dst"))
    return Graph.from_edges(links.join(src, "citing").join(dst, "cited").select("src", "dst"), nodes), nodes


def csr_to_edges(table: DataFrame) -> DataFrame:
    """edge_id, src, dst, weight from one row of CSR arrays (row_ptr, col_ind, weights)."""
    spans = table.select("col_ind", "weights", F.expr("posexplode(transform(slice(row_ptr, 1, size(row_ptr) - 1), (b, i) -> named_struct('b', b, 'e', row_ptr[i + 1])))").alias("src", "span"))
    each = spans.select("*", F.explode(F.expr("CASE WHEN span.e > span.b THEN sequence(span.b, span.e - 1) ELSE array() END")).alias("edge_id"))
    return each.select("edge_id", F.col("src").cast("long"), F.expr("col_ind[CAST(edge_id AS int)]").alias("dst"), F.expr("CASE WHEN size(weights) > 0 THEN weights[CAST(edge_id AS int)] END").alias("weight"))


def read_features(spark: SparkSession, path: str, id_column: str, feature_column: str, **renamed: str) -> DataFrame:
    """id and h (and more columns by their new names) of a Parquet table with a list column."""
    df = spark.read.parquet(path)
    more = [F.col(old).alias(new) for new, old in renamed.items()]
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(feature_column).cast("array<double>").alias("h"), *more)


def write_embeddings(features: DataFrame, path: str) -> None:
    features.write.parquet(path)


def weights_table(spark: SparkSession, model: GNNModel) -> DataFrame:
    """layer, kind, name, k and wr: a row for each row of each matrix, and the layers' settings as names without k."""
    rows = []
    for i, layer in enumerate(model.layers):
        kind = type(layer).__name__
        for name in ("w_neigh", "w_self", "w_node", "w_edge", "w_attn"):
            w: DenseMatrix | None = getattr(layer, name, None)
            rows += [(i, kind, name, k, w.row(k)) for k in range(w.rows)] if w is not None else []
        rows.append((i, kind, "activation:" + layer.activation.value, None, None))
        if isinstance(layer, EGATLayer):
            rows.append((i, kind, f"heads:{layer.heads}", None, None))
        else:
            rows += [(i, kind, "aggregation:" + layer.aggregation.value, None, None), (i, kind, f"self_loops:{int(layer.self_loops)}", None, None)]
            if layer.bias:
                rows.append((i, kind, "bias", None, list(layer.bias)))
    return spark.createDataFrame(rows, "layer int, kind string, name string, k int, wr array<double>")


def write_weights(spark: SparkSession, model: GNNModel, path: str) -> None:
    weights_table(spark, model).write.parquet(path)


def read_weights(spark: SparkSession, path: str, most_rows: int = 1_000_000) -> GNNModel:
    """The model that `write_weights` wrote; its size is checked before it comes to the driver."""
    df = spark.read.parquet(path)
    if df.count() > most_rows:
        raise ValueError("too many rows of weights")
    by: dict[int, list] = {}
    for x in df.orderBy("layer", "name", "k").collect():
        by.setdefault(x["layer"], []).append(x)
    layers = []
    for i in sorted(by):
        parts: dict[str, list] = {}
        setting = {}
        for x in by[i]:
            if x["k"] is not None:
                parts.setdefault(x["name"], []).append(list(x["wr"]))
            elif x["name"] == "bias":
                setting["bias"] = tuple(x["wr"])
            else:
                name, _, value = x["name"].partition(":")
                setting[name] = value
        w = {k: DenseMatrix.from_rows(v) for k, v in parts.items()}
        act, kind = Activation(setting["activation"]), by[i][0]["kind"]
        if kind == "EGATLayer":
            layers.append(EGATLayer(**w, heads=int(setting["heads"]), activation=act))
        elif kind == "GCNLayer":
            layers.append(GCNLayer(w["w_neigh"], setting.get("bias", ()), act, bool(int(setting["self_loops"]))))
        else:
            layers.append(GraphSAGELayer(w["w_neigh"], w.get("w_self"), setting.get("bias", ()), Aggregation(setting["aggregation"]), act, bool(int(setting["self_loops"])), w.get("w_edge")))
    return GNNModel(tuple(layers))
