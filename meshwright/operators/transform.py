"""Linear maps, bias, activations, and what turns features into predictions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.arrays import activate, argmax, softmax
from meshwright.functions.storage import written
from meshwright.layers import Activation
from meshwright.matrix import DenseMatrix

#: Weights of at most this many numbers are sent to all tasks; the layers' shapes are known beforehand.
MOST_WEIGHTS = 8 << 20
#: Weights of at most this many rows and columns are written into the sums' terms.
MOST_ROWS, MOST_COLUMNS = 128, 64
#: Blocks of either end of scored pairs, at least, and nodes of one at most: what a task holds in memory.
BLOCKS, BLOCK_NODES = 16, 65536


def weight_rows(df: DataFrame, parts: list[tuple[str, DenseMatrix]]) -> DataFrame:
    """part, k and wr: the rows of some matrices of equal width."""
    if sum(w.rows * w.cols for _, w in parts) > MOST_WEIGHTS:
        raise ValueError("the weights are too large to be sent to all tasks")
    rows = [(p, k, w.row(k)) for p, w in parts for k in range(w.rows)]
    return df.sparkSession.createDataFrame(rows, "part string, k int, wr array<double>")


def linear(df: DataFrame, parts: list[tuple[str, DenseMatrix]], bias: tuple[float, ...] = (), activation: Activation = Activation.NONE) -> DataFrame:
    """id and h: activation(sum over parts of column times matrix, plus bias).

    Small weights are written into the terms of one sum a column. Beyond MOST_ROWS or
    MOST_COLUMNS, features are exploded and joined with the broadcast rows of the
    weights. Either way sums are by id, without what is null. Grouping by id after a
    grouping by id needs no shuffle, and partial sums leave one row a node in any case.
    """
    out = parts[0][1].cols
    if sum(w.rows for _, w in parts) <= MOST_ROWS and out <= MOST_COLUMNS and all(w.rows for _, w in parts):
        sums = _sums_of_terms(df, parts)
    else:
        items = [F.transform(F.col(c), _tagged(c)) for c, _ in parts]
        each = df.select("id", F.explode(F.concat(*items)).alias("f")).select("id", "f.part", "f.k", "f.x")
        joined = each.join(F.broadcast(weight_rows(df, parts)), ["part", "k"])
        sums = joined.groupBy("id").agg(*(F.sum(F.col("x") * F.col("wr")[j]).alias(f"z{j}") for j in range(out)))
    z = [F.col(f"z{j}") + F.lit(bias[j]) if bias else F.col(f"z{j}") for j in range(out)]
    return sums.select("id", F.array(*(activate(x, activation) for x in z)).alias("h"))


def _sums_of_terms(df: DataFrame, parts: list[tuple[str, DenseMatrix]]) -> DataFrame:
    """id and z0, z1, ...: a row a node goes into the sums, not one a feature."""
    xs = [F.get(c, F.lit(k)).cast("double") for c, w in parts for k in range(w.rows)]
    rows = [w.row(k) for _, w in parts for k in range(w.rows)]
    terms = [F.coalesce(x, F.lit(0.0)) for x in xs]
    sums = [sum((x * F.lit(float(row[j])) for x, row in zip(terms, rows, strict=True)), F.lit(0.0)) for j in range(parts[0][1].cols)]
    # As an explode has it: no row of a node without any feature, and null where all its features are.
    there = df.where(F.size(F.concat(*(F.col(c) for c, _ in parts))) > 0)
    found = there.groupBy("id").agg(*(F.sum(x).alias(f"z{j}") for j, x in enumerate(sums)), F.max(F.coalesce(*xs).isNotNull()).alias("some"))
    return found.select("id", *(F.when(F.col("some"), F.col(f"z{j}")).alias(f"z{j}") for j in range(len(sums))))


def _tagged(part: str):
    return lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("k"), x.alias("x"))


def add_bias(df: DataFrame, bias: tuple[float, ...]) -> DataFrame:
    return df.withColumn("h", F.zip_with("h", F.array(*map(F.lit, bias)), lambda a, b: a + b)) if bias else df


def apply_activation(df: DataFrame, kind: Activation) -> DataFrame:
    return df.withColumn("h", F.transform("h", lambda x: activate(x, kind)))


def concat(features: DataFrame, messages: DataFrame) -> DataFrame:
    """id and h: each node's own features, then its aggregated ones."""
    return features.join(messages, "id").select("id", F.concat("h", "m").alias("h"))


def linear_head(features: DataFrame, weights: DenseMatrix, bias: tuple[float, ...] = ()) -> DataFrame:
    return linear(features, [("h", weights)], bias)


def mlp(features: DataFrame, layers: list[tuple[DenseMatrix, tuple[float, ...], Activation]]) -> DataFrame:
    """Linear maps with bias and activation in a row."""
    for w, b, a in layers:
        features = linear(features, [("h", w)], b, a)
    return features


def probabilities(features: DataFrame) -> DataFrame:
    return features.withColumn("h", softmax(F.col("h")))


def predictions(features: DataFrame) -> DataFrame:
    """id and pred: the class of the greatest feature, the lowest of equals."""
    return features.select("id", argmax(F.col("h")).alias("pred"))


def accuracy(predicted: DataFrame, truth: DataFrame, split: str | None = None) -> DataFrame:
    """One row: n and accuracy over the labelled nodes (of one split)."""
    rows = truth.where("label IS NOT NULL")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    both = rows.join(predicted, "id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def link_scores(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """src, dst and score: the product of both ends' features.

    Pairs are written and counted first. Where there are many, ends are dealt to blocks and
    pairs to tiles, a block of sources by one of destinations; each tile gets copies
    of its two blocks' features, so none is shuffled or sorted once a pair.
    """
    pairs = written(pairs.select("src", "dst"), "pairs")
    a = features.select(F.col("id").alias("src"), F.col("h").alias("x"))
    b = features.select(F.col("id").alias("dst"), F.col("h").alias("y"))
    nodes = features.count()
    blocks = max(BLOCKS, -(-nodes // BLOCK_NODES))
    if pairs.count() <= 2 * blocks * nodes:
        return _scores(pairs, a, b)
    with _dealt_by_tile(pairs.sparkSession):
        return written(_scores(*_in_tiles(pairs, a, b, blocks), "tile"), "scores")


def _scores(pairs: DataFrame, a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(a, [*more, "src"]).join(b, [*more, "dst"]).select("src", "dst", dot.alias("score"))


def _in_tiles(pairs: DataFrame, a: DataFrame, b: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs, and a copy of each end's features for every tile in its block's row or column, dealt by tile."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = pairs.withColumn("tile", block("src") * blocks + block("dst"))
    a = a.withColumn("other", each).withColumn("tile", block("src") * blocks + F.col("other")).drop("other")
    b = b.withColumn("other", each).withColumn("tile", F.col("other") * blocks + block("dst")).drop("other")
    return pairs.repartition(tasks, "tile"), *(x.repartition(tasks, "tile").hint("shuffle_hash") for x in (a, b))


@contextmanager
def _dealt_by_tile(spark: SparkSession) -> Iterator[None]:
    """Joins by tile and id take both sides as they were dealt, by tile alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
