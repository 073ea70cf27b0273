"""Graphs, aggregation and layers on the worked four-node example and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from meshwright.functions.arrays import argmax, dequantise, quantise, softmax
from meshwright.graph import Graph, InNeighbourGraph
from meshwright.layers import Activation, Aggregation, EGATLayer, GCNLayer, GNNModel, GraphSAGELayer
from meshwright.operators import transform
from meshwright.operators.aggregate import aggregate
from meshwright.plans.engine import SparkEngine
from meshwright.plans.verify import profile, sweep, verify

COL_PTR, ROW_IND, WEIGHTS = [0, 0, 2, 3, 5], [0, 2, 0, 1, 2], [0.5, 0.3, 1.2, 0.8, 0.9]
X = [[1.0, 2.0], [3.0, -4.0], [-5.0, 6.0], [7.0, 8.0]]


@pytest.fixture(scope="module")
def golden(spark):
    return Graph.from_csc(spark, 4, 5, COL_PTR, ROW_IND, WEIGHTS)


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame(list(enumerate(X)), "id long, h array<double>")


def arrays(df, column="m"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_metadata_and_adjacency(spark, golden):
    assert isinstance(golden, InNeighbourGraph)
    assert (golden.num_nodes(), golden.num_edges(), golden.num_directed_entries(), golden.directed) == (4, 5, 5, True)
    assert golden.has_edge_weights and not golden.has_edge_features and golden.edge_feature_dim() == 0
    assert arrays(golden.in_degrees(), "degree") == [0, 2, 1, 2]
    assert arrays(golden.out_degrees(), "degree") == [2, 1, 2, 0]
    assert [golden.in_neighbours_of(v) for v in range(4)] == [[], [0, 2], [0], [1, 2]]
    assert golden.in_weights_of(3) == pytest.approx([0.8, 0.9])
    assert golden.in_degree(3) == 2 and golden.source_of(3) == 1 and golden.weight_of(2) == pytest.approx(1.2)
    with pytest.raises(IndexError):
        golden.source_of(9)
    got = golden.to_csc()
    assert (got["col_ptr"], got["row_ind"]) == (COL_PTR, ROW_IND) and got["weights"] == pytest.approx(WEIGHTS)
    bare = Graph.from_csc(spark, 4, 5, COL_PTR, ROW_IND)
    assert bare.in_weights_of(1) == [] and bare.weight_of(0) == 1.0 and bare.in_weights().count() == 0
    assert golden.dense_adjacency().where("n > 0").count() == 5


def test_inverse_square_roots(golden):
    r = 1 / math.sqrt(2)
    assert arrays(golden.inv_sqrt_degrees(), "inv_sqrt") == pytest.approx([0, r, 1, r])
    assert arrays(golden.inv_sqrt_degrees(True), "inv_sqrt") == pytest.approx([1, 1 / math.sqrt(3), r, 1 / math.sqrt(3)])


def test_invalid_arrays(spark):
    for message, args in (
        ("colPtr size must be equal to numNodes + 1", (4, 5, [0, 1], ROW_IND)),
        ("weights size must match rowInd size", (4, 5, COL_PTR, ROW_IND, [1.0] * 3)),
        ("edgeFeatures rows must match rowInd size", (4, 5, COL_PTR, ROW_IND, [], [[1.0]] * 3)),
    ):
        with pytest.raises(ValueError, match=message.replace("+", r"\+")):
            Graph.from_csc(spark, *args)
    with pytest.raises(ValueError):
        Graph.from_csc(spark, 4, 5, [0, 3, 2, 3, 5], ROW_IND, strict=True)


def test_csc_table(spark, golden):
    table = spark.createDataFrame([(4, 5, COL_PTR, ROW_IND, WEIGHTS)], "num_nodes long, num_edges long, col_ptr array<long>, row_ind array<long>, weights array<float>")
    g = Graph.from_csc_table(table)
    assert sorted(map(tuple, g.edges.select("edge_id", "src", "dst").collect())) == sorted(map(tuple, golden.edges.select("edge_id", "src", "dst").collect()))
    assert g.num_nodes() == 4


R3 = 1 / math.sqrt(3)
EXPECTED = [
    (Aggregation.SUM, False, False, [[0, 0], [-4, 8], [1, 2], [-2, 2]]),
    (Aggregation.MEAN, False, False, [[0, 0], [-2, 4], [1, 2], [-1, 1]]),
    (Aggregation.MAX, False, False, [[0, 0], [1, 6], [1, 2], [3, 6]]),
    (Aggregation.SUM, False, True, [[0, 0], [-1.0, 2.8], [1.2, 2.4], [-2.1, 2.2]]),
    (Aggregation.GCN_NORM, False, False, [[0, 0], [-3.535534, 4.242641], [0, 0], [-2.035534, 2.242641]]),
    (Aggregation.GCN_NORM, True, False, [[1, 2], [-0.463891, 2.270857], [-1.792893, 4.414214], [1.292092, 3.782823]]),
]


@pytest.mark.parametrize("strategy", ["edge", "vertex"])
@pytest.mark.parametrize("kind,loops,weighted,expected", EXPECTED)
def test_aggregates(golden, x, strategy, kind, loops, weighted, expected):
    got = arrays(aggregate(golden, x, kind, 2, loops, weighted, strategy))
    assert [v for r in got for v in r] == pytest.approx([v for r in expected for v in r], abs=1e-6)


def test_wide_features_go_in_blocks(spark, golden):
    wide = spark.createDataFrame([(i, [float(i * 100 + k) for k in range(130)]) for i in range(4)], "id long, h array<double>")
    got = arrays(aggregate(golden, wide, Aggregation.SUM, 130))
    assert got[3] == [300.0 + 2 * k for k in range(130)] and got[0] == [0.0] * 130


def test_negative_max_and_equal_edges_and_loops(spark):
    nodes = spark.createDataFrame([(0, [-1.0]), (1, [-2.0]), (2, [float("nan")])], "id long, h array<double>")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0)], "src long, dst long")
    g = Graph.from_edges(edges, nodes)
    assert arrays(aggregate(g, nodes, Aggregation.MAX, 1))[1] == [-1.0]
    assert math.isnan(arrays(aggregate(g, nodes, Aggregation.MAX, 1))[0][0])
    assert arrays(g.in_degrees(), "degree") == [1, 3, 0]
    assert arrays(aggregate(g, nodes, Aggregation.SUM, 1, self_loops=True))[1] == [-6.0]  # a loop of its own beside the one there is


def test_undirected(spark):
    g = Graph.undirected(spark.createDataFrame([(0, 0, 1), (1, 2, 2)], "edge_id long, src long, dst long"))
    assert (g.directed, g.num_edges(), g.num_directed_entries()) == (False, 2, 3)
    assert sorted(tuple(r) for r in g.edges.select("undirected_id", "src", "dst").collect()) == [(0, 0, 1), (0, 1, 0), (1, 2, 2)]


def test_empty_graphs(spark):
    nodes = spark.createDataFrame([(0, [1.0])], "id long, h array<double>")
    none = spark.createDataFrame([], "src long, dst long")
    assert arrays(aggregate(Graph.from_edges(none, nodes), nodes, Aggregation.MEAN, 1)) == [[0.0]]
    assert Graph.from_edges(none).num_nodes() == 0
    assert SparkEngine(GNNModel((GCNLayer([[1.0]]),))).run(Graph.from_edges(none), nodes.limit(0)).count() == 0


@pytest.mark.parametrize("kind", list(Aggregation))
def test_orders_and_strategies_agree(golden, x, kind):
    layer = GraphSAGELayer([[0.5], [-0.25]], [[1.0], [0.125]], (0.5,), kind, Activation.RELU)
    runs = [SparkEngine(GNNModel((layer,)), strategy, order).run(golden, x) for strategy, order in (("edge", "aggregate_first"), ("edge", "transform_first"), ("vertex", "auto"))]
    for other in runs[1:]:
        assert verify(runs[0], other).same


def test_engine_checks(spark, golden, x):
    model = GNNModel((EGATLayer([[1.0], [1.0]], [[1.0]], [[1.0]] * 3),))
    with pytest.raises(ValueError, match="edge features"):
        SparkEngine(model).run(golden, x)
    with pytest.raises(ValueError, match="node features"):
        SparkEngine(GNNModel((GCNLayer([[1.0]]),)), validate=True).run(golden, x)
    assert verify(SparkEngine().run(golden, x), x).same
    feats = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "edge_id long, efeat array<double>")
    out = arrays(SparkEngine(model).run(golden, x, feats), "h")
    assert out[0] == [0.0] and out[2] == pytest.approx([3.0])
    # node 1: scores of its two edges, by hand
    g = [3.0, -1.0, 1.0, 15.0]
    s = [g[1] + g[0] + 0.0, g[1] + g[2] + 1.0]
    s = [v if v >= 0 else 0.2 * v for v in s]
    e = [math.exp(v) for v in s]
    assert out[1] == pytest.approx([(e[0] * g[0] + e[1] * g[2]) / sum(e)])


def test_predictions(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0]), (1, [1000.0, 0.0, -1000.0]), (2, [])], "id long, h array<double>")
    p = arrays(df.withColumn("h", softmax(df["h"])), "h")
    assert sum(p[0]) == pytest.approx(1) and p[1] == pytest.approx([1, 0, 0]) and p[2] == []
    assert arrays(df.withColumn("c", argmax(df["h"])), "c") == [1, 0, None]
    back = df.withColumn("h", dequantise(quantise(df["h"])))
    assert arrays(back, "h")[0] == pytest.approx([1, 3, 3], abs=0.02)
    truth = spark.createDataFrame([(0, 1, "a"), (1, 2, "a"), (2, None, "a"), (0, 5, "b")], "id long, label int, split string")
    assert tuple(transform.accuracy(transform.predictions(df), truth, "a").first()) == (2, 0.5)


def test_verify_profile_sweep(spark, x, tmp_path):
    assert not verify(x, x.where("id > 0")).same
    off = transform.add_bias(x, (0.1, 0.0))
    got = verify(x, off)
    assert (got.same, got.wrong, got.missing) == (False, 4, 0) and got.greatest_difference == pytest.approx(0.1)
    assert profile(lambda: x, 4, 5).nodes_per_s > 0
    rows = sweep(str(tmp_path / "s.csv"), {"n": [1, 2]}, lambda n: profile(lambda: x, n, n), repeat=2)
    assert len(rows) == 4 and len((tmp_path / "s.csv").read_text().splitlines()) == 5


@pytest.mark.parametrize("blocks", [1, 3])
def test_no_feature_is_shuffled_once_a_pair(spark, monkeypatch, blocks):
    """Many pairs are scored in tiles: features travel once a block, and the scores are the plain join's."""
    monkeypatch.setattr(transform, "BLOCKS", blocks)
    n = 40
    features = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (F.col("id") * k % 7 - 3) / 8).alias("h"))
    pairs = spark.range(n * n).select((F.col("id") % n).alias("src"), F.expr(f"id div {n}").alias("dst")).unionByName(spark.createDataFrame([(3, 4), (3, 4), (3, 999)], "src long, dst long"))
    a, b = features.toDF("src", "x"), features.toDF("dst", "y")
    want = sorted(tuple(r) for r in transform._scores(pairs, a, b).collect())
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    found = transform.link_scores(pairs, features)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == n * n + 2
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    with transform._dealt_by_tile(spark):
        plan = transform._scores(*transform._in_tiles(pairs, a, b, blocks), "tile")._jdf.queryExecution().executedPlan().toString()
    # One exchange for the pairs and one for either end, none between the joins.
    assert plan.count("Exchange hashpartitioning") == 3
