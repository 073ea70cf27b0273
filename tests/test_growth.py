"""What keeps the graph queries' costs from growing faster than their tables."""

import re

import pytest
from pyspark.sql import functions as F

from meshwright import scale_queries
from meshwright.catalog import bias, matrix
from meshwright.functions.arrays import UNROLLED, added, scaled
from meshwright.graph import BAD_ROW_IND, Graph
from meshwright.layers import Activation, Aggregation, GCNLayer, GNNModel
from meshwright.operators import transform
from meshwright.operators.aggregate import reduce_by_key
from meshwright.plans import stages
from meshwright.plans.engine import SparkEngine
from meshwright.sources import layout


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_small_weights_take_a_row_a_node(spark, monkeypatch):
    rows = [(1, [1.5, -2.0, 0.25], [4.0]), (2, [None, 1.0, None], [0.5]), (3, [None, None, None], [None]), (4, [], []), (5, None, [1.0]), (6, [1.0], [2.0]), (7, [1.0, 2.0, 3.0, 9.0], [4.0, 5.0]), (8, [1.0, 2.0, 3.0], [1.0]), (8, [4.0, 5.0, 6.0], [2.0])]
    df = spark.createDataFrame(rows, "id long, m array<double>, h array<double>")
    parts = [("m", matrix(3, 5, 0)), ("h", matrix(1, 5, 4))]
    for act in Activation:
        got = transform.linear(df, parts, bias(5), act)
        assert "Generate" not in plan(got)
        with monkeypatch.context() as m:
            m.setattr(transform, "MOST_ROWS", 0)
            want = transform.linear(df, parts, bias(5), act)
            assert "Generate" in plan(want)
        assert by_id(got) == by_id(want) and set(by_id(got)) == {1, 2, 3, 6, 7, 8}


def test_counts_of_means_lie_side_by_side(spark):
    rows = [(1, [1.0, None]), (1, [2.0, None]), (1, [4.0, 3.0]), (2, [None, None]), (3, None), (4, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "dst long, h array<double>")
    found = reduce_by_key(df, "dst", 2, Aggregation.MEAN)
    assert "avg(" not in plan(found)
    got = {k: [None if x is None else str(x) for x in v] for k, v in by_id(found).items()}
    assert got == {1: [str(7 / 3), "3.0"], 2: [None, None], 3: [None, None], 4: ["1.0", "nan"]}


@pytest.mark.parametrize("dim", [0, 2, UNROLLED, UNROLLED + 1])
def test_arrays_times_and_plus(spark, dim):
    h = [k / 4 for k in range(dim)]
    df = spark.createDataFrame([(1, h, 2.0), (2, None, 2.0)], "id long, h array<double>, x double")
    got = df.select("id", scaled(F.col("h"), F.col("x"), dim).alias("a"), added(F.col("h"), F.col("h"), dim).alias("b")).collect()
    assert {r.id: (r.a, r.b) for r in got} == {1: ([2 * x for x in h], [2 * x for x in h]), 2: (None, None)}


def test_an_undirected_graph_counts_its_degrees_where_its_edges_lie(spark):
    pairs = spark.range(400).select((F.col("id") % 37).alias("src"), (F.col("id") * F.col("id") % 41).alias("dst")).distinct().where("src <= dst")
    nodes = spark.range(45).select("id", F.array(F.col("id") / 8, F.lit(1.0)).alias("h"))
    g = Graph.undirected(pairs, nodes)
    model = GNNModel((GCNLayer(matrix(2, 2, 0), bias(2)),))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = layout.colocated(g)
        got = SparkEngine(model, strategy="colocated").run(at, at.nodes)
        # Only sums by destination travel.
        assert len(re.findall(r"Exchange hashpartitioning\(dst", plan(got))) == 1
        want = by_id(SparkEngine(model).run(g, g.nodes))
        have = by_id(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)


def test_no_row_carries_an_array_of_all_edges(spark, tmp_path):
    row = [(4, 5, [0, 0, 2, 3, 5], [0, 2, 0, 1, 2], [0.5, 0.25, 1.25, 0.75, 1.0])]
    schema = "num_nodes long, num_edges long, col_ptr array<long>, row_ind array<long>, weights array<float>"
    spark.createDataFrame(row, schema).write.parquet(path := f"{tmp_path}/row")
    g = Graph.from_csc_table(spark.read.parquet(path))
    assert not re.search(r"Generate .*\), \[[^\]]*(row_ind|weights)", plan(g.edges))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 0, 1, 0.5), (1, 2, 1, 0.25), (2, 0, 2, 1.25), (3, 1, 3, 0.75), (4, 2, 3, 1.0)]
    assert sorted(r.id for r in g.nodes.collect()) == [0, 1, 2, 3]
    for weights in ([], None):
        bare = Graph.from_csc_table(spark.createDataFrame([(2, 1, [0, 1, 1], [1], weights), (0, 0, [0], [], weights)][:1], schema))
        assert list(map(tuple, bare.edges.collect())) == [(0, 1, 0, None)]
    empty = Graph.from_csc_table(spark.createDataFrame([(0, 0, [0], [], [])], schema))
    assert empty.edges.collect() == [] and empty.nodes.collect() == []
    short = Graph.from_csc_table(spark.createDataFrame([(2, 2, [0, 1, 2], [1], [])], schema))
    with pytest.raises(Exception, match=BAD_ROW_IND):
        short.edges.collect()


def test_no_layer_of_the_sweep_deals_edges_again(spark, monkeypatch):
    class Seen(Exception):
        pass

    def look(path, graphs, kinds, widths, depths, engines=None, repeat=1):
        for g in graphs.values():
            for engine in (engines or {"auto": SparkEngine()}).values():
                model = GNNModel(tuple(kinds["sage"](4, 4) for _ in range(2)))
                text = plan(engine.with_model(model).run(g, stages.numbered_features(g.nodes, 4)))
                assert "Exchange hashpartitioning(dst" in text and "Exchange hashpartitioning(src" not in text
        raise Seen

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(stages, "sweep_models", look)
    try:
        with pytest.raises(Seen):
            scale_queries.layer_sweep(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
