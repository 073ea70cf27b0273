"""Batches of destinations, point reads, packed sums and costs."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from meshwright import scale_queries
from meshwright.catalog import gcn_layers, sage_layers
from meshwright.graph import Graph
from meshwright.layers import Aggregation, GNNModel
from meshwright.operators import batches, packed
from meshwright.operators.aggregate import aggregate
from meshwright.plans import cost
from meshwright.plans.engine import SparkEngine
from meshwright.sources import clustered


def made(spark, n=80, m=400, seed=3, dim=5, hub=None):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), int(n * rng.random() ** 2) if hub is None else hub, float(rng.randrange(1, 5))) for _ in range(m)]
    nodes = [(i, [((i * (k + 1)) % 17 - 8) / 8 for k in range(dim)]) for i in range(n)]
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(nodes, "id long, h array<double>"))


def by_id(df, column="m"):
    return {r["id"]: r[column] for r in df.collect()}


def assert_near(got, want, within=1e-9):
    assert got.keys() == want.keys()
    for v in got:
        assert got[v] == pytest.approx(want[v], abs=within)


# --- batches


@pytest.mark.parametrize("budget", [1, 56 * 3, 56 * 40, 10**9])
def test_ranges_cover_all_nodes_within_the_budget(spark, budget):
    g = made(spark)
    found = sorted(batches.ranges(g, 5, budget).collect(), key=lambda r: (r.first, r.last))
    degrees = {r.id: r.degree for r in g.in_degrees().collect()}
    assert sum(r.nodes for r in found) == 80 and sum(r.messages for r in found) == 400
    end = -1
    for r in found:
        assert r.first == end + 1
        end = r.last
        assert r.messages == sum(degrees[v] for v in range(r.first, r.last + 1)) and r.message_bytes == r.messages * 56
        assert r.message_bytes <= budget or r.nodes == 1
    assert end == 79


@pytest.mark.parametrize("kind,options", [(Aggregation.SUM, {"use_edge_weights": True}), (Aggregation.MEAN, {}), (Aggregation.MAX, {"self_loops": True}), (Aggregation.GCN_NORM, {"self_loops": True})])
def test_batches_give_the_whole_result_and_lost_ones_are_made_again(spark, tmp_path, kind, options):
    g, folder = made(spark), str(tmp_path / "ranges")
    want, steps = by_id(aggregate(g, g.nodes, kind, 5, **options)), []
    run = lambda: by_id(batches.aggregate_in_batches(g, g.nodes, kind, 5, 56 * 150, folder, done=lambda *x: steps.append(x), **options))
    assert_near(run(), want)
    assert len(steps) > 2
    lost = steps[1]
    os.remove(f"{folder}/range-{lost[0]}-{lost[1]}/_SUCCESS")
    steps.clear()
    assert_near(run(), want)
    assert steps == [lost]


def test_batches_of_nothing_and_of_a_hub(spark, tmp_path):
    none = Graph(spark.createDataFrame([], "id long, h array<double>"), spark.createDataFrame([], "src long, dst long"))
    assert batches.aggregate_in_batches(none, none.nodes, Aggregation.SUM, 5, 100, str(tmp_path / "a")).count() == 0
    g = made(spark, hub=7)
    assert_near(by_id(batches.aggregate_in_batches(g, g.nodes, Aggregation.SUM, 5, 500, str(tmp_path / "b"))), by_id(aggregate(g, g.nodes, Aggregation.SUM, 5)))
    with pytest.raises(ValueError):
        many = Graph.from_edges(spark.range(20_100).select(F.col("id").alias("src"), F.col("id").alias("dst")))
        batches.aggregate_in_batches(many, many.nodes, Aggregation.SUM, 5, 1, str(tmp_path / "c"))


# --- point reads


def rows_scanned(df):
    df.collect()
    plan, stack, total = df._jdf.queryExecution().executedPlan(), [], 0
    stack.append(plan)
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_one_node_s_edges_are_read_without_the_others(spark, tmp_path):
    n, m = 50_000, 400_000
    edges = spark.range(m).select((F.col("id") * 7919 % n).alias("src"), (F.xxhash64("id") % n + n).alias("dst"), (F.col("id") % 5).cast("double").alias("weight"))
    g = Graph.from_edges(edges.withColumn("dst", F.pmod("dst", F.lit(n))), spark.range(n).toDF("id"))
    clustered.write(g, f"file://{tmp_path}")
    c = clustered.Clustered.open(spark, f"file://{tmp_path}")
    want = sorted((r.src, r.weight) for r in g.edges.where("dst = 4321").collect())
    assert c.in_neighbours_of(4321) == [x for x, _ in want] and sorted(zip(c.in_neighbours_of(4321), c.in_weights_of(4321), strict=True)) == want
    assert c.in_degree(4321) == len(want) > 0 and c.in_neighbours_of(n + 5) == []
    first = c.in_edges(4321).agg(F.min("edge_id")).first()[0]
    assert c.source_of(first) == want[0][0] and c.weight_of(first) in {w for s, w in want if s == want[0][0]}
    with pytest.raises(IndexError):
        c.source_of(m)
    for point in (c.in_edges(4321), c.edge(first), c.in_edges(100, 110)):
        assert 0 < rows_scanned(point) <= 3 * clustered.PAGE_ROWS
    assert rows_scanned(c.graph.edges) == m


# --- packed sums


@pytest.mark.parametrize("bits", [21, 32, 64])
def test_packed_sums_unpack_exactly(spark, bits):
    """Sums of as many messages as the parts hold, of either sign."""
    most = min(packed.LANES.get(bits, 10**9) - 1, 10**9)
    for values in ([127, -127, 127, -127, 0, 1, -1], [-127] * 7, [0] * 7, [-1, 0, 0, -1, 1, -1, 0]):
        one = spark.createDataFrame([(1, [float(x) for x in values])], "id long, h array<double>")
        p = packed.pack(one, [1.0] * 7, bits)
        sums = p.select(*(F.col("p")[j] * most for j in range(-(-7 // (64 // bits))))).toDF(*(f"p{j}" for j in range(-(-7 // (64 // bits)))))
        (got,) = sums.select(F.array(*packed.unpack([F.col(c) for c in sums.columns], [1.0] * 7, bits)).alias("m")).collect()
        assert got.m == [float(x * most) for x in values]


@pytest.mark.parametrize("most", [None, 10_000, 20_000_000])
@pytest.mark.parametrize("kind,loops", [(Aggregation.SUM, False), (Aggregation.MEAN, True), (Aggregation.GCN_NORM, True)])
def test_column_scales_stay_within_their_error(spark, kind, loops, most):
    g = made(spark, dim=7)
    exact = by_id(aggregate(g, g.nodes, kind, 7, self_loops=loops))
    got = by_id(aggregate(g, g.nodes, kind, 7, self_loops=loops, compress="columns", most_messages=most))
    degree = {r.id: r.degree + loops for r in g.in_degrees().collect()}
    assert got.keys() == exact.keys() and got != exact
    for v in got:
        bound = (1 if kind is Aggregation.MEAN else degree[v]) / 254
        assert all(abs(a - b) <= bound + 1e-12 for a, b in zip(got[v], exact[v], strict=True))


def test_maxima_weights_zeros_and_models_with_column_scales(spark):
    g = made(spark, dim=64)
    for kind, options in ((Aggregation.MAX, {}), (Aggregation.SUM, {"use_edge_weights": True})):
        assert_near(by_id(aggregate(g, g.nodes, kind, 64, compress="columns", **options)), by_id(aggregate(g, g.nodes, kind, 64, compress=True, **options)))
    zero = g.nodes.select("id", F.transform("h", lambda x: x * 0.0).alias("h"))
    assert {tuple(x) for x in by_id(aggregate(g, zero, Aggregation.SUM, 64, compress="columns")).values()} == {(0.0,) * 64}
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert aggregate(none, none.nodes, Aggregation.SUM, 64, compress="columns").count() == 0
    for layers in (gcn_layers(), sage_layers()):
        plain, small = (by_id(SparkEngine(GNNModel(layers), compress=c).run(g, g.nodes), "h") for c in (False, "columns"))
        top = max(abs(x) for h in plain.values() for x in h)
        assert_near(small, plain, 0.05 * top)


# --- costs


def test_statistics_and_choices(spark):
    g = made(spark)
    ins, outs = ({r.id: r.degree for r in d.collect()} for d in (g.in_degrees(), g.out_degrees()))
    s = cost.Statistics.of(g)
    assert s == cost.Statistics(80, 400, max(ins.values()), max(outs.values()), sum(x * 1024 > 400 for x in outs.values()))
    none = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long"))
    assert cost.Statistics.of(none) == cost.Statistics(0, 0, 0, 0, 0)
    big = 10**9
    assert cost.choose(cost.Statistics(big, 20 * big, 1000, 1000, 0), 64, 2000, 100) == "edge"
    assert cost.choose(cost.Statistics(big, 20 * big, 1000, 5 * big, 1), 64, 2000, 100) == "split"
    assert cost.choose(cost.Statistics(10**5, big, 20_000, 20_000, 0), 64, 200, 10) == "vertex"
    assert cost.choose(cost.Statistics(10**5, big, big // 2, 20_000, 0), 64, 200, 10) == "edge"
    assert "vertex" not in cost.costs(cost.Statistics(big, big, 9, 9, 0), 64, 200)


def test_auto_takes_the_cheapest_for_each_layer(spark):
    g = made(spark, dim=64)
    model = GNNModel(sage_layers())
    s = cost.Statistics.of(g)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    engine = SparkEngine(model, statistics=s)
    machines = math.ceil(spark.sparkContext.defaultParallelism / 8)
    for layer in model.layers:
        assert engine.strategy_of(layer, g) == cost.choose(s, layer.out_dim if engine.transforms_first(layer) else layer.in_dim, tasks, machines)
        assert SparkEngine(model).strategy_of(layer, g) == "edge" and SparkEngine(model, strategy="split", statistics=s).strategy_of(layer, g) == "split"
    assert_near(by_id(engine.run(g, g.nodes), "h"), by_id(SparkEngine(model).run(g, g.nodes), "h"))


def test_pairs_are_found_once_and_read_from_files(spark):
    """Passes over the graph of orders and parts don't find its distinct pairs again."""
    g = scale_queries.orders_and_parts(spark, "/root/testdata/sf0.001")
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "lineitem" not in plan
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    assert g.num_edges() == items and g.edges.distinct().count() == g.edges.count() == 2 * items


def test_degrees_are_counted_once_for_all_ranges(spark, tmp_path, monkeypatch):
    g, seen = made(spark), []
    real = batches.aggregate
    monkeypatch.setattr(batches, "aggregate", lambda *x, **k: seen.append(k["degrees"]._jdf.queryExecution().executedPlan().toString()) or real(*x, **k))
    batches.aggregate_in_batches(g, g.nodes, Aggregation.GCN_NORM, 5, 56 * 150, str(tmp_path / "ranges"), self_loops=True)
    assert len(seen) > 2 and not any("Exchange" in x for x in seen)
