"""Seeds, partitions, layouts and hubs: results against whole runs, and what their plans do."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from meshwright.catalog import egat, gcn_layers, matrix, sage_layers
from meshwright.graph import Graph
from meshwright.layers import Aggregation, EGATLayer, GCNLayer, GNNModel, GraphSAGELayer
from meshwright.matrix import DenseMatrix
from meshwright.operators import aggregate as aggregates
from meshwright.operators import frontier, partition
from meshwright.operators.aggregate import aggregate
from meshwright.plans.engine import SparkEngine
from meshwright.plans.verify import verify
from meshwright.sources import files, layout


def made(spark, n=60, m=150, seed=5, dim=64):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), int(n * rng.random() ** 2), float(rng.randrange(1, 5)), [rng.random(), 0.5, rng.random()]) for _ in range(m)]
    nodes = [(i, [((i * (k + 1)) % 17 - 8) / 8 for k in range(dim)]) for i in range(n)]
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double, efeat array<double>"), spark.createDataFrame(nodes, "id long, h array<double>"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


MODELS = {"gcn": GNNModel(gcn_layers()), "sage": GNNModel(sage_layers()), "egat": GNNModel((egat(2),)), "no loops": GNNModel((GCNLayer(matrix(64, 16, 0), self_loops=False),)), "edges": GNNModel((GraphSAGELayer(matrix(64, 8, 0), w_edge=matrix(3, 8, 3)),)), "none": GNNModel()}


# --- seeds


@pytest.mark.parametrize("name", list(MODELS))
def test_seeds_give_the_rows_of_a_whole_run(spark, name):
    g, engine = made(spark), SparkEngine(MODELS[name], use_edge_weights=name == "sage")
    whole = {r.id: r.h for r in engine.run(g, g.nodes).collect()}
    seeds = spark.createDataFrame([(3,), (3,), (59,), (0,), (1000,), (None,)], "id long")
    got = {r.id: r.h for r in engine.run(g, g.nodes, seeds=seeds).collect()}
    assert got.keys() == {0, 3, 59}
    for v, h in got.items():
        assert h == pytest.approx(whole[v], abs=1e-9)


def test_no_seeds_and_seeds_without_edges(spark):
    g = made(spark)
    lonely = Graph(g.nodes, g.edges.where("dst <> 7"))
    none = spark.createDataFrame([], "id long")
    for model in (MODELS["gcn"], MODELS["egat"]):
        assert SparkEngine(model).run(g, g.nodes, seeds=none).count() == 0
        (row,) = SparkEngine(model).run(lonely, g.nodes, seeds=spark.createDataFrame([(7,)], "id long")).collect()
        want = next(r for r in SparkEngine(model).run(lonely, g.nodes).collect() if r.id == 7)
        assert row.h == pytest.approx(want.h)


def test_blocks_hold_just_what_the_seeds_need(spark):
    edges = [(1, 0), (2, 1), (3, 2), (4, 3), (9, 8), (0, 5)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    first, second = frontier.blocks(g, spark.createDataFrame([(0,)], "id long"), 2)
    ids = lambda s: sorted(r.id for r in s.ids.collect())
    assert (ids(second.targets), ids(second.sources), ids(first.targets), ids(first.sources)) == ([0], [0, 1], [0, 1], [0, 1, 2])
    assert sorted((r.src, r.dst) for r in first.edges.collect()) == [(1, 0), (2, 1)]
    assert {(r.hop, r.id) for r in frontier.hops(g, spark.createDataFrame([(0,)], "id long"), 2).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_edges_are_filtered_before_anything_joins_them(spark, tmp_path, monkeypatch):
    """Only frontier edges are written and joined; node sets too large to send are semi-joined by a shuffle."""
    g = made(spark, n=400, m=1200)
    g.edges.write.parquet(f"file://{tmp_path}/e")
    g = Graph(g.nodes, spark.read.parquet(f"file://{tmp_path}/e"))
    seeds = spark.createDataFrame([(5,)], "id long")
    parts = frontier.blocks(g, seeds, 2)
    assert sum(p.edges.count() for p in parts) < 100
    plan = plan_of(SparkEngine(MODELS["sage"]).run(g, g.nodes, seeds=seeds))
    assert f"{tmp_path}/e" not in plan  # the edges as a whole are not read again
    plan = plan_of(parts[0].sources.keep(g.edges, "dst"))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "Exchange hash" not in plan
    monkeypatch.setattr(frontier, "MOST_SENT", 0)
    again = frontier.blocks(g, seeds, 2)
    assert [p.edges.count() for p in again] == [p.edges.count() for p in parts]


# --- partitions


def clustered(spark, clusters=6, size=40, seed=2):
    """Dense clusters with few edges between, ids dealt at random."""
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), clusters * size)
    edges = set()
    for c in range(clusters):
        own = ids[c * size : (c + 1) * size]
        edges |= {tuple(rng.sample(own, 2)) for _ in range(size * 6)}
    edges |= {tuple(rng.sample(ids, 2)) for _ in range(60)}
    return Graph.from_edges(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(i,) for i in ids], "id long"))


def test_partitions_are_even_and_cut_less_than_hashing(spark):
    g = clustered(spark)
    placed = partition.partition(g, 6, rounds=8)
    assert placed.count() == placed.select("id").distinct().count() == 240
    rows = partition.quality(g, placed).collect()
    total = sum(r.work for r in rows)
    assert all(r.work <= total * 1.05 / 6 for r in rows) and len(rows) == 6
    assert sum(r.cut for r in rows) < 0.8 * sum(r.cut for r in partition.quality(g, partition.hashed(g, 6)).collect())


@pytest.mark.parametrize("sent", [0, 1 << 30])
def test_a_hub_and_loops_and_equal_edges(spark, monkeypatch, sent):
    monkeypatch.setattr(partition, "BROADCAST_BYTES", sent)
    edges = [(i, 0) for i in range(1, 50)] + [(3, 3)] * 5 + [(4, 5)] * 3
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    placed = {r.id: r.part for r in partition.partition(g, 4, rounds=3).collect()}
    assert placed.keys() == set(range(50)) and set(placed.values()) == set(range(4))
    # The hub alone exceeds a share: nothing joins it.
    assert [i for i, p in placed.items() if p == placed[0]] == [0] or sum(1 for p in placed.values() if p == placed[0]) <= 13
    with pytest.raises(ValueError):
        partition.partition(g, 0)


def test_an_undirected_graph_s_edges_vote_once_for_both_ends(spark):
    """Half the rows, and the parts that the same edges give as directed ones."""
    g = clustered(spark)
    pairs = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = Graph.undirected(pairs, g.nodes)
    assert partition._neighbours(both).count() == both.edges.where("src <> dst").count()
    as_directed = Graph(both.nodes, both.edges)
    assert sorted(partition.partition(both, 6).collect()) == sorted(partition.partition(as_directed, 6).collect())


def test_partition_of_an_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert partition.partition(g, 3).count() == 0


# --- layouts and hubs


def walk(node):
    """A plan's nodes with their children, through adaptive wrappers."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    children = node.children()
    below = [walk(children.apply(i)) for i in range(children.size())]
    return node.nodeName(), node.simpleString(1000), below


def raw_scans(tree, table, shuffled=False):
    """How many scans of `table` have their rows shuffled before they are aggregated."""
    name, text, below = tree
    if "Aggregate" in name:
        shuffled = False
    elif name.startswith("Exchange"):
        shuffled = True
    own = int(shuffled and table in name + text)
    return own + sum(raw_scans(x, table, shuffled) for x in below)


def count_of(tree, name):
    return int(tree[0].startswith(name)) + sum(count_of(x, name) for x in tree[2])


@pytest.mark.parametrize("name", ["gcn", "sage"])
def test_colocated_edges_stay_where_they_are(spark, tmp_path, name):
    g = made(spark, n=300, m=2000)
    laid = layout.colocated(g, prefix=f"laid_{name}")
    three = {"gcn": (*gcn_layers(), GCNLayer(matrix(10, 4, 0))), "sage": (*sage_layers(), GraphSAGELayer(matrix(10, 4, 0), matrix(10, 4, 5)))}[name]
    model = GNNModel(three)
    out = SparkEngine(model, strategy="colocated", use_edge_weights=name == "sage").run(laid, laid.nodes)
    assert verify(out, SparkEngine(model, use_edge_weights=name == "sage").run(g, g.nodes)).same
    g.edges.write.option("path", f"file://{tmp_path}/usual").saveAsTable(f"usual_{name}_edges")
    usual = Graph(g.nodes, spark.table(f"usual_{name}_edges"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [walk(SparkEngine(model, strategy=how).run(x, x.nodes)._jdf.queryExecution().executedPlan()) for x, how in ((laid, "colocated"), (usual, "edge"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # No row of the edges is shuffled before it is part of a sum.
    assert raw_scans(plans[0], f"laid_{name}_edges") == 0 < raw_scans(plans[1], f"usual_{name}_edges")
    if name == "sage":
        assert count_of(plans[0], "Exchange") < count_of(plans[1], "Exchange")
    again = layout.opened(spark, f"laid_{name}")
    assert again.edges.count() == 2000
    layout.drop(spark, f"laid_{name}")
    spark.sql(f"DROP TABLE usual_{name}_edges")


@pytest.mark.parametrize("kind", list(Aggregation))
@pytest.mark.parametrize("loops", [False, True])
def test_strategies_agree(spark, kind, loops):
    g = made(spark, dim=5)
    laid = layout.colocated(g, buckets=3)
    want = {r.id: r.m for r in aggregate(g, g.nodes, kind, 5, loops, kind is Aggregation.SUM).collect()}
    for graph, strategy in ((laid, "colocated"), (g, "split")):
        got = {r.id: r.m for r in aggregate(graph, graph.nodes, kind, 5, loops, kind is Aggregation.SUM, strategy=strategy).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_hubs_are_few_and_their_edges_are_spread(spark):
    edges = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("src"), (F.col("id") % 211).alias("dst")).repartition(16)
    side = spark.range(500).select(F.col("id").alias("src"), F.array(F.lit(1.0)).alias("h"))
    heavy = aggregates.hubs(edges, 20)
    assert [r.src for r in heavy.collect()] == [7]
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        of = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        joined, split = of(edges.join(side, "src")), of(aggregates._split(edges, side, heavy))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(joined) == sum(split) == 40_000
    assert max(joined) > 3 * sorted(joined)[len(joined) // 2]
    assert max(split) <= 3 * sorted(split)[len(split) // 2]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    def put(name, lines, pack=gzip.compress):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(pack("".join(f"{x}\n" for x in lines).encode()))

    put("feat.csv.gz/part-00000.csv.gz", ["0,0.5", "1,1.5"])
    put("feat.csv.gz/part-00001.csv.gz", [f"{i},{i + 0.5}" for i in range(2, 6)])
    put("plain/b.csv", range(3000, 20_000), bytes)
    put("plain/a.csv", range(3000), bytes)
    put("plain/c.csv", range(20_000, 20_002), bytes)
    rows = files.numbered_csv(spark, f"file://{tmp_path}/feat.csv.gz", "n long, x double").collect()
    assert sorted((r.row, r.n, r.x) for r in rows) == [(i, i, i + 0.5) for i in range(6)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        plain = files.numbered_csv(spark, f"file://{tmp_path}/plain", "n long")
        assert plain.rdd.getNumPartitions() > 5 and plain.where("row <> n").count() == 0 and plain.count() == 20_002
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.numbered_csv(spark, f"file://{tmp_path}/plain", "n long").where("row <> n").count() == 0


def test_ogb_folder_of_several_parts(spark, tmp_path):
    for name, parts in {"edge": [["0,1", "5,2"]], "node-feat": [["0.0", "0.5"], ["1.0", "1.5", "2.0", "2.5"]], "node-label": [["10", "11", "12", "13"], ["14", "15"]]}.items():
        (tmp_path / f"{name}.csv.gz").mkdir()
        for i, lines in enumerate(parts):
            (tmp_path / f"{name}.csv.gz" / f"part-0000{i}.csv.gz").write_bytes(gzip.compress("\n".join([*lines, ""]).encode()))
    g, nodes = files.ogb_folder(spark, f"file://{tmp_path}", 1)
    assert sorted((r.id, r.h, r.label) for r in nodes.collect()) == [(i, [i / 2], 10 + i) for i in range(6)]
    assert g.num_edges() == 2


def test_attention_joins_the_edges_once(spark):
    g = made(spark)
    plan = walk(SparkEngine(GNNModel((egat(2),))).run(g, g.nodes)._jdf.queryExecution().executedPlan())

    def joins(tree):
        return int("Join" in tree[0] and ("src" in tree[1] or "dst" in tree[1])) + sum(map(joins, tree[2]))

    assert joins(plan) <= 3  # by source, by destination, and the sums with the nodes


def test_attention_over_scores_far_apart(spark):
    """Scores from -1e4 to 1e4: the softmax neither overflows nor vanishes."""
    layer = EGATLayer(DenseMatrix.from_rows([[1.0]]), DenseMatrix.from_rows([[1.0]]), DenseMatrix.from_rows([[0.0], [0.0], [1.0]]))
    scores = [1e4, 1e4 - 1, -1e4, 31.9, 32.1, 0.0, -0.5]
    edges = [(i, 100, [s]) for i, s in enumerate(scores)] + [(2, 101, [-1e6]), (3, 101, [-1e6 + 5])]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, efeat array<double>"))
    h = g.nodes.select("id", F.array(F.col("id").cast("double") + 1).alias("h"))
    got = {r.id: r.h[0] for r in SparkEngine(GNNModel((layer,))).run(g, h).collect()}
    leaky = lambda x: x if x >= 0 else 0.2 * x
    for v in (100, 101):
        own = [(leaky(e[0]), s + 1) for s, d, e in edges if d == v]
        top = max(x for x, _ in own)
        weights = [math.exp(x - top) for x, _ in own]
        assert got[v] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, own, strict=True)) / sum(weights), abs=1e-9)
