"""Runs layer by layer: same results, states that live until the next one, and costs of layers and executors."""

import os
import re

import pytest
from pyspark.sql import functions as F

from meshwright.catalog import bias, matrix
from meshwright.functions.storage import shared_dir
from meshwright.graph import Graph
from meshwright.layers import Activation, Aggregation, EGATLayer, GCNLayer, GNNModel, GraphSAGELayer
from meshwright.plans import stages
from meshwright.plans.engine import SparkEngine


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.range(3000).select((F.col("id") * 7 % 200).alias("src"), (F.col("id") * F.col("id") % 190).alias("dst"), F.array(F.col("id") % 3 / 2.0).alias("efeat"))
    nodes = stages.numbered_features(spark.range(200), 6)
    return Graph.from_edges(edges, nodes)


def sage(a, b):
    return GraphSAGELayer(matrix(a, b, 0), matrix(a, b, 5), bias(b), Aggregation.MAX, Activation.RELU)


def gcn(a, b):
    return GCNLayer(matrix(a, b, 0), bias(b), Activation.RELU)


def by_id(df):
    return {r.id: list(r.h) for r in df.collect()}


def layers_left(spark):
    folder = re.sub("^file:/*", "/", shared_dir(spark))
    return sorted(re.sub("-[0-9a-f]{32}$", "", x) for x in os.listdir(folder) if x.startswith("layer-"))


@pytest.mark.parametrize("strategy", ["edge", "vertex", "split"])
def test_the_same_result_and_one_state_left(spark, g, strategy):
    engine = SparkEngine(GNNModel((sage(6, 8), gcn(8, 5), sage(5, 3))), strategy=strategy)
    before = layers_left(spark)
    got = stages.run_in_stages(engine, g, g.nodes)
    assert sorted(before + ["layer-2"]) == layers_left(spark)  # the first two are gone
    want, have = by_id(engine.run(g, g.nodes)), by_id(got.result)
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)
    got.close()
    assert layers_left(spark) == before


def test_costs_of_layers_and_executors(spark, g):
    got = stages.run_in_stages(SparkEngine(GNNModel((sage(6, 8), gcn(8, 5))), strategy="edge"), g, g.nodes)
    got.close()
    assert [(x.layer, x.kind, x.in_dim, x.out_dim, x.nodes) for x in got.layers] == [(0, "GraphSAGELayer", 6, 8, 200), (1, "GCNLayer", 8, 5, 200)]
    for x in got.layers:
        c = x.stages
        assert x.seconds > 0 and c.tasks >= c.stages >= 1 and c.failed_tasks == 0 and c.skew >= 1
        assert c.cpu_seconds > 0 and c.task_seconds > 0 and c.peak_task_mb > 0 and 0 < c.shuffle_read_mb <= c.shuffle_write_mb * 3
        # Executors' figures add up to the layer's.
        assert sum(e.tasks for e in x.executors) == c.tasks
        assert sum(e.shuffle_write_mb for e in x.executors) == pytest.approx(c.shuffle_write_mb)
    assert [e.executor for e in got.layers[0].executors] == ["driver"]  # local mode


def test_only_the_blocks_own_jobs_count_and_the_old_group_comes_back(spark):
    context = spark.sparkContext
    context.setJobGroup("outer", "of the caller")
    try:
        with stages.JobGroup(spark, "inner") as jobs:
            spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
        spark.range(1000).repartition(9).count()
        mine, _ = jobs.costs()
        assert context.getLocalProperty("spark.jobGroup.id") == "outer" and context.getLocalProperty("spark.job.description") == "of the caller"
        assert 0 < mine.tasks <= 2 * context.defaultParallelism and mine.shuffle_write_mb > 0
        with pytest.raises(ValueError), stages.JobGroup(spark, "fails"):
            raise ValueError
        assert context.getLocalProperty("spark.jobGroup.id") == "outer"
    finally:
        for k in stages.JobGroup.KEYS:
            context.setLocalProperty(k, None)
    with stages.JobGroup(spark, "nothing") as none:
        pass
    assert none.costs() == (stages.StageCost(0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ())


def test_wider_features_show_as_more_shuffled_bytes(spark):
    edges = spark.range(20000).select((F.col("id") % 5000).alias("src"), (F.col("id") * 31 % 4999).alias("dst"))
    g = Graph.from_edges(edges, spark.range(5000))
    written = []
    for width in (8, 64):
        h = stages.numbered_features(g.nodes, width)
        got = stages.run_in_stages(SparkEngine(GNNModel((GraphSAGELayer(matrix(width, width, 0), None, (), Aggregation.SUM),)), strategy="edge"), g, h)
        written.append(got.layers[0].stages.shuffle_write_mb)
        got.close()
    assert written[1] > 1.5 * written[0]


def test_attention_edge_features_and_an_empty_model(spark, g):
    engine = SparkEngine(GNNModel((EGATLayer(matrix(6, 4, 0), matrix(1, 4, 3), matrix(6, 2, 7), 2), gcn(4, 2))))
    got = stages.run_in_stages(engine, g, g.nodes)
    want, have = by_id(engine.run(g, g.nodes)), by_id(got.result)
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)
    got.close()
    bare = Graph.from_edges(g.edges.select("src", "dst"), g.nodes)
    with pytest.raises(ValueError):  # before any layer runs
        stages.run_in_stages(engine, bare, g.nodes)
    empty = stages.run_in_stages(SparkEngine(), bare, g.nodes)
    assert by_id(empty.result) == by_id(g.nodes) and empty.layers == [] and empty.path is None
    empty.close()


def test_sweep_writes_a_row_a_layer(spark, g, tmp_path):
    path = f"file://{tmp_path}/sweep"
    rows = stages.sweep_models(path, {"small": g}, {"sage": sage, "gcn": gcn}, [2, 5], [1, 2], {"edge": SparkEngine(strategy="edge")}).collect()
    assert sorted((r.model, r.width, r.depth, r.layer, r.engine, r.run) for r in rows) == sorted((m, w, d, i, "edge", 0) for m in ("sage", "gcn") for w in (2, 5) for d in (1, 2) for i in range(d))
    again = stages.sweep_models(f"{path}-2", {"small": g}, {"sage": sage}, [2], [1], {"edge": SparkEngine(strategy="edge"), "vertex": SparkEngine(strategy="vertex")}, repeat=2)
    assert sorted((r.engine, r.run) for r in again.collect()) == [("edge", 0), ("edge", 1), ("vertex", 0), ("vertex", 1)]
    assert all(r.edges == 3000 and r.nodes == 200 and r.edges_per_s > 0 and r.in_dim == r.width for r in rows)
    assert spark.read.csv(path, header=True).count() == len(rows)
    with pytest.raises(ValueError):
        stages.sweep_models(path, {}, {"sage": sage}, [2], [1])
