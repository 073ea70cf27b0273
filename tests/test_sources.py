"""Files and generators."""

import pytest

from meshwright.catalog import egat, gcn_layers, sage_layers
from meshwright.layers import GNNModel
from meshwright.sources import files, generators


def test_edge_list(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# comment\n0\t1\n2\t1\n")
    assert sorted(map(tuple, files.edge_list(spark, str(p)).collect())) == [(0, 1), (2, 1)]


def test_csr(spark):
    t = spark.createDataFrame([([0, 2, 3, 5, 5], [1, 2, 3, 1, 3], [0.5, 1.2, 0.8, 0.3, 0.9])], "row_ptr array<long>, col_ind array<long>, weights array<float>")
    got = [(r.src, r.dst) for r in files.csr_to_edges(t).orderBy("edge_id").collect()]
    assert got == [(0, 1), (0, 2), (1, 3), (2, 1), (2, 3)]


def test_weights_round_trip(spark, tmp_path):
    for i, layers in enumerate((gcn_layers(), sage_layers(), (egat(2),))):
        files.write_weights(spark, GNNModel(layers), str(tmp_path / str(i)))
        back = files.read_weights(spark, str(tmp_path / str(i)))
        for a, b in zip(layers, back.layers, strict=True):
            assert type(a) is type(b) and a.activation is b.activation and getattr(a, "bias", ()) == getattr(b, "bias", ())
            for name in ("w_neigh", "w_self", "w_node", "w_edge", "w_attn"):
                assert getattr(a, name, None) == getattr(b, name, None)


def test_csc_tables_of_hubs_and_isolated_nodes(spark, tmp_path, monkeypatch):
    from meshwright import graph as module
    from meshwright.graph import Graph

    monkeypatch.setattr(module, "SPAN", 7)
    edges = [(i, 2, float(i)) for i in range(50)] + [(1, 4, 0.5), (2, 4, 1.5)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(50).select("id"))
    files.write_csc_tables(g, str(tmp_path / "csc"))
    back = files.read_csc_tables(spark, str(tmp_path / "csc"))
    assert sorted((r.src, r.dst, r.weight) for r in back.edges.collect()) == sorted(edges) and back.num_nodes() == 50
    ids = [(r.edge_id, r.src) for r in back.edges.orderBy("edge_id").collect()]
    assert ids == [(i, i) for i in range(50)] + [(50, 1), (51, 2)]


def test_generators(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    er = rows(generators.erdos_renyi(spark, 60, 0.1, 3))
    assert er == rows(generators.erdos_renyi(spark, 60, 0.1, 3)) != rows(generators.erdos_renyi(spark, 60, 0.1, 4))
    assert 200 < len(er) < 520 and all(a != b for a, b in er)
    assert 0 < generators.random_edges(spark, 50, 300).count() <= 300
    ba = rows(generators.barabasi_albert(spark, 50, 2, 1))
    assert 60 < len(ba) <= 100 and all(b < a for a, b in ba)
    hubs = generators.barabasi_albert(spark, 5000, 3).groupBy("dst").count().orderBy("count", ascending=False).first()
    assert hubs["count"] > 60 and hubs["dst"] < 100
    with pytest.raises(ValueError):
        generators.barabasi_albert(spark, 2, 2)
    with pytest.raises(ValueError):
        generators.erdos_renyi(spark, 10**6, 0.1)
    ring = rows(generators.watts_strogatz(spark, 20, 4, 0.0))
    assert len(ring) == 40 and (19, 0) in ring and (19, 1) in ring
    assert all(a != b for a, b in rows(generators.watts_strogatz(spark, 20, 4, 1.0)))
    heavy = generators.power_law(spark, 500, 3).groupBy("dst").count().orderBy("count", ascending=False).first()
    assert heavy["count"] > 20
