"""Queries through the public API: constructors, accessors, builder, loaders, generators and engine options, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright import catalog
from meshwright.catalog import CLASSES, F_IN, HIDDEN, MEAN, NODES, RELU, SUM, V, W, X, G, _GCN2, _SAGE2, agg_sql, base, bias, egat, egat_sql, features, gcn_layers, graph, lin_sql, long, matrix, rounded, sage_layers, sql
from meshwright.functions.arrays import dequantise, from_long, from_wide, quantise, to_long, to_wide
from meshwright.functions.storage import cut, scratch
from meshwright.graph import Graph, GraphBase, InNeighbourGraph
from meshwright.layers import Activation, Aggregation, EGATLayer, GCNLayer, GNNBuilder, GNNModel, GraphSAGELayer, SupportsLayers
from meshwright.matrix import DenseMatrix
from meshwright.operators.aggregate import aggregate
from meshwright.plans.engine import SparkEngine
from meshwright.plans.verify import profile, sweep
from meshwright.sources import files, generators

_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, text: str):
    """Register the function below as a query with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _registry[name] = (f, text)
        return f

    return add


def message(f: Callable[[], object]) -> str:
    """What a call complains of."""
    try:
        f()
    except (ValueError, IndexError, TypeError, LookupError) as e:
        return str(e)
    return "none"


def values(names: str, rows: list[tuple]) -> str:
    """SQL of some constant rows."""
    quoted = ["(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"cast({x} as {'double' if isinstance(x, float) else 'bigint'})" for x in r) + ")" for r in rows]
    return f"select * from (values {', '.join(quoted)}) t({names})"


# --- graphs

GOLDEN = (4, 5, [0, 0, 2, 3, 5], [0, 2, 0, 1, 2], [0.5, 0.25, 1.25, 0.75, 1.0])
_E4, _E2E = G("g4"), G("g2e")
_PAIRS = f"select distinct least(src, dst) as a, greatest(src, dst) as b from ({_E4})"


def _pairs_graph(s: SparkSession, d: str) -> Graph:
    g = graph(s, d, "g4")
    return Graph.undirected(g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), g.nodes)


@query(
    "graph_metadata",
    f"""select 'g2' as graph, (select count(*) from embeddings) as num_nodes, (select count(*) from ({G('g2')})) as num_edges, (select count(*) from ({G('g2')})) as num_entries, true as directed, false as weighted, false as featured, cast(0 as bigint) as feature_dim
    union all select 'g2e', (select count(*) from embeddings), (select count(*) from ({_E2E})), (select count(*) from ({_E2E})), true, false, true, 3
    union all select 'g4', (select count(*) from nation), (select count(*) from ({_E4})), (select count(*) from ({_E4})), true, true, false, 0
    union all select 'pairs', (select count(*) from nation), (select count(*) from ({_PAIRS})), (select cast(sum(case when a <> b then 2 else 1 end) as bigint) from ({_PAIRS})), false, false, false, 0
    union all select 'declared', 4, 5, 5, true, true, false, 0
    union all select 'empty features', 4, 5, 5, true, false, false, 0""",
)
def graph_metadata(s: SparkSession, d: str) -> DataFrame:
    bare = Graph.from_csc(s, *GOLDEN[:4])
    graphs = {"pairs": _pairs_graph(s, d), "declared": Graph.from_csc(s, *GOLDEN), "empty features": Graph(bare.nodes, bare.edges.withColumn("efeat", F.expr("CAST(array() AS array<double>)")))}
    graphs |= {x: graph(s, d, x) for x in ("g2", "g2e", "g4")}
    rows = [(k, g.num_nodes(), g.num_edges(), g.num_directed_entries(), g.directed, g.has_edge_weights, g.has_edge_features, g.edge_feature_dim()) for k, g in graphs.items()]
    return s.createDataFrame(rows, "graph string, num_nodes long, num_edges long, num_entries long, directed boolean, weighted boolean, featured boolean, feature_dim long")


@query("conformance", values("what, holds", [("graph base", True), ("in-neighbour graph", True), ("supports layers", True), ("no graph", False)]))
def conformance(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g4")
    rows = [("graph base", isinstance(g, GraphBase)), ("in-neighbour graph", isinstance(g, InNeighbourGraph)), ("supports layers", isinstance(SparkEngine(), SupportsLayers)), ("no graph", isinstance(g.nodes, InNeighbourGraph))]
    return s.createDataFrame(rows, "what string, holds boolean")


_CSC_CASES = [
    ("colPtr", "colPtr size must be equal to numNodes + 1", lambda s: Graph.from_csc(s, 4, 5, [0, 1], GOLDEN[3])),
    ("weights", "weights size must match rowInd size", lambda s: Graph.from_csc(s, *GOLDEN[:4], [1.0] * 3)),
    ("edge features", "edgeFeatures rows must match rowInd size", lambda s: Graph.from_csc(s, *GOLDEN[:4], edge_features=[[1.0]] * 3)),
    ("order", "colPtr must ascend from 0 to the size of rowInd", lambda s: Graph.from_csc(s, 4, 5, [0, 3, 2, 3, 5], GOLDEN[3], strict=True)),
    ("range", "rowInd must hold numEdges node ids", lambda s: Graph.from_csc(s, 4, 5, GOLDEN[2], [0, 2, 0, 1, 9], strict=True)),
    ("fine", "none", lambda s: Graph.from_csc(s, *GOLDEN, strict=True)),
]


def _messages(name: str, cases: list[tuple]) -> None:
    query(name, values("what, message", [(x, m) for x, m, _ in cases]))(lambda s, d: s.createDataFrame([(x, message(lambda: f(s))) for x, _, f in cases], "what string, message string"))


_messages("csc_errors", _CSC_CASES)


@query("undirected_neighbors", f"with p as ({_PAIRS}) select a as id, b as neighbour from p union all select b, a from p where a <> b")
def undirected_neighbors(s: SparkSession, d: str) -> DataFrame:
    return _pairs_graph(s, d).in_neighbours().select("id", "neighbour")


_OWN_FEATURES = "(src % 7) / cast(8 as double) as f0, (dst % 5) / cast(4 as double) as f1, (src + dst) % 3 / cast(2 as double) as f2"


def _edge_features(g: Graph) -> DataFrame:
    return g.edges.select("edge_id", F.array((F.col("src") % 7) / F.lit(8.0), (F.col("dst") % 5) / F.lit(4.0), (F.col("src") + F.col("dst")) % 3 / F.lit(2.0)).alias("efeat"))


@query("edge_feature_data", f"with e as (select row_number() over (order by dst, src) - 1 as id, {_OWN_FEATURES} from ({G('g2')})) select id, cast(0 as bigint) as k, f0 as v from e union all select id, 1, f1 from e union all select id, 2, f2 from e")
def edge_feature_data(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g2").with_edge_ids()
    held = Graph(g.nodes, g.edges.join(_edge_features(g), "edge_id"))
    return long(held.edge_feature_data().withColumnRenamed("edge_id", "id"), "efeat")


@query("weights_data", f"with e as ({_E4}) select row_number() over (order by dst, src) - 1 as edge_id, weight from e")
def weights_data(s: SparkSession, d: str) -> DataFrame:
    return graph(s, d, "g4").weights_data()


@query("one_node", "with " + f"e as (select row_number() over (order by dst, src) - 1 as edge_id, src, dst, weight from ({_E4})) select dst as id, count(*) over (partition by dst) as degree, edge_id, src as neighbour, weight from e where dst < 3")
def one_node(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g4").with_edge_ids()
    rows = []
    for v in range(3):
        ids = [x[0] for x in g.edges.where(F.col("dst") == v).orderBy("edge_id").select("edge_id").collect()]
        assert [g.source_of(i) for i in ids[:2]] == g.in_neighbours_of(v)[:2] and [g.weight_of(i) for i in ids[:2]] == g.in_weights_of(v)[:2]
        rows += [(v, g.in_degree(v), *x) for x in zip(ids, g.in_neighbours_of(v), g.in_weights_of(v), strict=True)]
    return s.createDataFrame(rows, "id long, degree long, edge_id long, neighbour long, weight double")


# --- matrices, layers, models, builder

_GRID = [[0.5, 1.0, -2.0], [4.0, 0.25, 8.0]]


@query(
    "matrix_operations",
    values("what, r, c, v", [("blank size", 0, 0, 0.0), ("full", 1, 1, 0.5), ("flat rows and cols", 2, 3, 6.0), *[("flat", r, c, _GRID[r][c]) for r in range(2) for c in range(3)], ("at", 1, 2, 8.0), ("row", 1, 0, 4.0), ("index", 0, 2, -2.0), ("equal", 0, 0, 1.0), ("data", 0, 5, 8.0), ("empty", 0, 0, 1.0)]),
)
def matrix_operations(s: SparkSession, d: str) -> DataFrame:
    m, flat = DenseMatrix.from_rows(_GRID), DenseMatrix.from_flat(2, 3, [x for r in _GRID for x in r])
    rows = [
        ("blank size", DenseMatrix.blank().rows, DenseMatrix.blank().cols, 0.0), ("full", 1, 1, DenseMatrix.full(2, 2, 0.5).at(1, 1)), ("flat rows and cols", flat.rows, flat.cols, float(len(flat.data))),
        *[("flat", r, c, flat[r, c]) for r in range(2) for c in range(3)],
        ("at", 1, 2, m.at(1, 2)), ("row", 1, 0, m.row(1)[0]), ("index", 0, 2, m[0][2]), ("equal", 0, 0, float(m == flat)), ("data", 0, 5, m.data[5]), ("empty", 0, 0, float(DenseMatrix.blank().empty)),
    ]
    return s.createDataFrame(rows, "what string, r long, c long, v double")


_W, _S = matrix(3, 2, 0), matrix(2, 3, 0)
_messages("matrix_errors", [
    ("size", "DenseMatrix dimension mismatch with data size.", lambda s: DenseMatrix.from_flat(2, 2, [1.0])),
    ("ragged", "DenseMatrix constructor requires all rows to have equal length.", lambda s: DenseMatrix.from_rows([[1.0], [1.0, 2.0]])),
    ("bounds", "DenseMatrix::at out of bounds", lambda s: _W.at(3, 0)),
])
_messages("layer_errors", [
    ("gcn weights", "W_neigh cannot be empty", lambda s: GCNLayer(DenseMatrix.blank())),
    ("gcn bias", "bias dimension must match out_dim", lambda s: GCNLayer(_W, (1.0,))),
    ("sage weights", "W_neigh cannot be empty", lambda s: GraphSAGELayer(DenseMatrix.blank())),
    ("sage self", "W_self dimensions must match W_neigh dimensions", lambda s: GraphSAGELayer(_W, _S)),
    ("sage bias", "bias dimension must match out_dim", lambda s: GraphSAGELayer(_W, None, (1.0,))),
    ("egat weights", "W_node cannot be empty", lambda s: EGATLayer(DenseMatrix.blank(), _W, _W)),
    ("model", "Layer dimension mismatch in GNNModel pipeline.", lambda s: GNNModel((GCNLayer(_W), GCNLayer(_W)))),
    ("builder", "Layer dimension mismatch in GNNBuilder pipeline.", lambda s: GNNBuilder(SparkEngine()).add_gcn(_W).add_gcn(_W)),
    ("not allowed", "EGATLayer is not supported here", lambda s: GNNBuilder(SparkEngine(), (GCNLayer,)).add(egat(1))),
    ("not an engine", "the engine does not say which layers it supports", lambda s: GNNBuilder(object())),
    ("no such layer", "no layer 1", lambda s: GNNModel((GCNLayer(_W),)).layer(1)),
    ("no self weights", "the layer has no W_self", lambda s: GraphSAGELayer(_W).self_weights()),
])


@query(
    "layer_accessors",
    values(
        "layer, in_dim, out_dim, has_bias, has_self, activation, aggregation, edge_features",
        [("gcn", 64, 16, True, False, "relu", "gcn_norm", False), ("sage", 64, 16, True, True, "relu", "mean", False), ("sage edge", 64, 16, False, False, "none", "sum", True), ("egat", 64, 4, False, False, "none", "attention", True)],
    ),
)
def layer_accessors(s: SparkSession, d: str) -> DataFrame:
    layers = {"gcn": gcn_layers()[0], "sage": sage_layers()[0], "sage edge": _sage_edge(), "egat": egat(2)}
    rows = [(k, x.in_dim, x.out_dim, getattr(x, "has_bias", False), getattr(x, "has_w_self", False), x.activation.value, x.aggregation.value if hasattr(x, "aggregation") else "attention", x.needs_edge_features) for k, x in layers.items()]
    return s.createDataFrame(rows, "layer string, in_dim long, out_dim long, has_bias boolean, has_self boolean, activation string, aggregation string, edge_features boolean")


@query("model_accessors", values("model, layers, empty, input_dim, output_dim, edge_features, last_out", [("none", 0, True, 0, 0, False, 0), ("gcn", 2, False, 64, 10, False, 10), ("egat", 1, False, 64, 4, True, 4)]))
def model_accessors(s: SparkSession, d: str) -> DataFrame:
    models = {"none": GNNModel(), "gcn": GNNModel(gcn_layers()), "egat": GNNModel((egat(1),))}
    rows = [(k, len(m), m.empty, m.input_dim, m.output_dim, m.needs_edge_features, m.layer(len(m) - 1).out_dim if len(m) else 0) for k, m in models.items()]
    return s.createDataFrame(rows, "model string, layers long, empty boolean, input_dim long, output_dim long, edge_features boolean, last_out long")


@query("enums", values("kind, name", [("activation", x) for x in ("none", "relu", "sigmoid")] + [("aggregation", x) for x in ("sum", "mean", "gcn_norm", "max")]))
def enums(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("activation", x.value) for x in Activation] + [("aggregation", x.value) for x in Aggregation], "kind string, name string")


def _run(s: SparkSession, d: str, model: GNNModel, g: str = "g2", **options) -> DataFrame:
    got = graph(s, d, g)
    return long(SparkEngine(model, **options).run(got, got.nodes))


_MIXED = sql({**{k: _GCN2[k] for k in ("nodes", "e", "x", "m", "h1")}, "m2": agg_sql("max", "h1", HIDDEN), "z": lin_sql([("m2", W(HIDDEN, CLASSES, 0)), ("h1", W(HIDDEN, CLASSES, 5))], True, "none")}, "z")


@query("builder_model", _MIXED)
def builder_model(s: SparkSession, d: str) -> DataFrame:
    builder = GNNBuilder(SparkEngine()).add_gcn(matrix(F_IN, HIDDEN, 0), bias(HIDDEN), RELU).add_sage(matrix(HIDDEN, CLASSES, 0), matrix(HIDDEN, CLASSES, 5), bias(CLASSES), Aggregation.MAX)
    model = builder.build()
    assert builder.build().empty
    return _run(s, d, model)


@query("builder_egat", egat_sql(2))
def builder_egat(s: SparkSession, d: str) -> DataFrame:
    layer = egat(2)
    return _run(s, d, GNNBuilder(SparkEngine()).add_egat(layer.w_node, layer.w_edge, layer.w_attn, 2).build(), "g2e")


@query("empty_model", f"with x as ({X}) select id, k, {V.format('x')} as v from x")
def empty_model(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, GNNModel())


@query("engine_edge_features", egat_sql(2).replace(_E2E, f"select row_number() over (order by dst, src) as e, src, dst, {_OWN_FEATURES} from ({G('g2')})"))
def engine_edge_features(s: SparkSession, d: str) -> DataFrame:
    """Edge features that are passed to run() go before those that the graph holds."""
    g = graph(s, d, "g2").with_edge_ids()
    other = Graph(g.nodes, g.edges.withColumn("efeat", F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0))))
    return long(SparkEngine(GNNModel((egat(2),))).run(other, g.nodes, _edge_features(g)))


def _sage_edge() -> GraphSAGELayer:
    return GraphSAGELayer(matrix(F_IN, HIDDEN, 0), None, (), SUM, w_edge=matrix(3, HIDDEN, 3))


_EF = f"select dst as id, k, sum(f) as x from (select dst, cast(0 as bigint) as k, f0 as f from ({_E2E}) union all select dst, 1, f1 from ({_E2E}) union all select dst, 2, f2 from ({_E2E})) group by 1, 2"


@query("sage_edge_features", sql({**base("g2e"), "m": agg_sql("sum", "x", F_IN), "ef": _EF, "z": lin_sql([("m", W(F_IN, HIDDEN, 0)), ("ef", W(3, HIDDEN, 3))], False, "none")}, "z"))
def sage_edge_features(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, GNNModel((_sage_edge(),)), "g2e")


# --- over whole tables: the dense graph of all line items

_DENSE = {"e": G("g1")}
query("sage_2layer_dense", sql({**_SAGE2, **_DENSE}, "z"))(lambda s, d: _run(s, d, GNNModel(sage_layers()), "g1"))
query("sage_max_layer_dense", sql({**base("g1"), "m": agg_sql("max", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0)), ("x", W(F_IN, HIDDEN, 5))], True, "relu")}, "z"))(lambda s, d: _run(s, d, GNNModel((GraphSAGELayer(matrix(F_IN, HIDDEN, 0), matrix(F_IN, HIDDEN, 5), bias(HIDDEN), Aggregation.MAX, RELU),)), "g1"))
query("egat_2head_dense", egat_sql(2, g="g1e"))(lambda s, d: _run(s, d, GNNModel((egat(2),)), "g1e"))
query("sage_edge_features_dense", sql({**base("g1e"), "m": agg_sql("sum", "x", F_IN), "ef": _EF.replace(_E2E, G("g1e")), "z": lin_sql([("m", W(F_IN, HIDDEN, 0)), ("ef", W(3, HIDDEN, 3))], False, "none")}, "z"))(lambda s, d: _run(s, d, GNNModel((_sage_edge(),)), "g1e"))
for _name in ("in_degree", "out_degree", "in_neighbors", "out_neighbors", "edge_source", "csc_colptr", "link_scores", "isolated_nodes", "undirected_mirror"):
    query(f"{_name}_dense", catalog.oracle_sql()[_name].replace(G("g2"), G("g1")))(lambda s, d, f=catalog.ON_GRAPH[_name]: f(graph(s, d, "g1")))
query("csc_round_trip_dense", catalog.oracle_sql()["csc_round_trip"].replace(G("g2"), G("g1")))(lambda s, d: Graph.from_csc_tables(*graph(s, d, "g1").to_csc_tables()).edges.select("edge_id", "src", "dst"))


# --- layouts, strategies, compression

_Q = "select id, k, round(x / (case when t > 0 then t / 127 else cast(1 as double) end)) * (case when t > 0 then t / 127 else cast(1 as double) end) as x from (select *, max(abs(x)) over (partition by id) as t from ({0}))"


@query("agg_sum_feature", sql({**base("g2"), "m": agg_sql("sum", "x", F_IN)}, "m"))
def agg_sum_feature(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g2")
    return long(aggregate(g, g.nodes, SUM, F_IN, strategy="feature"), "m")


@query("sage_mean_feature", sql({**base("g2"), "m": agg_sql("avg", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], False, "none")}, "z"))
def sage_mean_feature(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, GNNModel((GraphSAGELayer(matrix(F_IN, HIDDEN, 0)),)), strategy="feature")


for _name, _there, _back in (("long", to_long, from_long), ("wide", lambda x: to_wide(x, F_IN), lambda x: from_wide(x, F_IN))):
    query(f"layout_{_name}", f"with x as ({X}) select id, k, {V.format('x')} as v from x")(lambda s, d, there=_there, back=_back: long(back(there(features(s, d)))))


@query("quantised_features", f"with x as ({_Q.format(X)}) select id, k, {V.format('x')} as v from x")
def quantised_features(s: SparkSession, d: str) -> DataFrame:
    return long(features(s, d).withColumn("h", dequantise(quantise(F.col("h")))))


@query("sage_compressed", sql({**base("g2"), "y": _Q.format(X), "m": agg_sql("avg", "y", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], False, "none")}, "z"))
def sage_compressed(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, GNNModel((GraphSAGELayer(matrix(F_IN, HIDDEN, 0)),)), compress=True, order="aggregate_first")


@query("agg_skewed", sql({**base("g2"), "e": f"{G('g2')} union all select vec_id, 0 from embeddings", "m": agg_sql("avg", "x", F_IN)}, "m"))
def agg_skewed(s: SparkSession, d: str) -> DataFrame:
    """A node that all others point to."""
    g = graph(s, d, "g2")
    hub = Graph(g.nodes, g.edges.select("src", "dst").unionByName(g.nodes.select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))))
    return long(aggregate(hub, g.nodes, MEAN, F_IN), "m")


@query("kept_graph", sql({**base("g2"), "m": agg_sql("sum", "x", F_IN)}, "m"))
def kept_graph(s: SparkSession, d: str) -> DataFrame:
    """Held in memory for as long as its degrees and its sums are computed."""
    with graph(s, d, "g2").kept() as g:
        assert g.in_degrees().agg(F.sum("degree")).first()[0] == g.num_edges()
        return cut(long(aggregate(g, g.nodes, SUM, F_IN), "m"))


# --- files

_EDGES = f"with e as ({G('g2')}) select src, dst from e"


@query("csc_files", f"with e as ({_E4}) select row_number() over (order by dst, src) - 1 as edge_id, src, dst, weight from e")
def csc_files(s: SparkSession, d: str) -> DataFrame:
    files.write_csc_tables(graph(s, d, "g4"), folder := scratch(s, "csc"))
    return files.read_csc_tables(s, folder).edges.select("edge_id", "src", "dst", "weight")


@query("csc_row_file", _EDGES)
def csc_row_file(s: SparkSession, d: str) -> DataFrame:
    """One row of arrays, as a small graph's CSC file has them."""
    got = graph(s, d, "g2").to_csc()
    row = s.createDataFrame([(got["num_nodes"], got["num_edges"], got["col_ptr"], got["row_ind"], [])], "num_nodes long, num_edges long, col_ptr array<long>, row_ind array<long>, weights array<float>")
    row.write.parquet(path := scratch(s, "csc-row"))
    return files.read_csc(s, path).edges.select("src", "dst")


@query("csr_row_file", values("edge_id, src, dst, weight", [(0, 0, 1, 0.5), (1, 0, 2, 1.25), (2, 1, 3, 0.75), (3, 2, 1, 0.25), (4, 2, 3, 1.0)]))
def csr_row_file(s: SparkSession, d: str) -> DataFrame:
    row = s.createDataFrame([([0, 2, 3, 5, 5], [1, 2, 3, 1, 3], [0.5, 1.25, 0.75, 0.25, 1.0])], "row_ptr array<long>, col_ind array<long>, weights array<double>")
    row.write.parquet(path := scratch(s, "csr-row"))
    return files.csr_to_edges(s.read.parquet(path))


@query("edge_list_file", _EDGES)
def edge_list_file(s: SparkSession, d: str) -> DataFrame:
    graph(s, d, "g2").edges.select("src", "dst").write.csv(path := scratch(s, "edges"), sep="\t")
    return files.edge_list(s, path)


@query("edge_table_file", f"with e as ({_E4}) select src, dst, weight from e")
def edge_table_file(s: SparkSession, d: str) -> DataFrame:
    graph(s, d, "g4").edges.select("src", "dst", "weight").write.parquet(path := scratch(s, "edges"))
    return files.read_edges(s, path)


@query("features_file", f"with x as ({X}) select id, k, {V.format('x')} as v from x")
def features_file(s: SparkSession, d: str) -> DataFrame:
    files.write_embeddings(features(s, d).select("id", "h"), path := scratch(s, "features"))
    return long(files.read_features(s, path, "id", "h"))


@query("edge_features_file", _registry["engine_edge_features"][1])
def edge_features_file(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g2").with_edge_ids()
    _edge_features(g).write.parquet(path := scratch(s, "edge-features"))
    return long(SparkEngine(GNNModel((egat(2),))).run(g, g.nodes, files.read_edge_features(s, path)))


@query("weights_file", _MIXED)
def weights_file(s: SparkSession, d: str) -> DataFrame:
    layers = gcn_layers()[0], GraphSAGELayer(matrix(HIDDEN, CLASSES, 0), matrix(HIDDEN, CLASSES, 5), bias(CLASSES), Aggregation.MAX)
    files.write_weights(s, GNNModel(layers), path := scratch(s, "weights"))
    return _run(s, d, files.read_weights(s, path))


@query("ogb_files", sql({**base("g1"), "m": agg_sql("sum", "x", F_IN)}, "m"))
def ogb_files(s: SparkSession, d: str) -> DataFrame:
    """Written as the benchmark publishes them, features and labels in several files, converted, and aggregated."""
    g, folder = graph(s, d, "g1"), scratch(s, "ogb")

    def put(df: DataFrame, name: str) -> None:
        df.write.csv(f"{folder}/{name}.csv.gz", compression="gzip")

    put(g.edges.select("src", "dst"), "edge")
    for name, parts, columns in (("node-feat", 3, [F.col("h")[k] for k in range(F_IN)]), ("node-label", 2, ["label"])):
        put(features(s, d).repartitionByRange(parts, "id").sortWithinPartitions("id").select(*columns), name)
    got, nodes = files.ogb_folder(s, folder, F_IN)
    return long(aggregate(got, nodes, SUM, F_IN), "m")


@query("citation_files", f"with n as (select vec_id, row_number() over (order by 'p' || vec_id) - 1 as id, label from embeddings), l as (select label, row_number() over (order by 'c' || label) - 1 as c from (select distinct label from embeddings)) select a.id as src, b.id as dst, cast(l.c as int) as label, cast(3 as bigint) as dim from ({G('g2')}) e join n a on a.vec_id = e.src join n b on b.vec_id = e.dst join l on l.label = b.label")
def citation_files(s: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    folder = scratch(s, "citations")
    features(s, d).select(F.concat_ws("\t", name("id"), *(F.col("h")[k].cast("string") for k in range(3)), F.concat(F.lit("c"), F.col("label").cast("string")))).write.text(f"{folder}/content")
    graph(s, d, "g2").edges.select(name("dst"), name("src")).write.csv(f"{folder}/cites", sep="\t")
    g, nodes = files.citation_files(s, f"{folder}/content", f"{folder}/cites")
    return g.edges.join(nodes.select(F.col("id").alias("dst"), "label", F.size("h").cast("long").alias("dim")), "dst").select("src", "dst", "label", "dim")


@query("sweep_file", values("strategy, aggregation, run, positive", [(a, b, r, True) for a in ("edge", "vertex", "feature") for b in ("mean", "sum") for r in range(2)]))
def sweep_file(s: SparkSession, d: str) -> DataFrame:
    """A sweep's CSV, with its times reduced to whether they are there."""
    g, path = _pairs_graph(s, d), f"{_driver_folder()}/sweep.csv"
    g = Graph(cut(g.nodes), cut(g.edges), g.directed)  # so that no run makes the graph anew
    h = g.nodes.select("id", F.array(F.lit(1.0)).alias("h"))
    rows = sweep(path, {"strategy": ["edge", "vertex", "feature"], "aggregation": ["mean", "sum"]}, lambda strategy, aggregation: profile(lambda: aggregate(g, h, Aggregation(aggregation), 1, strategy=strategy), 25, 25), repeat=2)
    with open(path, encoding="utf-8") as f:
        assert len(f.readlines()) == len(rows) + 1
    return s.createDataFrame([(r["strategy"], r["aggregation"], r["run"], r["seconds"] > 0 and r["nodes_per_s"] > 0 and r["edges_per_s"] > 0 and r["peak_mb"] > 0) for r in rows], "strategy string, aggregation string, run long, positive boolean")


def _driver_folder() -> str:
    """A folder of the driver's, where a sweep's CSV goes."""
    import tempfile

    return tempfile.mkdtemp()


# --- generators

query("erdos_renyi", generators.erdos_renyi_sql(300, 0.02))(lambda s, d: generators.erdos_renyi(s, 300, 0.02))
query("random_edges", generators.random_edges_sql(10_000, 50_000))(lambda s, d: generators.random_edges(s, 10_000, 50_000))
query("barabasi_albert", generators.barabasi_albert_sql(2000, 3))(lambda s, d: generators.barabasi_albert(s, 2000, 3))
query("power_law_graph", generators.power_law_sql(10_000, 5))(lambda s, d: generators.power_law(s, 10_000, 5))
query("watts_strogatz", generators.watts_strogatz_sql(10_000, 6, 0.1))(lambda s, d: generators.watts_strogatz(s, 10_000, 6, 0.1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for k, (_, t) in _registry.items()}
