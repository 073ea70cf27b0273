"""The graph engine's queries over the driver's tables, and the SQL to hold them against.

Graphs: g1 is dense (line items: order to part, modulo the number of embeddings),
g2 sparse and skewed with isolated nodes, g3 supplier to part with weights and
edge features, g4 nation to nation with revenue as weight. Results are long
rows (id, k, v) rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.arrays import argmax, softmax
from meshwright.graph import Graph
from meshwright.layers import Activation, Aggregation, EGATLayer, GCNLayer, GNNModel, GraphSAGELayer
from meshwright.matrix import DenseMatrix
from meshwright.operators import transform as T
from meshwright.operators.aggregate import aggregate, gather, with_self_loops
from meshwright.plans.engine import SparkEngine
from meshwright.plans.verify import verify

F_IN, HIDDEN, CLASSES = 64, 16, 10
RELU, SIGMOID = Activation.RELU, Activation.SIGMOID
SUM, MEAN, MAX, NORM = Aggregation.SUM, Aggregation.MEAN, Aggregation.MAX, Aggregation.GCN_NORM

# --- weights: dyadic, so sums are exact in binary


def w(k: int, j: int, a: int) -> float:
    return ((k * 31 + j * 17 + a) % 13 - 6) / 8


def matrix(rows: int, cols: int, a: int) -> DenseMatrix:
    return DenseMatrix.from_rows([[w(k, j, a) for j in range(cols)] for k in range(rows)])


def bias(cols: int) -> tuple[float, ...]:
    return tuple(j / 8 for j in range(cols))


# --- graphs and features

#: Revenue in whole ten-thousandths, so that sums are exact in any order.
REVENUE = "CAST(round(l_extendedprice * 100) AS bigint) * CAST(round((1 - l_discount) * 100) AS bigint)"

def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("h"), "label")


def graph(spark: SparkSession, sf: str, name: str) -> Graph:
    nodes = features(spark, sf)
    if name in ("g1", "g2"):
        n = nodes.count()
        items = _table(spark, sf, "lineitem")
        part = F.col("l_partkey") % n
        if name == "g1":
            edges = items.select((F.col("l_orderkey") % n).alias("src"), part.alias("dst"))
        else:
            items = items.where("l_linenumber = 1 AND l_quantity > 40")
            edges = items.select((F.col("l_orderkey") % n).alias("src"), F.floor(part * part / F.lit(n)).alias("dst"))
        return Graph.from_edges(edges.distinct(), nodes)
    if name in ("g1e", "g2e"):  # the line items of g1 or g2 with edge features, equal pairs and all
        n = nodes.count()
        items = _table(spark, sf, "lineitem")
        part = F.col("l_partkey") % n
        if name == "g2e":
            items, part = items.where("l_linenumber = 1 AND l_quantity > 40"), F.floor(part * part / F.lit(n))
        feat = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
        return Graph.from_edges(items.select((F.col("l_orderkey") % n).alias("src"), part.alias("dst"), feat.alias("efeat")), nodes)
    if name == "g3":
        e = _table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
        shift = _table(spark, sf, "supplier").count()
        return Graph.from_edges(e.select("src", (F.col("dst") + shift).alias("dst"), "weight"))
    items, orders = _table(spark, sf, "lineitem"), _table(spark, sf, "orders")
    supplier, customer = _table(spark, sf, "supplier"), _table(spark, sf, "customer")
    sold = items.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey"))
    e = sold.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg((F.sum(F.expr(REVENUE)).cast("double") / 10000).alias("weight"))
    nodes = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return Graph.from_edges(e, nodes)


def long(df: DataFrame, column: str = "h") -> DataFrame:
    """(id, k, v) rows of an array column."""
    each = df.select("id", F.posexplode(column).alias("k", "v"))
    return each.select("id", F.col("k").cast("long").alias("k"), rounded(F.col("v")).alias("v"))


def rounded(x: Column) -> Column:
    return F.round(x.cast("double"), 6) + F.lit(0.0)


# --- the SQL side


def G(name: str) -> str:
    n = "(select count(*) from embeddings)"
    return {
        "g1": f"select distinct l_orderkey % {n} as src, l_partkey % {n} as dst from lineitem",
        "g2": f"select distinct l_orderkey % {n} as src, ((l_partkey % {n}) * (l_partkey % {n})) // {n} as dst from lineitem where l_linenumber = 1 and l_quantity > 40",
        "g1e": f"select row_number() over () as e, l_orderkey % {n} as src, l_partkey % {n} as dst, l_discount as f0, l_tax as f1, l_quantity / 50 as f2 from lineitem",
        "g2e": f"select row_number() over () as e, l_orderkey % {n} as src, ((l_partkey % {n}) * (l_partkey % {n})) // {n} as dst, l_discount as f0, l_tax as f1, l_quantity / 50 as f2 from lineitem where l_linenumber = 1 and l_quantity > 40",
        "g3": "select l_suppkey as src, l_partkey + (select count(*) from supplier) as dst, sum(l_quantity) as weight from lineitem group by 1, 2",
        "g4": "select cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst, cast(sum(cast(round(l_extendedprice * 100) as bigint) * cast(round((1 - l_discount) * 100) as bigint)) as double) / 10000 as weight from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1, 2",
    }[name]


NODES = "select vec_id as id from embeddings"
X = "select vec_id as id, cast(unnest(range(64)) as bigint) as k, cast(unnest(embedding) as double) as x from embeddings"
V = "round({0}, 6) + cast(0 as double)"


def W(rows: int, cols: int, a: int) -> str:
    return f"select cast(k as bigint) as k, cast(j as bigint) as j, (((k * 31 + j * 17 + {a}) % 13) - 6) / cast(8 as double) as w from range({rows}) a(k), range({cols}) b(j)"


def inv(loops: bool, degrees: str = "e") -> str:
    d = f"coalesce(n, 0) + {int(loops)}"
    return f"select id, case when {d} > 0 then 1 / sqrt(cast({d} as double)) else cast(0 as double) end as f from nodes left join (select dst, count(*) as n from {degrees} group by dst) on dst = id"


def agg_sql(kind: str, x: str, dim: int, loops: bool = False, weight: str | None = None) -> str:
    """CTE text of (id, k, x): the aggregate of CTE `x` over CTEs e and nodes."""
    all_edges = "(select src, dst from e union all select id, id from nodes)" if loops else "e"
    grid = f"(select id, cast(k as bigint) as k from nodes, range({dim}) t(k))"
    if kind == "norm":
        body = f"select a.dst as id, x.k, sum(s.f * d.f * x.x) as x from {all_edges} a join ({inv(loops)}) s on s.id = a.src join ({inv(loops)}) d on d.id = a.dst join {x} x on x.id = a.src group by 1, 2"
    else:
        term = f"{weight} * x.x" if weight else "x.x"
        body = f"select a.dst as id, x.k, {kind}({term}) as x from {all_edges} a join {x} x on x.id = a.src group by 1, 2"
    return f"select g.id, g.k, coalesce(b.x, cast(0 as double)) as x from {grid} g left join ({body}) b on b.id = g.id and b.k = g.k"


def lin_sql(parts: list[tuple[str, str]], with_bias: bool, act: str) -> str:
    """CTE text of (id, k, x) from (CTE, weight SQL) pairs."""
    rows = " union all ".join(f"select x.id, m.j, x.x * m.w as y from {c} x join ({m}) m on m.k = x.k" for c, m in parts)
    z = "sum(y)" + (" + j / cast(8 as double)" if with_bias else "")
    z = {"none": z, "relu": f"greatest({z}, cast(0 as double))", "sigmoid": f"1 / (1 + exp(-({z})))"}[act]
    return f"select id, j as k, {z} as x from ({rows}) group by id, j"


def sql(ctes: dict[str, str], last: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in ctes.items()) + f" select id, k, {V.format('x')} as v from {last}"


def base(g: str) -> dict[str, str]:
    return {"nodes": NODES, "e": G(g), "x": X}


# --- the registry: name -> (query, SQL)

_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], text: str | None) -> None:
    _registry[name] = (query, text)


def _model(spark: SparkSession, sf: str, g: str, *layers, **options) -> DataFrame:
    got = graph(spark, sf, g)
    return long(SparkEngine(GNNModel(layers), **options).run(got, got.nodes))


def _one(g: str, layer_of: Callable[[], object], ctes: dict[str, str], last: str, **options):
    return (lambda s, d: _model(s, d, g, layer_of(), **options)), sql({**base(g), **ctes}, last)


for _g in ("g1", "g2"):
    for _name, _kind, _loops in (("sum", SUM, False), ("mean", MEAN, False), ("max", MAX, False), ("gcn_norm", NORM, False), ("gcn_norm_selfloop", NORM, True), ("sum_selfloop", SUM, True)):
        _text = {SUM: "sum", MEAN: "avg", MAX: "max", NORM: "norm"}[_kind]
        add(
            f"agg_{_name}" + ("_dense" if _g == "g1" else ""),
            lambda s, d, g=_g, kind=_kind, loops=_loops: long(aggregate(got := graph(s, d, g), got.nodes, kind, F_IN, loops), "m"),
            sql({**base(_g), "m": agg_sql(_text, "x", F_IN, _loops)}, "m"),
        )
add("agg_sum_vertex", lambda s, d: long(aggregate(g := graph(s, d, "g2"), g.nodes, SUM, F_IN, strategy="vertex"), "m"), sql({**base("g2"), "m": agg_sql("sum", "x", F_IN)}, "m"))


def _degree_features(g: Graph) -> DataFrame:
    return g.in_degrees().join(g.out_degrees().withColumnRenamed("degree", "out"), "id").select("id", F.array(F.col("degree").cast("double"), F.col("out").cast("double"), F.lit(1.0)).alias("h"))


_NATION = {"nodes": "select cast(n_nationkey as bigint) as id from nation", "e": G("g4"), "x": "select id, cast(0 as bigint) as k, cast(id as double) + 1 as x from nodes union all select id, 1, cast(1 as double) from nodes"}


def _nation(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = graph(s, d, "g4")
    return g, g.nodes.select("id", F.array(F.col("id").cast("double") + 1, F.lit(1.0)).alias("h"))


def _scaled_nation(s: SparkSession, d: str, kind: Aggregation) -> DataFrame:
    g, h = _nation(s, d)
    g = Graph(g.nodes, g.edges.withColumn("weight", F.col("weight") / 1048576))
    return long(aggregate(g, h, kind, 2, use_edge_weights=True), "m")


for _name, _kind, _text in (("sum", SUM, "sum"), ("mean", MEAN, "avg"), ("max", MAX, "max")):
    add(f"agg_weighted_{_name}", lambda s, d, kind=_kind: _scaled_nation(s, d, kind), sql({**_NATION, "m": agg_sql(_text, "x", 2, weight="(a.weight / 1048576)")}, "m"))



def _stats(spark: SparkSession, sf: str) -> DataFrame:
    parts = None
    for name in ("g1", "g2"):
        g = graph(spark, sf, name)
        degrees = g.in_degrees()
        row = degrees.agg(F.count("*").alias("num_nodes"), F.sum("degree").alias("num_edges"), F.max("degree").alias("max_in_degree"), F.sum((F.col("degree") == 0).cast("long")).alias("isolated"))
        loops = g.edges.where("src = dst").agg(F.count("*").alias("loops"))
        row = row.crossJoin(loops).select(F.lit(name).alias("graph"), "*")
        parts = row if parts is None else parts.unionByName(row)
    return parts


_registry["graph_stats"] = (
    _stats,
    " union all ".join(
        f"select '{g}' as graph, (select count(*) from embeddings) as num_nodes, (select count(*) from ({G(g)})) as num_edges, (select max(c) from (select count(*) as c from ({G(g)}) group by dst)) as max_in_degree, "
        f"(select count(*) from embeddings where vec_id not in (select dst from ({G(g)}))) as isolated, (select count(*) from ({G(g)}) where src = dst) as loops"
        for g in ("g1", "g2")
    ),
)
#: Queries of one graph, whichever it is.
ON_GRAPH: dict[str, Callable[[Graph], DataFrame]] = {
    "in_degree": lambda g: g.in_degrees(),
    "out_degree": lambda g: g.out_degrees(),
    "in_neighbors": lambda g: g.in_neighbours(),
    "out_neighbors": lambda g: g.out_neighbours(),
    "edge_source": lambda g: g.with_edge_ids().edges.select("edge_id", "src"),
    "csc_colptr": lambda g: g.col_ptr(),
    "link_scores": lambda g: T.link_scores(g.edges, g.nodes).select("src", "dst", rounded(F.col("score")).alias("v")),
    "isolated_nodes": lambda g: g.nodes.select("id").join(g.edges, F.col("dst") == F.col("id"), "left_anti"),
    "undirected_mirror": lambda g: Graph.undirected(g.edges, g.nodes).edges.select("src", "dst"),
}


def _on_sparse(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: ON_GRAPH[name](graph(s, d, "g2"))


for _side, _col in (("in", "dst"), ("out", "src")):
    add(f"{_side}_degree", _on_sparse(f"{_side}_degree"), f"with e as ({G('g2')}) select vec_id as id, cast(coalesce(n, 0) as bigint) as degree from embeddings left join (select {_col}, count(*) as n from e group by {_col}) on {_col} = vec_id")
add("in_neighbors", _on_sparse("in_neighbors"), f"with e as ({G('g2')}) select dst as id, row_number() over (order by dst, src) - 1 as edge_id, src as neighbour from e")
add("out_neighbors", _on_sparse("out_neighbors"), f"with e as ({G('g2')}) select src as id, row_number() over (order by dst, src) - 1 as edge_id, dst as neighbour from e")
add("in_weights", lambda s, d: graph(s, d, "g4").in_weights(), f"with e as ({G('g4')}) select dst as id, row_number() over (order by dst, src) - 1 as edge_id, weight from e")
add("edge_weights", lambda s, d: graph(s, d, "g3").weights(), f"with e as ({G('g3')}) select row_number() over (order by dst, src) - 1 as edge_id, weight from e")
add("edge_weight_default", lambda s, d: graph(s, d, "g2").weights(), f"with e as ({G('g2')}) select row_number() over (order by dst, src) - 1 as edge_id, cast(1 as double) as weight from e")
add("edge_source", _on_sparse("edge_source"), f"with e as ({G('g2')}) select row_number() over (order by dst, src) - 1 as edge_id, src from e")
for _loops in (False, True):
    add("inv_sqrt_degree" + "_selfloop" * _loops, lambda s, d, loops=_loops: graph(s, d, "g2").inv_sqrt_degrees(loops).select("id", rounded(F.col("inv_sqrt")).alias("v")), f"with nodes as ({NODES}), e as ({G('g2')}) select id, {V.format('f')} as v from ({inv(_loops)})")
add(
    "csc_colptr",
    _on_sparse("csc_colptr"),
    f"with e as ({G('g2')}), p as (select vec_id as v, (select count(*) from e where dst < vec_id) as c, vec_id - (select min(vec_id) from embeddings) as r from embeddings) select cast(r as bigint) as position, c as value from p union all select (select count(*) from embeddings), (select count(*) from e)",
)
add(
    "csc_round_trip",
    lambda s, d: _csc_round_trip(s, d),
    f"with e as ({G('g2')}) select row_number() over (order by dst, src) - 1 as edge_id, src, dst from e",
)


def _csc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Export to the two tables of CSC and read them back."""
    return Graph.from_csc_tables(*graph(spark, sf, "g2").to_csc_tables()).edges.select("edge_id", "src", "dst")


add(
    "undirected_mirror",
    _on_sparse("undirected_mirror"),
    f"with e as ({G('g2')}) select src, dst from e union all select dst, src from e where src <> dst",
)
add(
    "undirected_stats",
    lambda s, d: _undirected_stats(s, d),
    f"with e as ({G('g4')}), u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e) select count(*) as num_edges, cast(sum(case when a <> b then 2 else 1 end) as bigint) as num_directed_entries from u",
)


def _undirected_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf, "g4")
    pairs = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    u = Graph.undirected(pairs, g.nodes)
    return u.edges.agg(F.sum((F.col("src") <= F.col("dst")).cast("long")).alias("num_edges"), F.count("*").alias("num_directed_entries"))


add("linear_transform", lambda s, d: long(T.linear(features(s, d), [("h", matrix(F_IN, HIDDEN, 0))])), sql({"x": X, "z": lin_sql([("x", W(F_IN, HIDDEN, 0))], False, "none")}, "z"))
add("bias_add", lambda s, d: long(T.add_bias(features(s, d), bias(F_IN))), f"with x as ({X}) select id, k, {V.format('x + k / cast(8 as double)')} as v from x")
add("relu", lambda s, d: long(T.apply_activation(features(s, d), RELU)), f"with x as ({X}) select id, k, {V.format('greatest(x, cast(0 as double))')} as v from x")
add("sigmoid", lambda s, d: long(T.apply_activation(features(s, d), SIGMOID)), f"with x as ({X}) select id, k, {V.format('1 / (1 + exp(-x))')} as v from x")
add("softmax", lambda s, d: long(features(s, d).withColumn("h", softmax(F.col("h")))), f"with x as ({X}) select id, k, {V.format('exp(x - max(x) over (partition by id)) / sum(exp(x)) over (partition by id) * exp(max(x) over (partition by id))')} as v from x")
add("linear_head", lambda s, d: long(T.linear_head(features(s, d), matrix(F_IN, CLASSES, 5), bias(CLASSES))), sql({"x": X, "z": lin_sql([("x", W(F_IN, CLASSES, 5))], True, "none")}, "z"))
add(
    "mlp",
    lambda s, d: long(T.mlp(features(s, d), [(matrix(F_IN, HIDDEN, 0), bias(HIDDEN), RELU), (matrix(HIDDEN, CLASSES, 5), bias(CLASSES), Activation.NONE)])),
    sql({"x": X, "a": lin_sql([("x", W(F_IN, HIDDEN, 0))], True, "relu"), "z": lin_sql([("a", W(HIDDEN, CLASSES, 5))], True, "none")}, "z"),
)
add("concat_features", lambda s, d: long(T.concat((g := graph(s, d, "g2")).nodes, aggregate(g, g.nodes, MEAN, F_IN))), sql({**base("g2"), "m": agg_sql("avg", "x", F_IN), "c": "select * from x union all select id, k + 64, x from m"}, "c"))

# layers
add("gcn_layer", *_one("g2", lambda: GCNLayer(matrix(F_IN, HIDDEN, 0), bias(HIDDEN), RELU), {"m": agg_sql("norm", "x", F_IN, True), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], True, "relu")}, "z"))
add("gcn_layer_no_loops", *_one("g2", lambda: GCNLayer(matrix(F_IN, HIDDEN, 0), (), SIGMOID, self_loops=False), {"m": agg_sql("norm", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], False, "sigmoid")}, "z"))
for _name, _kind, _text in (("mean", MEAN, "avg"), ("sum", SUM, "sum"), ("max", MAX, "max"), ("gcn_norm", NORM, "norm")):
    add(
        f"sage_{_name}_layer",
        *_one("g2", lambda kind=_kind: GraphSAGELayer(matrix(F_IN, HIDDEN, 0), matrix(F_IN, HIDDEN, 5), bias(HIDDEN), kind, RELU), {"m": agg_sql(_text, "x", F_IN, _kind is NORM), "z": lin_sql([("m", W(F_IN, HIDDEN, 0)), ("x", W(F_IN, HIDDEN, 5))], True, "relu")}, "z"),
    )
add("sage_no_self", *_one("g2", lambda: GraphSAGELayer(matrix(F_IN, HIDDEN, 0)), {"m": agg_sql("avg", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], False, "none")}, "z"))
_CONCAT = f"select k, j, w from ({W(F_IN, HIDDEN, 5)}) union all select k + 64, j, w from ({W(F_IN, HIDDEN, 0)})"
add(
    "sage_concat",
    *_one("g2", lambda: GraphSAGELayer.from_concat(DenseMatrix.from_rows([*matrix(F_IN, HIDDEN, 5).values.tolist(), *matrix(F_IN, HIDDEN, 0).values.tolist()])), {"m": agg_sql("avg", "x", F_IN), "c": "select * from x union all select id, k + 64, x from m", "z": lin_sql([("c", _CONCAT)], False, "none")}, "z"),
)
for _order in ("transform_first", "aggregate_first"):
    add(f"sage_sum_{_order}", *_one("g2", lambda: GraphSAGELayer(matrix(F_IN, HIDDEN, 0), None, bias(HIDDEN), SUM), {"m": agg_sql("sum", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], True, "none")}, "z", order=_order))
add("sage_mean_vertex", *_one("g2", lambda: GraphSAGELayer(matrix(F_IN, HIDDEN, 0)), {"m": agg_sql("avg", "x", F_IN), "z": lin_sql([("m", W(F_IN, HIDDEN, 0))], False, "none")}, "z", strategy="vertex"))

# models


def gcn_layers() -> tuple:
    return GCNLayer(matrix(F_IN, HIDDEN, 0), bias(HIDDEN), RELU), GCNLayer(matrix(HIDDEN, CLASSES, 5), bias(CLASSES))


def sage_layers() -> tuple:
    return GraphSAGELayer(matrix(F_IN, HIDDEN, 0), matrix(F_IN, HIDDEN, 5), bias(HIDDEN), MEAN, RELU), GraphSAGELayer(matrix(HIDDEN, CLASSES, 0), matrix(HIDDEN, CLASSES, 5), bias(CLASSES))


_GCN2 = {
    **base("g2"),
    "m": agg_sql("norm", "x", F_IN, True),
    "h1": lin_sql([("m", W(F_IN, HIDDEN, 0))], True, "relu"),
    "m2": agg_sql("norm", "h1", HIDDEN, True),
    "z": lin_sql([("m2", W(HIDDEN, CLASSES, 5))], True, "none"),
}
add("gcn_2layer", lambda s, d: _model(s, d, "g2", *gcn_layers()), sql(_GCN2, "z"))
add("gcn_2layer_dense", lambda s, d: _model(s, d, "g1", *gcn_layers()), sql({**_GCN2, "e": G("g1")}, "z"))
_SAGE2 = {
    **base("g2"),
    "m": agg_sql("avg", "x", F_IN),
    "h1": lin_sql([("m", W(F_IN, HIDDEN, 0)), ("x", W(F_IN, HIDDEN, 5))], True, "relu"),
    "m2": agg_sql("avg", "h1", HIDDEN),
    "z": lin_sql([("m2", W(HIDDEN, CLASSES, 0)), ("h1", W(HIDDEN, CLASSES, 5))], True, "none"),
}
add("sage_2layer", lambda s, d: _model(s, d, "g2", *sage_layers()), sql(_SAGE2, "z"))
add(
    "mixed_gcn_sage",
    lambda s, d: _model(s, d, "g2", gcn_layers()[0], GraphSAGELayer(matrix(HIDDEN, CLASSES, 0), None, (), MAX)),
    sql({**{k: _GCN2[k] for k in ("nodes", "e", "x", "m", "h1")}, "m2": agg_sql("max", "h1", HIDDEN), "z": lin_sql([("m2", W(HIDDEN, CLASSES, 0))], False, "none")}, "z"),
)


def egat(heads: int, out: int = 4) -> EGATLayer:
    return EGATLayer(matrix(F_IN, out, 0), matrix(3, out, 3), matrix(3 * out // heads, heads, 7), heads)


def egat_sql(heads: int, out: int = 4, g: str = "g2e") -> str:
    d = out // heads
    ctes = {
        "nodes": NODES,
        "e": G(g),
        "x": X,
        "g": lin_sql([("x", W(F_IN, out, 0))], False, "none"),
        "ef": "select e, cast(0 as bigint) as k, f0 as x from e union all select e, 1, f1 from e union all select e, 2, f2 from e",
        "f": f"select ef.e, m.j as k, sum(ef.x * m.w) as x from ef join ({W(3, out, 3)}) m on m.k = ef.k group by 1, 2",
        "a": W(3 * d, heads, 7),
        "c": "select e.e, e.dst, gd.k, gd.x as xd, gs.x as xs, f.x as xf from e join g gd on gd.id = e.dst join g gs on gs.id = e.src and gs.k = gd.k join f on f.e = e.e and f.k = gd.k",
        "r": f"select c.e, c.dst, c.k // {d} as t, sum(c.xd * a0.w + c.xs * a1.w + c.xf * a2.w) as s from c join a a0 on a0.j = c.k // {d} and a0.k = c.k % {d} join a a1 on a1.j = a0.j and a1.k = a0.k + {d} join a a2 on a2.j = a0.j and a2.k = a0.k + {2 * d} group by 1, 2, 3",
        "l": "select e, dst, t, case when s >= 0 then s else cast(0.2 as double) * s end as s from r",
        "p": "select e, dst, t, exp(s - max(s) over (partition by dst, t)) as u from l",
        "q": "select e, dst, t, u / sum(u) over (partition by dst, t) as alpha from p",
        "o": f"select c.dst as id, c.k, sum(q.alpha * c.xs) as x from c join q on q.e = c.e and q.t = c.k // {d} group by 1, 2",
        "z": f"select n.id, n.k, coalesce(o.x, cast(0 as double)) as x from (select id, cast(k as bigint) as k from nodes, range({out}) t(k)) n left join o on o.id = n.id and o.k = n.k",
    }
    return sql(ctes, "z")


for _heads in (1, 2):
    add(f"egat_{_heads}head", lambda s, d, heads=_heads: _model(s, d, "g2e", egat(heads)), egat_sql(_heads))


def _logits(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d, "g2")
    return SparkEngine(GNNModel(gcn_layers())).run(g, g.nodes)


def _grid(df: DataFrame) -> DataFrame:
    """Logits on a grid of 1e-6, so that both sides break ties alike."""
    return df.withColumn("h", F.transform("h", lambda x: F.round(x, 6)))


_ROUNDED = {**_GCN2, "y": "select id, k, round(x, 6) as x from z", "p": "select id, min(k) as pred from (select id, k, x, max(x) over (partition by id) as top from y) where x = top group by id"}
_WITH = "with " + ", ".join(f"{k} as ({v})" for k, v in _ROUNDED.items())
add("argmax_predict", lambda s, d: _grid(_logits(s, d)).select("id", argmax(F.col("h")).alias("pred")), f"{_WITH} select id, pred from p")
_SPLIT = "CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END"
add("accuracy", lambda s, d: _accuracy(s, d), f"{_WITH} select count(*) as n, round(avg(case when pred = label then cast(1 as double) else cast(0 as double) end), 6) as accuracy from p join embeddings on vec_id = id where {_SPLIT} = 'test'")


def _accuracy(s: SparkSession, d: str) -> DataFrame:
    truth = features(s, d).select("id", "label", F.expr(_SPLIT).alias("split"))
    return T.accuracy(T.predictions(_grid(_logits(s, d))), truth, "test").withColumn("accuracy", F.round("accuracy", 6))


add("logit_softmax", lambda s, d: long(T.probabilities(_logits(s, d))), sql({**_GCN2, "u": "select id, k, exp(x - max(x) over (partition by id)) as x from z", "s": "select id, k, x / sum(x) over (partition by id) as x from u"}, "s"))
add("link_scores", _on_sparse("link_scores"), f"with e as ({G('g2')}), x as ({X}) select src, dst, {V.format('sum(a.x * b.x)')} as v from e join x a on a.id = src join x b on b.id = dst and b.k = a.k group by src, dst")
add("isolated_nodes", _on_sparse("isolated_nodes"), f"select vec_id as id from embeddings where vec_id not in (select dst from ({G('g2')}))")
add(
    "gather",
    lambda s, d: gather(g := graph(s, d, "g2"), g.nodes).select("src", "dst", F.posexplode("h").alias("k", "v")).select("src", "dst", F.col("k").cast("long").alias("k"), rounded(F.col("v")).alias("v")),
    f"with e as ({G('g2')}), x as ({X}) select src, dst, k, {V.format('x')} as v from e join x on id = src",
)
add("self_loop_edges", lambda s, d: with_self_loops(graph(s, d, "g2")), f"with e as ({G('g2')}) select src, dst from e union all select vec_id, vec_id from embeddings")
add(
    "dense_adjacency",
    lambda s, d: graph(s, d, "g4").dense_adjacency(),
    f"with e as ({G('g4')}), n as (select cast(n_nationkey as bigint) as id from nation) select a.id as src, b.id as dst, (select count(*) from e where e.src = a.id and e.dst = b.id) as n from n a, n b",
)
add(
    "csr_offsets",
    lambda s, d: Graph((g := graph(s, d, "g2")).nodes, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).col_ptr(),
    f"with e as ({G('g2')}), p as (select vec_id as v, (select count(*) from e where src < vec_id) as c, vec_id - (select min(vec_id) from embeddings) as r from embeddings) select cast(r as bigint) as position, c as value from p union all select (select count(*) from embeddings), (select count(*) from e)",
)
add("verify_orders", lambda s, d: _verify_orders(s, d), "select true as same, (select count(*) from embeddings) as n, cast(0 as bigint) as missing, cast(0 as bigint) as wrong")


def _verify_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The verifier's row for one layer run transform-first and aggregate-first."""
    g, model = graph(spark, sf, "g2"), GNNModel(gcn_layers()[:1])
    got = verify(*(SparkEngine(model, order=o).run(g, g.nodes) for o in ("transform_first", "aggregate_first")))
    return spark.createDataFrame([(got.same, got.rows, got.missing, got.wrong)], "same boolean, n long, missing long, wrong long")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "g2", *gcn_layers())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for k, (_, t) in _registry.items() if t}
