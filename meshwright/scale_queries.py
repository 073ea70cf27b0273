"""Queries of what makes large graphs cheaper: seeds, partitions, layouts, hubs, batches, compression, costs. Each has SQL.

The graph g5 is that of all orders and parts, with an edge in either direction for
each part of an order: orders have even ids, parts odd ones. Nodes have three features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.catalog import MEAN, NODES, NORM, RELU, SUM, W, G, _GCN2, agg_sql, base, bias, egat, egat_sql, features, gcn_layers, graph, lin_sql, long, matrix, sql
from meshwright.functions.storage import cut, scratch, written
from meshwright.graph import Graph
from meshwright.layers import GCNLayer, GNNModel, GraphSAGELayer
from meshwright.operators import batches, frontier, packed, partition
from meshwright.operators.aggregate import BROADCAST_BYTES, HUBS, aggregate
from meshwright.plans import cost, stages
from meshwright.plans.engine import SparkEngine
from meshwright.sources import clustered, layout

_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, text: str):
    """Register the function below as a query with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _registry[name] = (f, text)
        return f

    return add


# --- g5

WIDTH, MIDDLE, LAST = 3, 8, 4
#: Line items of which a task finds the distinct pairs.
ITEMS = 1 << 18


def orders_and_parts(s: SparkSession, d: str) -> Graph:
    """Its pairs are found once, a bounded number to a task, and read from files by all passes over the edges."""
    table = lambda name: s.read.parquet(f"{d}/{name}.parquet")
    items = table("lineitem")
    pairs = items.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    pairs = written(pairs.repartition(-(-items.count() // ITEMS) or 1, "src").distinct().sortWithinPartitions("src", "dst"), "pairs")
    orders = table("orders").select((F.col("o_orderkey") * 2).alias("id"), F.array(F.col("o_totalprice") / 262144, F.lit(1.0), F.lit(0.0)).alias("h"))
    parts = table("part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.array(F.col("p_retailprice") / 1024, F.lit(0.0), F.lit(1.0)).alias("h"))
    return Graph.undirected(pairs, orders.unionByName(parts))


def customer_orders(s: SparkSession, d: str) -> DataFrame:
    """The seeds: all orders of a customer."""
    return s.read.parquet(f"{d}/orders.parquet").where("o_custkey = 7").select((F.col("o_orderkey") * 2).alias("id"))


_PAIRS5 = "select distinct l_orderkey * 2 as a, l_partkey * 2 + 1 as b from lineitem"
_E5 = f"select a as src, b as dst from ({_PAIRS5}) union all select b, a from ({_PAIRS5})"
_NODES5 = "select o_orderkey * 2 as id from orders union all select p_partkey * 2 + 1 from part"
_X5 = " union all ".join(f"select {i} as id, cast({k} as bigint) as k, cast({x} as double) as x from {t}" for i, t, xs in (("o_orderkey * 2", "orders", ("o_totalprice / 262144", 1, 0)), ("p_partkey * 2 + 1", "part", ("p_retailprice / 1024", 0, 1))) for k, x in enumerate(xs))
_BASE5 = {"nodes": _NODES5, "e": _E5, "x": _X5}
_SEEDS5 = "(select o_orderkey * 2 from orders where o_custkey = 7)"


def of_seeds(text: str, seeds: str) -> str:
    return f"select * from ({text}) where id in {seeds}"


def sage5() -> GNNModel:
    return GNNModel((GraphSAGELayer(matrix(WIDTH, MIDDLE, 0), matrix(WIDTH, MIDDLE, 5), bias(MIDDLE), MEAN, RELU), GraphSAGELayer(matrix(MIDDLE, LAST, 0), matrix(MIDDLE, LAST, 5), bias(LAST), MEAN)))


def gcn5() -> GNNModel:
    return GNNModel((GCNLayer(matrix(WIDTH, MIDDLE, 0), bias(MIDDLE), RELU), GCNLayer(matrix(MIDDLE, LAST, 5), bias(LAST))))


SAGE5 = {
    **_BASE5,
    "m": agg_sql("avg", "x", WIDTH),
    "h1": lin_sql([("m", W(WIDTH, MIDDLE, 0)), ("x", W(WIDTH, MIDDLE, 5))], True, "relu"),
    "m2": agg_sql("avg", "h1", MIDDLE),
    "z": lin_sql([("m2", W(MIDDLE, LAST, 0)), ("h1", W(MIDDLE, LAST, 5))], True, "none"),
}
GCN5 = {**_BASE5, "m": agg_sql("norm", "x", WIDTH, True), "h1": lin_sql([("m", W(WIDTH, MIDDLE, 0))], True, "relu"), "m2": agg_sql("norm", "h1", MIDDLE, True), "z": lin_sql([("m2", W(MIDDLE, LAST, 5))], True, "none")}

# --- batches of seeds


@query(
    "minibatch_frontier",
    f"with recursive e as ({_E5}), f as (select 0 as hop, id from ({_NODES5}) where id in {_SEEDS5} union select hop + 1, src from f join e on dst = id where hop < 2) select cast(min(hop) as int) as hop, id from f group by id",
)
def minibatch_frontier(s: SparkSession, d: str) -> DataFrame:
    """The nodes that two layers need for a customer's orders."""
    return frontier.hops(orders_and_parts(s, d), customer_orders(s, d), 2)


def _seeded(model: Callable[[], GNNModel]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        g = orders_and_parts(s, d)
        return long(SparkEngine(model()).run(g, g.nodes, seeds=customer_orders(s, d)))

    return run


query("minibatch_sage", of_seeds(sql(SAGE5, "z"), _SEEDS5))(_seeded(sage5))
query("minibatch_gcn", of_seeds(sql(GCN5, "z"), _SEEDS5))(_seeded(gcn5))


@query("minibatch_egat", of_seeds(egat_sql(2, g="g1e"), "(select vec_id from embeddings where label = 3)"))
def minibatch_egat(s: SparkSession, d: str) -> DataFrame:
    """Attention for the nodes of one class, over all line items."""
    g = graph(s, d, "g1e")
    return long(SparkEngine(GNNModel((egat(2),))).run(g, g.nodes, seeds=g.nodes.where("label = 3")))


# --- partitions

PARTS, ROUNDS, SLACK = 8, 4, 5


def partition_sql(nodes: str, edges: str) -> dict[str, str]:
    """CTEs w (id, work), n (id, other), c (capacity) and l0, l1, ... (id, work, part): the labels after each round."""
    rank = f"row_number() over (order by work desc, {partition.mixed('id', 0)}, id) - 1"
    ctes = {
        "nodes": nodes,
        "e": edges,
        "w": "select id, 1 + (select count(*) from e where dst = id) as work from nodes",
        "n": "select src as id, dst as other from e where src <> dst union all select dst, src from e where src <> dst",
        "c": f"select cast(sum(work) as bigint) * {100 + SLACK} // {100 * PARTS} as capacity from w",
        "l0": f"select id, work, least(r % {2 * PARTS}, {2 * PARTS - 1} - r % {2 * PARTS}) as part from (select id, work, {rank} as r from w)",
    }
    for i in range(1, ROUNDS + 1):
        at = f"l{i - 1}"
        ctes |= {
            f"v{i}": f"select id, part, count(*) as n from (select n.id, l.part from n join {at} l on l.id = n.other) group by 1, 2",
            f"b{i}": f"select id, max(n) as n, min(part) filter (where n = top) as too from (select *, max(n) over (partition by id) as top from (select id, part, sum(n) as n from (select id, part, n from v{i} union all select id, part, 0 from {at}) group by 1, 2)) group by id",
            f"k{i}": f"select l.id, l.work, l.part, b.too, b.n - coalesce(v.n, 0) as gain, {partition.mixed('l.id', i)} as mix from {at} l join b{i} b on b.id = l.id left join v{i} v on v.id = l.id and v.part = l.part",
            f"a{i}": f"select *, gain > 0 and mix % 2 = 0 as asks, {partition.level('cast(gain as bigint)')} as level, mix // 2 % {partition.CLASSES} as class from k{i}",
            f"s{i}": f"select too, level, class, sum(sum(work)) over (partition by too order by level desc, class rows unbounded preceding) as so_far from a{i} where asks group by 1, 2, 3",
            f"y{i}": f"select s.too, s.level, s.class from s{i} s, c left join (select part, sum(work) as work from {at} group by part) p on p.part = s.too where so_far <= capacity - coalesce(p.work, 0)",
            f"l{i}": f"select a.id, a.work, case when asks and y.too is not null then a.too else a.part end as part from a{i} a left join y{i} y on y.too = a.too and y.level = a.level and y.class = a.class",
        }
    return ctes


_PARTITION = partition_sql(_NODES5, _E5)
_WITH = "with " + ", ".join(f"{k} as ({v})" for k, v in _PARTITION.items())
_HASHED = f"select id, {partition.mixed('id', 0)} % {PARTS} as part from nodes"


@query("partition_nodes", f"{_WITH} select id, cast(part as int) as part from l{ROUNDS}")
def partition_nodes(s: SparkSession, d: str) -> DataFrame:
    return partition.partition(orders_and_parts(s, d), PARTS, ROUNDS, SLACK)


def _quality_sql(name: str, placed: str) -> str:
    size = f"select p.part, count(*) as nodes, sum(work) as work from ({placed}) p join w on w.id = p.id group by 1"
    crossing = f"select b.part, sum(case when a.part <> b.part then 1 else 0 end) as cut from e join ({placed}) a on a.id = src join ({placed}) b on b.id = dst group by 1"
    return f"select '{name}' as method, cast(s.part as int) as part, s.nodes, cast(s.work as bigint) as work, cast(coalesce(c.cut, 0) as bigint) as cut from ({size}) s left join ({crossing}) c on c.part = s.part"


@query("partition_quality", f"{_WITH} {_quality_sql('propagation', f'select id, part from l{ROUNDS}')} union all {_quality_sql('hash', _HASHED)}")
def partition_quality(s: SparkSession, d: str) -> DataFrame:
    """Work and cut edges of each part, of label propagation and of hashing."""
    g = orders_and_parts(s, d)
    found = {"propagation": cut(partition.partition(g, PARTS, ROUNDS, SLACK)), "hash": partition.hashed(g, PARTS)}
    rows = [partition.quality(g, placed).select(F.lit(name).alias("method"), "*") for name, placed in found.items()]
    return rows[0].unionByName(rows[1])


# --- layouts and hubs

_DEEP5 = {
    **SAGE5,
    "m3": agg_sql("sum", "h2", LAST),
    "h2": f"select id, k, greatest(x, cast(0 as double)) as x from ({lin_sql([('m2', W(MIDDLE, LAST, 0)), ('h1', W(MIDDLE, LAST, 5))], True, 'none')})",
    "y": lin_sql([("m3", W(LAST, LAST, 0))], False, "none"),
}
_DEEP5 = {k: _DEEP5[k] for k in ("nodes", "e", "x", "m", "h1", "m2", "h2", "m3", "y")}


def deep5() -> GNNModel:
    first, second = sage5().layers
    return GNNModel((first, GraphSAGELayer(second.w_neigh, second.w_self, second.bias, MEAN, RELU), GraphSAGELayer(matrix(LAST, LAST, 0), None, (), SUM)))


@query("colocated_sage", sql(_DEEP5, "y"))
def colocated_sage(s: SparkSession, d: str) -> DataFrame:
    """Three layers over edges that stay in their buckets."""
    g = layout.colocated(orders_and_parts(s, d))
    return long(SparkEngine(deep5(), strategy="colocated").run(g, g.nodes))


@query("colocated_gcn", sql(GCN5, "z"))
def colocated_gcn(s: SparkSession, d: str) -> DataFrame:
    g = layout.colocated(orders_and_parts(s, d))
    return long(SparkEngine(gcn5(), strategy="colocated").run(g, g.nodes))


#: All line items, those that are first in their order from one source.
_HUB = G("g1").replace("select distinct l_orderkey %", "select case when l_linenumber = 1 then 0 else l_orderkey %", 1).replace(" as src", " end as src", 1)


def hub_graph(s: SparkSession, d: str) -> Graph:
    nodes = features(s, d)
    n = nodes.count()
    items = s.read.parquet(f"{d}/lineitem.parquet")
    return Graph.from_edges(items.select(F.when(F.col("l_linenumber") == 1, F.lit(0).cast("long")).otherwise(F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst")), nodes)


@query("agg_hub_source", sql({**base("g1"), "e": _HUB, "m": agg_sql("avg", "x", 64)}, "m"))
def agg_hub_source(s: SparkSession, d: str) -> DataFrame:
    g = hub_graph(s, d)
    return long(aggregate(g, g.nodes, MEAN, 64, strategy="split"), "m")


@query("gcn_hub_source", sql({**_GCN2, "e": _HUB}, "z"))
def gcn_hub_source(s: SparkSession, d: str) -> DataFrame:
    g = hub_graph(s, d)
    return long(SparkEngine(GNNModel(gcn_layers()), strategy="split").run(g, g.nodes))


# --- batches of destinations, point reads

_BUDGET = 1 << 20
_EACH5 = 8 * WIDTH + batches.MESSAGE
_RANGES5 = f"with nodes as ({_NODES5}), e as ({_E5}), d as (select id, count(dst) as degree from nodes left join e on dst = id group by id), b as (select id, degree, coalesce(sum(degree * {_EACH5}) over (order by id rows between unbounded preceding and 1 preceding), 0) as before from d)"


@query(
    "batch_ranges",
    f"{_RANGES5} select min(id) as first, max(id) as last, count(*) as nodes, cast(sum(degree) as bigint) as messages, cast(sum(degree) * {_EACH5} as bigint) as message_bytes from b group by before // {_BUDGET // 2}, degree * {_EACH5} > {_BUDGET - _BUDGET // 2}",
)
def batch_ranges(s: SparkSession, d: str) -> DataFrame:
    """Ranges of orders and parts whose messages take a megabyte at most."""
    return batches.ranges(orders_and_parts(s, d), WIDTH, _BUDGET)


def _batched(kind, loops: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        g = orders_and_parts(s, d)
        whole = g.nodes.select("id", F.expr("transform(h, x -> floor(x * 262144) / 262144D)").alias("h"))
        g = Graph(cut(whole), cut(g.edges), g.directed)
        budget = max(1, g.edges.count() * _EACH5 // 2)  # some four ranges, at every size
        return long(batches.aggregate_in_batches(g, g.nodes, kind, WIDTH, budget, scratch(s, "ranges"), self_loops=loops), "m")

    return run


# Features of few binary digits, so that sums are exact in any order.
_WHOLE5 = {**_BASE5, "x": f"select id, k, floor(x * 262144) / cast(262144 as double) as x from ({_X5})"}
query("batched_mean", sql({**_WHOLE5, "m": agg_sql("avg", "x", WIDTH)}, "m"))(_batched(MEAN, False))
query("batched_gcn_norm", sql({**_WHOLE5, "m": agg_sql("norm", "x", WIDTH, True)}, "m"))(_batched(NORM, True))


@query("clustered_in_edges", f"select row_number() over (order by dst, src) - 1 as edge_id, src, dst from ({G('g1')})")
def clustered_in_edges(s: SparkSession, d: str) -> DataFrame:
    """All edges, numbered, from files by destination."""
    folder = scratch(s, "clustered")
    clustered.write(graph(s, d, "g1"), folder)
    return clustered.Clustered.open(s, folder).graph.edges.select("edge_id", "src", "dst")


# --- compression by columns

_Q64 = f"select id, k, floor(x / s + 0.5) * s as x from (select *, case when t > 0 then t / {packed.LEVELS} else cast(1 as double) end as s from (select *, max(abs(x)) over (partition by k) as t from (select id, k, x from x)))"


def _columns(name: str, kind, loops: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        g = graph(s, d, name)
        return long(aggregate(g, g.nodes, kind, 64, self_loops=loops, compress="columns"), "m")

    return run


query("agg_sum_columns", sql({**base("g1"), "y": _Q64, "m": agg_sql("sum", "y", 64)}, "m"))(_columns("g1", SUM))
query("agg_mean_columns", sql({**base("g1"), "y": _Q64, "m": agg_sql("avg", "y", 64)}, "m"))(_columns("g1", MEAN))


@query("columns_error", f"with x as (select vec_id as id, cast(unnest(range(64)) as bigint) as k, cast(unnest(embedding) as double) as x from embeddings), y as ({_Q64}) select x.k, round(max(abs(x.x - y.x)), 9) + cast(0 as double) as error, round(max(abs(x.x)) / {2 * packed.LEVELS}, 9) + cast(0 as double) as bound from x join y on x.id = y.id and x.k = y.k group by x.k")
def columns_error(s: SparkSession, d: str) -> DataFrame:
    """The greatest error of each compressed column, and its bound."""
    x = features(s, d)
    of = packed.scales(x, 64)
    sums = packed.pack(x, of, 21)
    back = packed.unpack([F.col("p")[j] for j in range(22)], of, 21)
    both = x.join(sums, "id").select(F.posexplode(F.arrays_zip("h", F.array(*back).alias("b"))).alias("k", "z"))
    found = both.groupBy(F.col("k").cast("long").alias("k")).agg(F.max(F.abs(F.col("z.h") - F.col("z.b"))).alias("error"), (F.max(F.abs("z.h")) / (2 * packed.LEVELS)).alias("bound"))
    return found.select("k", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("error", "bound")))


# --- costs

_TASKS, _MACHINES = 200, 25


def _cost_sql(name: str, nodes: str, edges: str, width: int) -> str:
    row, t = cost.row_bytes(width), _TASKS
    counts = f"(select count(*) as n from ({nodes})) n, (select sum(d) as e, max(d) as i from (select count(*) as d from ({edges}) group by dst)) i, (select max(d) as o, count(*) filter (where d * {HUBS} > all_edges) as h from (select count(*) as d, sum(count(*)) over () as all_edges from ({edges}) group by src)) o"
    sums = f"least(e, n * {t}) * {row}"
    formulas = {
        "edge": f"n * {row} + e * {cost.EDGE} + greatest(e, o * {t}) * {row} + {sums}",
        "vertex": f"e * {cost.EDGE} + n * {row * _MACHINES} + greatest(e, i * {t}) * {row}",
        "split": f"n * {row} + 2 * e * {cost.EDGE} + h * {t * row} + e * {row} + {sums}",
    }
    rows = " union all ".join(f"select {r} as r, '{k}' as strategy, cast({f} as bigint) as cost from {counts}" + (f" where n * {width * 8} <= {BROADCAST_BYTES}" if k == "vertex" else "") for r, (k, f) in enumerate(formulas.items()))
    return f"select '{name}' as graph, cast({width} as bigint) as width, strategy, cost, row_number() over (order by cost, r) = 1 as chosen from ({rows})"


_NATIONS = "select n_nationkey as id from nation"
_COSTED = [("g1", NODES, G("g1"), 64), ("g1", NODES, G("g1"), 16), ("g2", NODES, G("g2"), 64), ("g4", _NATIONS, G("g4"), 64), ("g5", _NODES5, _E5, WIDTH), ("hub", NODES, _HUB, 64)]


@query("strategy_costs", " union all ".join(f"({_cost_sql(*x)})" for x in _COSTED))
def strategy_costs(s: SparkSession, d: str) -> DataFrame:
    """What each strategy would cost on a cluster of 25 machines, and which is chosen."""
    made = {"g5": orders_and_parts, "hub": hub_graph}
    known = {name: cost.Statistics.of(made[name](s, d) if name in made else graph(s, d, name)) for name in dict.fromkeys(x[0] for x in _COSTED)}
    rows = []
    for name, _, _, width in _COSTED:
        best = cost.choose(known[name], width, _TASKS, _MACHINES)
        rows += [(name, width, k, v, k == best) for k, v in cost.costs(known[name], width, _TASKS, _MACHINES).items()]
    return s.createDataFrame(rows, "graph string, width long, strategy string, cost long, chosen boolean")


@query("sage_auto", sql(SAGE5, "z"))
def sage_auto(s: SparkSession, d: str) -> DataFrame:
    g = orders_and_parts(s, d)
    return long(SparkEngine(sage5(), statistics=cost.Statistics.of(g)).run(g, g.nodes))


# --- layer by layer


@query("staged_sage", sql(SAGE5, "z"))
def staged_sage(s: SparkSession, d: str) -> DataFrame:
    """Two layers, the first one's rows written and deleted when the second one's are there."""
    g = orders_and_parts(s, d)
    return long(stages.run_in_stages(SparkEngine(sage5()), g, g.nodes).result)


_WIDTHS, _DEPTHS = (4, 16), (1, 2)


@query(
    "layer_sweep",
    " union all ".join(f"select '{name}' as graph, w as width, d as depth, l as layer, (select count(*) from ({nodes})) as nodes, (select count(*) from ({edges})) as edges, true as measured from (values (4::bigint), (16::bigint)) a(w), (values (1::bigint), (2::bigint)) b(d), range(2) c(l) where l < d" for name, nodes, edges in (("g1", NODES, G("g1")), ("g5", _NODES5, _E5))),
)
def layer_sweep(s: SparkSession, d: str) -> DataFrame:
    """A row for each layer of models of two widths and depths over two graphs; what was measured is reduced to whether it makes sense."""
    graphs = {"g1": graph(s, d, "g1"), "g5": orders_and_parts(s, d)}
    # Laid out once, so that no layer deals edges again.
    found = stages.sweep_models(
        scratch(s, "sweep"),
        {k: layout.colocated(Graph.from_edges(g.edges.select("src", "dst"), g.nodes.select("id"))) for k, g in graphs.items()},
        {"sage": lambda a, b: GraphSAGELayer(matrix(a, b, 0), None, bias(b), MEAN, RELU)},
        _WIDTHS,
        _DEPTHS,
        {"colocated": SparkEngine(strategy="colocated")},
    )
    sane = (F.col("tasks") > 0) & (F.col("failed_tasks") == 0) & (F.col("task_seconds") > 0) & (F.col("peak_task_mb") > 0) & (F.col("skew") >= 1) & (F.col("nodes_per_s") > 0) & (F.col("edges_per_s") > 0)
    return found.select("graph", "width", "depth", "layer", "nodes", "edges", sane.alias("measured"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for k, (_, t) in _registry.items()}
