"""Synthetic graphs. Every random choice is a hash of what it decides about, so a graph is the same on any cluster.

The hash is made of products and remainders of whole numbers below 2**62, so any
SQL engine can say it, and so can each graph: the `_sql` functions are DuckDB's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the hash: a prime modulus and multipliers below it.
P = 2147483647
A, B, C = 48271, 16807, 69621


def _round(v: str, x: str) -> str:
    """SQL of one step: a quadratic map of v, with the number x."""
    return f"((({v}) * ({v}) % {P} * {A} + ({v}) * {B} + ({x}) % {P} * {C} + 12345) % {P})"


def _hash(*parts: str) -> str:
    """SQL (Spark) of a number in [0, P) from whole numbers not below 0."""
    numbers = ", ".join(f"CAST({x} AS bigint)" for x in (*parts, "1", "2", "3"))
    return f"aggregate(array({numbers}), 42L, (v, x) -> {_round('v', 'x')})"


def hashed(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """`df` with a column in [0, P): the hash of some expressions."""
    return df.withColumn(name, F.expr(_hash(*parts)))


def hashed_sql(source: str, name: str, *parts: str) -> str:
    """The same as SQL (DuckDB) over a query, step by step."""
    steps = [*parts, "1", "2", "3"]
    for i, x in enumerate(steps):
        source = f"select *, {_round(f'h{i}' if i else '42', x)} as h{i + 1} from ({source})"
    return f"select * exclude ({', '.join(f'h{i + 1}' for i in range(len(steps)))}), h{len(steps)} as {name} from ({source})"


def _share(p: float) -> int:
    return round(p * P)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0, most_pairs: int = 10**9) -> DataFrame:
    """src, dst: each ordered pair of different nodes with probability p. Looks at n**2 pairs, so n is checked; `random_edges` is for large graphs."""
    if n * n > most_pairs:
        raise ValueError("too many pairs of nodes; use random_edges")
    pairs = spark.range(n * n).select(F.expr(f"id div {n}").alias("src"), (F.col("id") % n).alias("dst"))
    return hashed(pairs.where("src <> dst"), "u", "src", "dst", str(seed)).where(F.col("u") < _share(p)).select("src", "dst")


def erdos_renyi_sql(n: int, p: float, seed: int = 0) -> str:
    pairs = f"select id // {n} as src, id % {n} as dst from range({n * n}) t(id) where id // {n} <> id % {n}"
    return f"select src, dst from ({hashed_sql(pairs, 'u', 'src', 'dst', str(seed))}) where u < {_share(p)}"


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """src, dst: m draws of ordered pairs, equal ones and loops left out; work in proportion to m."""
    e = hashed(hashed(spark.range(m), "a", "id", str(2 * seed)), "b", "id", str(2 * seed + 1))
    return e.select((F.col("a") % n).alias("src"), (F.col("b") % n).alias("dst")).where("src <> dst").distinct()


def random_edges_sql(n: int, m: int, seed: int = 0) -> str:
    e = hashed_sql(hashed_sql(f"select id from range({m}) t(id)", "a", "id", str(2 * seed)), "b", "id", str(2 * seed + 1))
    return f"select distinct a % {n} as src, b % {n} as dst from ({e}) where a % {n} <> b % {n}"


#: Draws after which an endpoint counts as settled: each settles one with probability 1/2 at least.
DRAWS = 64


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """src, dst: preferential attachment of m edges for each new node; loops and equal pairs are left out.

    All edges' ends lie in one list: 2e is the new node e div m, and 2e + 1 copies
    a uniformly drawn earlier place, which is attachment by degree. A place's
    value is found by drawing again while an odd place comes up, with a hash of
    the place, so every edge is settled by itself and no node waits for another.
    """
    if not 0 < m < n:
        raise ValueError("need 0 < m < n")
    ends = spark.range(n * m).select(F.expr(f"id div {m}").alias("src"), (2 * F.col("id") + 1).alias("q"))
    draw = f"{_hash('z', str(seed))} % z"
    settled = f"aggregate(sequence(1, {DRAWS}), q, (z, i) -> CASE WHEN z % 2 = 1 THEN {draw} ELSE z END)"
    return ends.select("src", F.expr(f"{settled} div {2 * m}").alias("dst")).where("src <> dst").distinct()


def barabasi_albert_sql(n: int, m: int, seed: int = 0) -> str:
    drawn = hashed_sql("select src, q from walk where q % 2 = 1", "d", "q", str(seed))
    return (
        f"with recursive walk as (select id // {m} as src, 2 * id + 1 as q from range({n * m}) t(id) union all select src, d % q as q from ({drawn})) "
        f"select distinct src, q // {2 * m} as dst from walk where q % 2 = 0 and src <> q // {2 * m}"
    )


def power_law(spark: SparkSession, n: int, m: int, exponent: float = 3.0, seed: int = 0) -> DataFrame:
    """src, dst: m edges from each node to targets of power-law in-degree, without growth.

    A target's number is n u**a with a = (exponent - 1) / (exponent - 2), which gives
    expected in-degrees with that tail exponent.
    """
    a = (exponent - 1) / (exponent - 2)
    draws = hashed(spark.range(n * m).select(F.expr(f"id div {m}").alias("src"), (F.col("id") % m).alias("k")), "u", "src", "k", str(seed))
    u = F.col("u").cast("double") / float(P)
    e = draws.select("src", F.floor(F.lit(float(n)) * (u * u if a == 2 else F.pow(u, F.lit(a)))).alias("dst"))
    return e.where("src <> dst").distinct()


def power_law_sql(n: int, m: int, seed: int = 0) -> str:
    """For the exponent 3."""
    draws = hashed_sql(f"select id // {m} as src, id % {m} as k from range({n * m}) t(id)", "u", "src", "k", str(seed))
    u = f"(cast(u as double) / cast({P} as double))"
    return f"select distinct src, dst from (select src, cast(floor(cast({n} as double) * ({u} * {u})) as bigint) as dst from ({draws})) where src <> dst"


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> DataFrame:
    """src, dst: a ring in which each node points to its next k / 2 ones, each edge rewired with probability p."""
    half = k // 2
    ring = spark.range(n * half).select(F.expr(f"id div {half}").alias("src"), (F.col("id") % half + 1).alias("j"))
    both = hashed(hashed(ring, "u", "src", "j", str(2 * seed)), "t", "src", "j", str(2 * seed + 1))
    dst = F.when(F.col("u") < _share(p), (F.col("src") + 1 + F.col("t") % (n - 1)) % n).otherwise((F.col("src") + F.col("j")) % n)
    return both.select("src", dst.alias("dst")).distinct()


def watts_strogatz_sql(n: int, k: int, p: float, seed: int = 0) -> str:
    half = k // 2
    both = hashed_sql(hashed_sql(f"select id // {half} as src, id % {half} + 1 as j from range({n * half}) t(id)", "u", "src", "j", str(2 * seed)), "t", "src", "j", str(2 * seed + 1))
    return f"select distinct src, case when u < {_share(p)} then (src + 1 + t % {n - 1}) % {n} else (src + j) % {n} end as dst from ({both})"
