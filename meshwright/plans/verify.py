"""Comparison, timing and parameter sweeps."""

from __future__ import annotations

import csv
import itertools
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Verdict:
    same: bool
    rows: int
    missing: int
    wrong: int
    greatest_difference: float


def verify(a: DataFrame, b: DataFrame, atol: float = 1e-6, rtol: float = 1e-6) -> Verdict:
    """Whether two results (id, h) agree; a node or a feature that only one of them has is a failure."""
    both = a.select("id", F.col("h").alias("x")).join(b.select("id", F.col("h").alias("y")), "id", "full_outer")
    gone = F.col("x").isNull() | F.col("y").isNull() | (F.size("x") != F.size("y"))
    apart = F.zip_with("x", "y", lambda p, q: F.when(p.eqNullSafe(q), 0.0).otherwise(F.abs(p - q)))
    beyond = F.exists(F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q) & ~(F.abs(p - q) <= atol + rtol * F.abs(q))), lambda t: t)
    got = both.select(gone.alias("gone"), F.when(~gone, F.array_max(apart)).alias("d"), F.when(~gone, beyond).alias("w")).agg(
        F.count("*").alias("rows"), F.sum(F.col("gone").cast("long")).alias("missing"), F.sum(F.coalesce(F.col("w"), F.lit(False)).cast("long")).alias("wrong"), F.max("d").alias("d")
    ).first()
    missing, wrong = got["missing"] or 0, got["wrong"] or 0
    return Verdict(not missing and not wrong, got["rows"], missing, wrong, float(got["d"] or 0.0))


def run_fully(df: DataFrame) -> None:
    """Compute all rows and columns and keep none."""
    df.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Profile:
    seconds: float
    nodes_per_s: float
    edges_per_s: float
    parallelism: int
    #: The most heap that the driver's JVM, in local mode the executors' too, had in use meanwhile.
    peak_mb: float = 0.0


def _heap_pools(df: DataFrame) -> list:
    beans = df.sparkSession.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return [x for x in beans if str(x.getType()) == "Heap memory"]


def profile(make: Callable[[], DataFrame], n_nodes: int, n_edges: int) -> Profile:
    started = time.perf_counter()
    df = make()
    pools = _heap_pools(df)
    for x in pools:
        x.resetPeakUsage()
    run_fully(df)
    s = time.perf_counter() - started
    return Profile(s, n_nodes / s, n_edges / s, df.sparkSession.sparkContext.defaultParallelism, sum(x.getPeakUsage().getUsed() for x in pools) / 1e6)


def sweep(path: str, choices: dict[str, Iterable], run: Callable[..., Profile], repeat: int = 3) -> list[dict]:
    """Run all combinations of `choices` `repeat` times each and write a CSV row for each run."""
    rows = []
    for values in itertools.product(*choices.values()):
        picked = dict(zip(choices, values, strict=True))
        for k in range(repeat):
            rows.append(picked | {"run": k} | vars(run(**picked)))
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]) if rows else list(choices))
        out.writeheader()
        out.writerows(rows)
    return rows
