"""Models run layer by layer, each layer's result written: states with a lifetime, and what each layer cost.

A run of `SparkEngine` is one lazy plan. Here every layer's rows (id, h) are written
as Parquet to the shared folder before the next layer reads them, and deleted as soon
as that one's are there, so storage holds two states at most, whatever the depth, and
a lost executor costs no more than its part of one layer.

Because a layer's jobs are over when its rows are written, Spark's own counts of them
(status store of the driver, filled by the executors' reports) are the layer's: tasks,
processor time, shuffled and spilled bytes, the most memory that one task had for
sorting, joining and grouping; for each executor too. Only those sums reach the driver.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.storage import delete, scratch
from meshwright.graph import Graph
from meshwright.layers import GNNModel, Layer
from meshwright.plans.engine import SparkEngine

MB = 1e6


@dataclass(frozen=True)
class ExecutorCost:
    """What an executor did for a layer. `peak_heap_mb` is 0 where no heartbeat fell into the layer."""

    executor: str
    tasks: int
    task_seconds: float
    shuffle_write_mb: float
    spill_mb: float
    peak_heap_mb: float


@dataclass(frozen=True)
class StageCost:
    """What the stages of some jobs cost together.

    `peak_task_mb`: the most execution memory of one task. `skew`: the longest task
    of the longest stage against that stage's median.
    """

    stages: int
    tasks: int
    failed_tasks: int
    task_seconds: float
    cpu_seconds: float
    shuffle_write_mb: float
    shuffle_read_mb: float
    spill_mb: float
    peak_task_mb: float
    skew: float


@dataclass(frozen=True)
class LayerCost:
    layer: int
    kind: str
    in_dim: int
    out_dim: int
    nodes: int
    seconds: float
    stages: StageCost
    executors: tuple[ExecutorCost, ...]

    def row(self) -> dict:
        """The layer's figures, without those of single executors."""
        return {k: v for k, v in vars(self).items() if k not in ("stages", "executors")} | asdict(self.stages)


class JobGroup:
    """The jobs started within a `with` block, and what they cost.

    The session's job group is a thread's own, and the one set before is set again at the end.
    """

    KEYS = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")

    def __init__(self, spark: SparkSession, what: str):
        self.context, self.name, self.what = spark.sparkContext, f"layers-{uuid.uuid4().hex}", what

    def __enter__(self) -> JobGroup:
        self.before = {k: self.context.getLocalProperty(k) for k in self.KEYS}
        self.context.setJobGroup(self.name, self.what)
        self.started = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.started
        for k, v in self.before.items():
            self.context.setLocalProperty(k, v)

    def costs(self) -> tuple[StageCost, tuple[ExecutorCost, ...]]:
        """Sums over the stages that ran; skipped ones and those the store has dropped already count nothing."""
        spark = self.context._jsc.sc()
        spark.listenerBus().waitUntilEmpty()
        store, tracker = spark.statusStore(), self.context.statusTracker()
        ends = self.context._gateway.new_array(self.context._jvm.double, 2)
        ends[0], ends[1] = 0.5, 1.0
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.name)]
        total, executors, longest = {f.name: 0 if f.type == "int" else 0.0 for f in fields(StageCost)}, {}, 0.0
        for i in sorted({i for job in jobs if job for i in job.stageIds}):
            stage = _stage(store, i)
            if stage is None or stage.status().toString() == "SKIPPED":
                continue
            for k, v in {
                "stages": 1,
                "tasks": stage.numCompleteTasks(),
                "failed_tasks": stage.numFailedTasks(),
                "task_seconds": stage.executorRunTime() / 1e3,
                "cpu_seconds": stage.executorCpuTime() / 1e9,
                "shuffle_write_mb": stage.shuffleWriteBytes() / MB,
                "shuffle_read_mb": stage.shuffleReadBytes() / MB,
                "spill_mb": stage.diskBytesSpilled() / MB,
            }.items():
                total[k] += v
            tasks = store.taskSummary(i, stage.attemptId(), ends)
            if tasks.isDefined():
                memory, times = tasks.get().peakExecutionMemory(), tasks.get().executorRunTime()
                total["peak_task_mb"] = max(total["peak_task_mb"], memory.apply(1) / MB)
                if times.apply(1) > longest:
                    longest, total["skew"] = times.apply(1), times.apply(1) / max(1.0, times.apply(0))
            for pair in _each(store.executorSummary(i, stage.attemptId())):
                x, peaks = pair._2(), pair._2().peakMemoryMetrics()
                own = executors.setdefault(pair._1(), [0, 0.0, 0.0, 0.0, 0.0])
                for k, v in enumerate((x.succeededTasks(), x.taskTime() / 1e3, x.shuffleWrite() / MB, x.diskBytesSpilled() / MB)):
                    own[k] += v
                own[4] = max(own[4], peaks.get().getMetricValue("JVMHeapMemory") / MB if peaks.isDefined() else 0.0)
        return StageCost(**total), tuple(ExecutorCost(k, *v) for k, v in sorted(executors.items()))


def _stage(store, i: int):
    """The stage's last attempt, None if the store has dropped it."""
    try:
        return store.lastStageAttempt(i)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "NoSuchElementException":
            raise
        return None


def _each(found) -> Iterator:
    i = found.iterator()
    while i.hasNext():
        yield i.next()


@dataclass
class StagedRun:
    """The last layer's rows (id, h), read where they were written, and each layer's costs. `close` deletes the rows."""

    result: DataFrame
    layers: list[LayerCost]
    path: str | None = None

    def close(self) -> None:
        if self.path:
            delete(self.result.sparkSession, self.path)


def run_in_stages(engine: SparkEngine, graph: Graph, features: DataFrame, edge_features: DataFrame | None = None) -> StagedRun:
    """All nodes' result as `engine.run` gives it, layer by layer.

    An empty model gives the features themselves and writes nothing.
    """
    graph, state = engine.prepared(graph, features, edge_features)
    spark, norms, done, path = state.sparkSession, {}, [], None
    for i, layer in enumerate(engine.model.layers):
        here = scratch(spark, f"layer-{i}")
        with JobGroup(spark, f"layer {i}") as jobs:
            step = engine.step(graph, state, layer, norms)
            step.write.parquet(here)
        state = spark.read.schema(step.schema).parquet(here)
        if path:
            delete(spark, path)
        path = here
        done.append(LayerCost(i, type(layer).__name__, layer.in_dim, layer.out_dim, state.count(), jobs.seconds, *jobs.costs()))
    return StagedRun(state, done, path)


def numbered_features(nodes: DataFrame, width: int) -> DataFrame:
    """(id, h): features of any width, whole eighths made from the ids."""
    return nodes.select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: (F.pmod(F.col("id") * k, F.lit(17)) - 8) / 8).alias("h"))


def sweep_models(
    path: str,
    graphs: dict[str, Graph],
    kinds: dict[str, Callable[[int, int], Layer]],
    widths: Iterable[int],
    depths: Iterable[int],
    engines: dict[str, SparkEngine] | None = None,
    repeat: int = 1,
) -> DataFrame:
    """Models of all kinds, widths and depths over all graphs by all engines, `repeat` times each: a CSV row a layer and run.

    `kinds` make a layer of an input and an output width; all layers are equally wide. Each
    run's rows go to `path`, a folder that all machines share, as soon as it ends. The result reads them.
    """
    wrote, sizes = None, {name: g.num_directed_entries() for name, g in graphs.items()}
    for (name, g), kind, width, depth, (by, engine) in itertools.product(graphs.items(), kinds, widths, depths, (engines or {"auto": SparkEngine()}).items()):
        spark, edges = g.edges.sparkSession, sizes[name]
        model = GNNModel(tuple(kinds[kind](width, width) for _ in range(depth)))
        for k in range(repeat):
            got = run_in_stages(engine.with_model(model), g, numbered_features(g.nodes, width))
            got.close()
            head = {"graph": name, "model": kind, "width": width, "depth": depth, "engine": by, "run": k, "edges": edges}
            rows = [head | x.row() | {"nodes_per_s": x.nodes / x.seconds, "edges_per_s": edges / x.seconds} for x in got.layers]
            df = spark.createDataFrame([tuple(r.values()) for r in rows], _schema(rows[0]))
            df.coalesce(1).write.mode("append").csv(path, header=True)
            wrote = df.schema
    if wrote is None:
        raise ValueError("a sweep needs a value for each choice")
    return spark.read.csv(path, schema=wrote, header=True)


def _schema(row: dict) -> str:
    names = {int: "long", float: "double", str: "string"}
    return ", ".join(f"{k} {names[type(v)]}" for k, v in row.items())
