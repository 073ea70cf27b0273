"""What was shuffled for a step that has been written doesn't stay on the disks."""

import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshwright.functions.storage import cut, written
from meshwright.llm import near_duplicates


def shuffled(spark) -> dict[str, int]:
    """Bytes of each shuffle on this machine's disks."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = Counter()
    for f in (f for d in folders for f in Path(d).glob("*/shuffle_*.data")):
        try:
            found[f.name.split("_")[1]] += f.stat().st_size
        except FileNotFoundError:  # deleted meanwhile
            pass
    return found


def left(spark, before: dict[str, int], most: int) -> dict[str, int]:
    """Shuffles since `before` of more than `most` bytes; they are deleted by another thread, which may take a moment."""
    for _ in range(100):
        found = {k: v for k, v in shuffled(spark).items() if k not in before and v > most}
        if not found:
            break
        time.sleep(0.1)
    return found


@pytest.mark.parametrize("write", [cut, lambda df: written(df, "copy")])
def test_a_written_step_leaves_no_shuffle_files(spark, write):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, said = shuffled(spark), spark.conf.get(name, None)
    df = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count()
    out = write(df.join(df.withColumnRenamed("count", "n"), "k").distinct())
    assert not left(spark, before, 0)
    assert spark.conf.get(name, None) == said
    # The written step and what it was made from can still be read, again and again.
    assert [(x.count(), x.count()) for x in (out, df)] == [(1000, 1000)] * 2


def test_near_duplicates_leave_no_rows_shuffled(spark, docs):
    base = [f"w{i}" for i in range(400)]
    pairs = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(200)]
    before = shuffled(spark)
    kept = near_duplicates.keep_one(docs(pairs), size=2)
    # Counts and the like shuffle a row a task.
    assert not left(spark, before, 1000)
    assert [r.doc_id for r in kept.collect()] == [0]
