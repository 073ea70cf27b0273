"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept, which is written as Parquet and read again in between. All stages but the
last return the columns of `documents`.

Defined results: null, empty and blank texts go in the first stage (too few
words); rows with a null doc_id, and rows that share one, are judged each by its own
text, and of near duplicates one row stays whatever the ids; extra columns are
carried along; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import decontamination, near_duplicates, packing, personal_data, quality_rules
from meshwright.llm.shared import delete, read_table, released, scratch

#: No stage can be said in SQL whole (zstandard, MinHash, edit distance, a trained classifier, a tokenizer).
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays."""
    return near_duplicates.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the text; n_chars follows."""
    out = personal_data.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 2048: a row for each piece, with its ids and its place."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder, read again, and deleted once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        out = stage(spark, docs, sf_dir)
        with released(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
