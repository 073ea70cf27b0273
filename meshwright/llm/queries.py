"""The queries that the driver runs over this folder's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import decontamination, divergence, near_duplicates, oracles, packing, personal_data, quality_model, quality_rules, quotation, records, site_templates, spelling, token_counts, warc
from meshwright.llm.shared import read_table


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(read_table(spark, sf_dir, "documents"), size=2)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here reply_to is -1 where a message replies to none."""
    return quotation.build(read_table(spark, sf_dir, "conversations")).withColumn("reply_to", F.coalesce("reply_to", F.lit(-1)).cast("long"))


def op4_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(read_table(spark, sf_dir, "documents"))


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(read_table(spark, sf_dir, "documents"))


def op8_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(read_table(spark, sf_dir, "pages"))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read_table(spark, sf_dir, "documents"))


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read_table(spark, sf_dir, "documents"))


def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


OPERATORS = (
    op1_compression_classifier,
    op2_odd_sketch_near_duplicates,
    op3_quotation_linking,
    op4_karmarkar_karp_packing,
    op5_length_delimited_records,
    op6_cgk_decontamination,
    op7_weak_supervision_pii,
    op8_site_template_removal,
    op9_compression_bands,
    op10_trie_token_counts,
    op11_source_divergence,
    op12_spelling_groups,
    op13_warc_transactions,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The other operators use zstandard, tokenizers, trained models or edit distances, which SQL can't express; tests hold them against plain versions."""
    return {
        "op2_odd_sketch_near_duplicates": oracles.OP2,
        "op3_quotation_linking": f"select * replace (coalesce(reply_to, -1) as reply_to) from ({oracles.OP3})",
        "op11_source_divergence": oracles.OP11,
        "op12_spelling_groups": oracles.OP12,
        "op13_warc_transactions": oracles.OP13,
    }
