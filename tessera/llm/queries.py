"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, html_extract, lm, middle, oracles, packing, pii, quality, sentence_pieces, set_join, simhash, suffix_dedup, toxicity
from .common import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(table(spark, sf_dir, "documents"))


def op2_two_stage_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id")


def op6_gated_recurrent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_aho_corasick_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_relational_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_two_stage_suffix_array,
        op3_tag_path_ratios,
        op4_boosted_candidates,
        op5_bit_sliced_simhash,
        op6_gated_recurrent_model,
        op7_shortest_pack_first,
        op8_adaptive_dimension_scan,
        op9_aho_corasick_viterbi,
        op10_factorization_machine,
        op11_heavy_light_join,
        op12_delta_lloyd,
        op13_relational_middle,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op11_heavy_light_join": oracles.SET_JOIN,
    "op12_delta_lloyd": oracles.CODES,
    "op13_relational_middle": oracles.FILL_IN_MIDDLE,
}
