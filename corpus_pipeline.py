"""A corpus pipeline: quality rules, near duplicates, shared passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, simhash, suffix_dedup
from tessera.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. Null and empty texts fail the rules; rows are judged each by its own text, whatever
    its doc_id, so repeats all stay or all go."""
    kept = quality.keep(docs)
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest doc_id (of rows that share it, the first read).

    Groups are of rows, not of doc_ids: a row is judged by its own text, whether its doc_id is repeated or null. A null doc_id comes
    after all others, so such a row stays unless its text is a near duplicate of another row's. Null and empty texts are near duplicates
    of each other.
    """
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = simhash.near_duplicates(rows.withColumn("own", F.col("doc_id").cast("long")), id_col="row", carry=("own",))
    best = F.min(F.struct(F.col("own").isNull(), "own", F.col("doc_id").alias("row")))  # near_duplicates calls the row key doc_id
    first = found.groupBy("component_id").agg(best.alias("best")).select("best.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that also start in a document with a smaller doc_id; n_chars follows. A null text becomes the
    empty one. Rows with a null doc_id keep their text and take nothing from others; rows of one doc_id take nothing from each other.
    Where a removed range ends inside a character, the rest of that character goes too.
    """
    out = suffix_dedup.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind; n_chars follows. A null text becomes the empty one; null and
    repeated doc_ids stay."""
    found = pii.find(docs, carry=("lang", "source")).select("doc_id", pii.redacted().alias("text"), "lang", "source")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Empty and null texts are one end token; null and repeated doc_ids are packed each by itself."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: The models' and sorters' stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
