"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and other columns with clashing names (which go), and gives no rows for none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.llm import bpe, decontaminate, near_dup, quality_classifier, quality_rules
from footgrid.llm.common import stored
from footgrid.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is judged as an empty one; rows that repeat a doc_id are judged
    each by its own text, equal rows alike; without labels none goes.
    """
    docs = docs.select(*COLUMNS)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score too low against the trusted target go.

    Null, empty and very short texts have too few words and go; rows that repeat
    a doc_id are judged each by its own text, equal rows alike; without trusted
    documents the base rules alone decide.
    """
    return quality_rules.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays; equal rows stay once.

    Texts without words are duplicates of nothing and stay, and so do rows
    without a doc_id. Of a doc_id with several texts all stay if it stands for
    any of their groups, as it names one document.
    """
    docs = docs.select(*COLUMNS)
    kept = near_dup.apply(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go.

    Texts without words hold none and stay; rows that repeat a doc_id go by
    their own text; an empty benchmark leaves all.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.apply(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64("text", F.octet_length("text")) == F.col("found_hash"))
    return docs.join(found, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row: ids are little-endian unsigned 32-bit integers; null and empty texts have none."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: The first stages are models fitted here; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
