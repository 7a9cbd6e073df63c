"""A corpus pipeline of five operators over ``documents``; each stage is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.llm import decontam, minhash, packing, quality, secrets
from rareflow.llm.common import keep, kept_tables, read, release, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have no words and go; null ids and repeated rows are judged like all others."""
    return quality.drop_low_quality(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): smallest id, null last, then row key.

    Every row has a key of its own, so rows without an id stay if they are unique, and rows that share an id are
    compared as any others. The keyed rows are written once, as each pass must see the same keys. The kept keys grow
    with the corpus, so the join shuffles at every size.
    """
    rows = keep(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    groups = minhash.near_duplicates(rows, width=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    kept = keep(groups.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min_by("__row", order).alias("__kept")).select("__kept"))
    return rows.join(kept.hint("merge"), F.col("__row") == F.col("__kept"), "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null texts, null ids and repeated rows stay."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked; n_chars follows the new text. Null texts stay null, with null n_chars."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place. A null text is the end id alone; null ids stay."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", best_fit_packing),
]

#: The tokeniser and the similarity classes have no SQL form; test_pipeline in tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep. A stage's own tables and its input go once its output is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        others = set(kept_tables())
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        release(spark, *before, *(path for path in kept_tables() if path not in others))
        before = [f"{base}/{name}"]
    return docs
