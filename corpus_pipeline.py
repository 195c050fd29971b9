"""From raw documents to packed token sequences: five stages, each one operator of strata.llm.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of documents. Rows are told apart by id and text, so rows with equal
ids have verdicts of their own (near duplicates: equal ids are one document, and of rows equal in
id and text one stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, near_dup, packing, quality, secrets, tokens
from strata.session import checkpoint_dir


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``verdicts`` (doc_id, text_hash)."""
    bad = verdicts.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (quality.text_hash(F.col("text")) == F.col("__hash")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _without(docs, quality.judge(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, a null id after all
    others. Rows of one id and text are one document, of which one row stays; texts without words all stay."""
    text_hash = quality.text_hash(F.col("text"))
    # ids are integers below 2**62; rows without one are known by their text
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(text_hash, F.lit(2**62)))
    keyed = docs.select("*", row_id.alias("__row"), text_hash.alias("__text"))
    gone = near_dup.near_duplicates(keyed, id_col="__row").where(~F.col("kept")).select("__row").distinct()
    kept = keyed.join(gone, "__row", "left_anti")
    again = keyed.where(F.rlike("text", F.lit(f"[^{quality.BLANK[1:]}"))).groupBy("__row", "__text").agg(F.count("*").alias("n"))
    again = again.where("n > 1").drop("n").checkpoint()
    if not again.isEmpty():
        once = kept.join(again, ["__row", "__text"], "left_semi").dropDuplicates(["__row", "__text"])
        kept = kept.join(again, ["__row", "__text"], "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.decontaminate(docs, items).where("contaminated"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced by a mark, and n_chars follows the text."""
    found = secrets.scan(docs, redact=True, carry=True)
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.length("redacted").cast("long"))}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs, tokens.default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: tokenisation and packing have no SQL form: tests/llm/test_pipeline.py holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on a checkpoint of what the one before kept."""
    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = docs.checkpoint()
    return docs
