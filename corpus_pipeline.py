"""A training-data pipeline over ``documents``: stages of the subpackage llm, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir), is written as Parquet in the shared folder, and is read again as the
documents of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import decontaminate, line_dedup, near_dup, packing, shared, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (learned from the labelled ones) does not reject."""
    shared.prepare(spark)
    return toxicity.rejected_out(docs.select(COLUMNS), toxicity.learned(docs, shared.table(spark, sf_dir, "labels")))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    shared.prepare(spark)
    cleaned = line_dedup.without_boilerplate(docs.select(COLUMNS))
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``row``, fixed by storing it: doc_id may be null or come twice, and decisions are about rows."""
    return shared.stored(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), name)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): one with the least doc_id. Rows without doc_id stay."""
    shared.prepare(spark)
    docs = _numbered(docs, "near-rows")
    groups = near_dup.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    groups = shared.stored(groups, "near-groups").join(docs.where("doc_id is not null").select("row", "doc_id"), "row")
    least = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1")
    gone = shared.stored(groups.join(least, "group").where("row <> least.row").select("row"), "near-copies")
    return docs.join(gone, "row", "left_anti").select(COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, nor an edited copy of one, whether they have a doc_id or not."""
    shared.prepare(spark)
    docs = _numbered(docs, "benchmark-rows")
    held = decontaminate.contaminated(docs.select(F.col("row").alias("doc_id"), "text"), shared.table(spark, sf_dir, "benchmark"))
    gone = shared.stored(held.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return docs.join(gone, "row", "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    shared.prepare(spark)
    return packing.packed(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("minhash", near_copies_out), ("decontaminate", benchmark_out), ("packing", packed)]

#: The stages learn models and compare texts in ways that SQL does not express; tests hold each operator against brute force, and the stages against planted cases and odd rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
