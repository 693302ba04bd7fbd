"""A corpus pipeline: quality, language, boilerplate lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a DataFrame; its result is written
as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import best_fit, language_id, parity_join, quality, site_lines
from gridspark.llm.columns import shared_table
from gridspark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_CERTAIN = 0.5  # posterior probability below which a language counts as unknown
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from preference pairs, reaches the cut."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, "text", COLUMNS, "score").where(F.col("score") >= quality.CUT).select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: told from the others, and as probable as its labelled texts are."""
    model = language_id.fit_languages(docs)
    found = language_id.identify(docs, model, "text", COLUMNS, cuts=language_id.fit_cuts(model))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN) & F.col("fits")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate in their source; the length is that of the new text."""
    cleaned = site_lines.drop_boilerplate(docs.select(*COLUMNS), "source", "text")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the least id, and of several such rows, or rows without an id, one of them.

    Rows are told apart by a number that is written once, so repeated ids and NULL ids are rows like others.
    """
    rows = shared_table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")))
    found = parity_join.jaccard_components(rows, "row_id", "text").select(F.col("row_id").alias("found_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    kept = rows.select("doc_id", "row_id").join(found, F.col("row_id") == F.col("found_id")).groupBy("component_id").agg(
        F.min(order).alias("least")).select(F.col("least.row_id").alias("kept_id"))
    return rows.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return best_fit.pack(best_fit.token_pieces(docs, "doc_id", "text", vocabulary("byte_bpe_50k.json")))


STAGES = [("quality", keep_quality), ("language", keep_languages), ("lines", drop_lines),
          ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
