"""A training-data pipeline over ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns those it keeps with the columns they
had; the last one returns piece ids. ``run`` writes what a stage returns and reads it again for the next one, so a lost
executor costs at most the current stage.

Rows with a null id take part in all stages. Near copies are judged row by row, so of rows repeating an id and a text
one stays, and a text of its own stays whatever other rows with its id hold. An empty table passes through all stages as
an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import language_id, mixing, ngram_join, quality, sentencepiece_fst
from foliospark.llm.queries import PIECES
from foliospark.llm.words import whole_text
from foliospark.plans.session import stored

#: least share of the predicted language among all, and most cost per letter beside that of the language's own texts
LEAST_SCORE, MOST_SURPRISE = 0.5, 3.2


#: rows that travel to Python at once: a row is a whole document, and batches take memory on both sides
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of documents small where the session has larger ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, BATCH_ROWS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that can be told; those without letters, noise of letters and unknown languages go."""
    small_batches(spark)
    model = language_id.fit(docs, public_tokenizers.path(PIECES))
    judged = language_id.identify(docs, model)
    known = (F.col("lang_pred") != language_id.UNDEFINED) & (F.col("score") >= LEAST_SCORE) & (F.col("surprise") <= MOST_SURPRISE)
    return judged.where(known).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the fixed limits and are no outliers of their language and source."""
    return quality.keep(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null last), of each group of near copies."""
    small_batches(spark)
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "near-copy-rows")
    groups = ngram_join.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text"))
    members = groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", F.col("doc_id").alias("_id")), "_row")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first")
    kept = members.groupBy("component_id").agg(first).select("_first._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it."""
    return mixing.copies(mixing.mix(docs)).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they read back as the text."""
    small_batches(spark)
    coded = sentencepiece_fst.pieces(docs, public_tokenizers.path(PIECES))
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("decoded") == whole_text()).alias("same_text")
    )


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Piece probabilities, shortest paths and components over all documents are nothing SQL can say; tests hold the stages
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
