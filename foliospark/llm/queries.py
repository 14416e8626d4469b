"""Queries of the operators over their whole tables, with SQL counterparts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import (
    chat,
    language_id,
    mixing,
    ngram_join,
    quality,
    rp_forest,
    sentencepiece_fst,
    sharding,
    text_density,
    token_counts,
    turn_alignment,
    url_filters,
    whitening,
)
from foliospark.llm.words import whole_text, word_count
from foliospark.plans.session import stored

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filters", url_filters.ORACLE)
def op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(url_filters.captures_from_pages(pages), url_filters.list_from_pages(pages))


@query("op2_sharding")
def op2(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("weight").alias("group_size")
    )


@query("op5_quality_rules")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rated = quality.base_stats(docs).drop("text").withColumn("base_failed", quality.base_failed())
    return quality.verdict(stored(rated, "quality-stats")).select("doc_id", *quality.STATS, "base_failed", "kept", "distance2")


@query("op6_chat_formatting", chat.ORACLE)
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.TRAP).alias("text")
    )
    records = chat.records_from_turns(rows.unionByName(trap))
    return chat.digests(chat.read_back(chat.format_turns(chat.canonical(records))))


@query("op10_source_mixing", mixing.ORACLE)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(whole_text()).alias("size"))
    return mixing.mix_sizes(stored(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_fst.pieces(docs, public_tokenizers.path(PIECES))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), sentencepiece_fst.ids_digest(F.col("ids")).alias("ids_sha256"), (F.col("decoded") == whole_text()).alias("same_text")
    )


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, public_tokenizers.path(PIECES))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_token_counts")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(WORDS)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op4_embedding_near_dedup")
def op4(spark, sf_dir):
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_conversation_repair", turn_alignment.ORACLE)
def op11(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_alignment.repair(turns).drop("repaired")


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op13_html_extraction")
def op13(spark, sf_dir):
    return text_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
