"""The registered queries of the operators: thin wrappers that return the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebuy.llm import (
    decontamination,
    exact_dedup,
    html_extraction,
    language_id,
    lexical_search,
    near_join,
    packing,
    quality,
    sharding,
    simple8b,
    spelling,
    tokens,
    toxicity,
    warc,
)
from rebuy.llm.common import crc32_bucket, scratch_path, table
from rebuy.session import materialize


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.RuleEnsemble:
    return quality.train(docs, table(spark, sf_dir, "labels"), crc32_bucket(F.col("doc_id"), 5) != 0)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), "text", [F.col("doc_id")])
    return scored.select(
        "doc_id",
        (crc32_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"), separator="\n\n")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = materialize(packing.pieces(docs, tokens.default_vocabulary(), end_id=0, capacity=2048), "pieces")
    packed = packing.pack(cut, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.exact_shuffle(docs, 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, crc32_bucket(F.col("doc_id"), 4) != 2, language_id.default_vocabulary())
    found = language_id.predict(spark, docs, model)
    return found.select("doc_id", (crc32_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc32_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.score(spark, docs, model).select(
        "doc_id",
        (crc32_bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    simple8b.write_token_files(table(spark, sf_dir, "documents"), path, tokens.default_vocabulary(), end_id=1)
    return simple8b.read_token_files(spark, path)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), modulus=199)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity_crf": op8_toxicity_crf,
    "op9_token_binary": op9_token_binary,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_warc": op11_warc,
    "op12_spelling": op12_spelling,
    "op13_lexical_search": op13_lexical_search,
}
