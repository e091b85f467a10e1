"""Queries opN_<name> and pipeline: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import oracles
from lexloom.llm.common import Scratch, read_table, text_key

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Pages whose html holds one of these words have their canonical url listed.
LISTED = "(?i)\\b(scum|moron|idiot)\\b"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.sharding import shard

    docs = read_table(spark, sf_dir, "documents")
    a, b = text_key("text")
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), a.alias("t1"), b.alias("t2"))
    out = shard(slim, ["t1", "t2"], ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.toxicity import held_out, score, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.bpe import encode_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer_path(), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.urls import canonical, filter_urls

    pages = read_table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(LISTED)).select(canonical(F.col("url")).alias("canonical_url"))
    return filter_urls(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.minhash import near_duplicates

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.mixing import mix, thirds

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, thirds).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.quality import judge

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.embeddings import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.suffixes import dedup_substrings

    out = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.lines import dedup_lines

    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_urls": op4_urls, "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing, "op7_quality": op7_quality, "op8_embeddings": op8_embeddings, "op9_suffixes": op9_suffixes,
    "op10_lines": op10_lines, "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op4_urls": oracles.urls(URL_RULES, LISTED), "op7_quality": oracles.quality(), "op8_embeddings": oracles.LINKS, "op10_lines": oracles.LINES}
