"""A training corpus from documents: toxicity, line dedup, near-duplicate documents, mixture of sources, tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, lines, minhash, mixing, toxicity
from lexloom.llm.common import Scratch, read_table
from lexloom.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Stage) -> Stage:
    """Columns that documents have besides their own pass through a stage whatever their names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"other_column_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        back = dict(zip(names, docs.columns, strict=True))
        return out.toDF(*[back[c] for c in out.columns])

    return run


@carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones among those given, does not reject."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-toxicity"))
    return toxicity.score(docs, model).where("toxicity < 0.5").drop("toxicity")


@carrying
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by three documents or more stay in one. Documents stay, with n_chars of what is left."""
    out = lines.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).drop("n_lines", "n_dropped")


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.near_duplicates(docs).where("kept").select(*docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix_documents(docs, mixing.thirds)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture, with hashes of ids and decoded text."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", "lang", "source", "n_tokens", "bpe_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Hashed samples, a fitted classifier and token merges have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor wrote.

    Null, empty and blank texts are not toxic by themselves, have no near duplicates and no words: they stay until the mixture, which takes
    them with whole repeats of their source only, and have no tokens. Of equal rows one stays in the near-duplicate stage; rows with one
    doc_id and different texts are documents of their own. A null source is a source. An empty table gives an empty result. Columns
    besides those of documents pass all stages but the last, whatever their names.
    """
    tmp = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = tmp.keep(docs, name)
    return docs
