"""Ready chains of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import clean, split_documents
from lexloom.operators import build, fuse, models, retrieve, route


def indexing(docs: DataFrame, model="hashing", by: str = "word", length: int = 200, overlap: int = 0, languages: Sequence[str] | None = None) -> DataFrame:
    """Documents (id, content) cleaned, split and embedded: source_id, split_id, content, ..., id, embedding."""
    df = docs.withColumn("content", clean(F.col("content")))
    if languages:
        df = route.language_route(df, languages, "content").where(F.col("language").isin(*languages))
    df = split_documents(df, by, length, overlap)
    df = df.withColumn("id", F.concat_ws("-", F.col("source_id").cast("string"), F.col("split_id").cast("string")))
    return models.embed_documents(df, model)


def hybrid_search(chunks: DataFrame, queries: DataFrame, model="hashing", top_k: int = 10) -> DataFrame:
    """BM25 and vectors, fused by reciprocal ranks. queries: query_id, query."""
    words = retrieve.bm25_topk(retrieve.Bm25Index(chunks), queries, top_k)
    vectors = retrieve.vector_topk(chunks, queries.withColumn("embedding", models.embed_text(F.col("query"), model)), top_k, "cosine")
    return fuse.join_documents(fuse.as_lists(words, vectors), 2, "reciprocal_rank_fusion", top_k=top_k)


def rag(chunks: DataFrame, queries: DataFrame, generator, template: str = "Answer from these documents.\n{% for d in documents %}{{ d.content }}\n{% endfor %}Question: {{ query }}\nAnswer:", model="hashing", top_k: int = 5) -> DataFrame:
    """query_id, query, documents, prompt, reply and answer with references."""
    hits = hybrid_search(chunks, queries, model, top_k).join(chunks.select("id", "content"), "id")
    docs = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "content"))), lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"))).alias("documents"))
    asked = build.prompt_rows(queries.join(docs, "query_id"), template)
    return build.answers(models.generate(asked, generator), documents="documents", reference_pattern=r"\[(\d+)\]")


def chat_with_pages(pages: DataFrame, queries: DataFrame, generator, html: str = "html") -> DataFrame:
    """Answers from the text of web pages (page_id, html)."""
    from lexloom.sources.files import html_to_text

    docs = pages.select(F.col("page_id").alias("id"), html_to_text(F.col(html)).alias("content"))
    return rag(split_documents(docs, "word", 200).withColumn("id", F.concat_ws("-", "source_id", "split_id")).transform(models.embed_documents), queries, generator)
