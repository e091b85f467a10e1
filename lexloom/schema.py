"""Schemas of the rows that operators exchange, and document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(_I)), T.StructField("values", T.ArrayType(_D))])
BLOB = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("mime_type", _S), T.StructField("meta", _S)])
#: A stored document. meta is JSON text or, with `parse_json`, a variant; hot keys become typed columns of their own.
DOCUMENT = T.StructType([T.StructField("id", _S, False), T.StructField("content", _S), T.StructField("blob", BLOB), T.StructField("meta", _S), T.StructField("score", _D), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("sparse_embedding", SPARSE)])
#: A ranked list: order is a column, as rows have none.
RANKED = T.StructType([T.StructField("query_id", _L), T.StructField("id", _S), T.StructField("rank", _L), T.StructField("score", _D)])
SPAN = T.StructType([T.StructField("start", _I), T.StructField("end", _I)])
OVERLAP = T.StructType([T.StructField("doc_id", _S), T.StructField("range", SPAN)])
CHUNK = T.StructType([T.StructField("source_id", _S), T.StructField("split_id", _I), T.StructField("content", _S), T.StructField("split_idx_start", _I), T.StructField("page_number", _I), T.StructField("split_overlap", T.ArrayType(OVERLAP))])
TOOL_CALL = T.StructType([T.StructField("tool_name", _S), T.StructField("arguments", _S), T.StructField("id", _S)])
TOOL_RESULT = T.StructType([T.StructField("result", _S), T.StructField("origin", TOOL_CALL), T.StructField("error", T.BooleanType())])
CONTENT = T.StructType([T.StructField("kind", _S), T.StructField("text", _S), T.StructField("tool_call", TOOL_CALL), T.StructField("tool_result", TOOL_RESULT)])
MESSAGE = T.StructType([T.StructField("role", _S), T.StructField("content", T.ArrayType(CONTENT)), T.StructField("name", _S), T.StructField("meta", _S)])
EXTRACTED_ANSWER = T.StructType([T.StructField("query", _S), T.StructField("score", _D), T.StructField("data", _S), T.StructField("document_id", _S), T.StructField("context", _S), T.StructField("document_offset", SPAN), T.StructField("context_offset", SPAN), T.StructField("meta", _S)])
GENERATED_ANSWER = T.StructType([T.StructField("data", _S), T.StructField("query", _S), T.StructField("document_ids", T.ArrayType(_S)), T.StructField("meta", _S)])
ENTITY = T.StructType([T.StructField("entity", _S), T.StructField("start", _I), T.StructField("end", _I), T.StructField("score", _D)])
ROLES = ("user", "system", "assistant", "tool")


def document_id(content: Column, meta: Column | None = None) -> Column:
    """A document's id from its content and canonical JSON of its meta; null and empty content give the same id."""
    absent = F.lit("None")
    text = F.coalesce(F.nullif(content, F.lit("")), absent)
    return F.sha2(F.concat(text, absent, absent, absent, (F.lit("{}") if meta is None else F.coalesce(meta, F.lit("{}"))), absent, F.lit("")), 256)


def flatten(meta_fields: list[str], meta: str = "meta") -> list[Column]:
    """Keys of a JSON meta column as columns."""
    return [F.get_json_object(meta, f"$.{k}").alias(k) for k in meta_fields]


def text_message(role: Column | str, text: Column) -> Column:
    """A message of one text part."""
    r = F.lit(role) if isinstance(role, str) else role
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast(TOOL_CALL).alias("tool_call"), F.lit(None).cast(TOOL_RESULT).alias("tool_result"))
    return F.struct(r.alias("role"), F.array(part).alias("content"), F.lit(None).cast("string").alias("name"), F.lit("{}").alias("meta"))


def wire_message(message: Column) -> Column:
    """Chat-completion JSON of a message: role, content, name and tool calls or the call answered."""
    texts = F.array_join(F.transform(F.filter(message["content"], lambda c: c["kind"] == "text"), lambda c: c["text"]), "")
    calls = F.transform(
        F.filter(message["content"], lambda c: c["kind"] == "tool_call"),
        lambda c: F.struct(c["tool_call"]["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["tool_call"]["tool_name"].alias("name"), c["tool_call"]["arguments"].alias("arguments")).alias("function")),
    )
    answers = F.filter(message["content"], lambda c: c["kind"] == "tool_result")
    return F.to_json(F.struct(message["role"].alias("role"), F.when(F.size(answers) > 0, F.get(answers, F.lit(0))["tool_result"]["result"]).otherwise(texts).alias("content"), message["name"].alias("name"), F.when(F.size(calls) > 0, calls).alias("tool_calls"), F.get(answers, F.lit(0))["tool_result"]["origin"]["id"].alias("tool_call_id")))
