"""Model calls as Arrow functions. A model is a factory, called once in each Python worker, that gives a function of a batch."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import ModelUnavailable
from lexloom.operators.build import embedding_text
from lexloom.secrets import Secret, value_of


class ChatModel(Protocol):
    """Takes a list of messages (role, content), gives a reply: text, or {"text", "tool_calls"}."""

    def __call__(self, messages: list[dict], tools: list[dict] | None = None) -> Any: ...


Factory = Callable[[], Callable[[list], Sequence]]
REGISTRY: dict[str, Factory] = {}
_LOADED: dict[Any, Callable] = {}


def register(name: str):
    def add(f: Factory) -> Factory:
        REGISTRY[name] = f
        return f

    return add


def load(model: str | Factory) -> Callable[[list], Sequence]:
    """The batch function of a model; loaded at its first use in a process and kept."""
    if model not in _LOADED:
        if isinstance(model, str) and model not in REGISTRY:
            raise ModelUnavailable(f"no model is registered as {model!r}")
        _LOADED[model] = (REGISTRY[model] if isinstance(model, str) else model)()
    return _LOADED[model]


@register("hashing")
def hashing_embedder(dims: int = 64) -> Callable[[list], Sequence]:
    """Signed hashes of words, unit length: deterministic, and near for texts that share words."""

    def run(texts: list) -> list:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 32 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return run


def package_model(package: str, make: Callable[[Any], Callable[[list], Sequence]]) -> Factory:
    """A model that needs a package which may be missing."""

    def factory():
        import importlib

        try:
            return make(importlib.import_module(package))
        except ImportError as e:
            raise ModelUnavailable(f"this model needs the package {package}") from e

    return factory


def sentence_transformer(model: str = "sentence-transformers/all-mpnet-base-v2", normalize: bool = False, precision: str = "float32", **kw: Any) -> Factory:
    def make(st):
        m = st.SentenceTransformer(model, **kw)
        return lambda texts: m.encode(texts, normalize_embeddings=normalize, precision=precision).tolist()

    return package_model("sentence_transformers", make)


def transformers_task(task: str, model: str, **kw: Any) -> Factory:
    """A local model by its task, such as text-generation, text-classification, zero-shot-classification or question-answering."""

    def make(tr):
        m = tr.pipeline(task, model=model, **kw)
        return lambda batch: list(m(batch))

    return package_model("transformers", make)


def until(model: str | Factory, stop_words: Sequence[str]) -> Factory:
    """A generator whose replies end before the first stop word."""

    def factory():
        f = load(model)

        def cut(t: str | None) -> str | None:
            at = [i for w in stop_words if t and (i := t.find(w)) >= 0]
            return t[: min(at)].rstrip() if at else t

        return lambda batch: [cut(t) for t in f(batch)]

    return factory


def service_embedder(url: str, api_key: str | Secret, model: str, transport=None, batch: int = 32, dimensions: int | None = None) -> Factory:
    """An embedding service of the common wire format (also with a deployment's url and key)."""

    def factory():
        from lexloom.sources.web import http, request

        def run(texts: list) -> list:
            out: list = []
            for i in range(0, len(texts), batch):
                body = {"model": model, "input": texts[i : i + batch]} | ({"dimensions": dimensions} if dimensions else {})
                status, _, data = request(transport or http, url, "POST", {"Authorization": f"Bearer {value_of(api_key)}", "api-key": value_of(api_key), "Content-Type": "application/json"}, json.dumps(body).encode())
                if status >= 400:
                    out += [None] * len(body["input"])  # a failed batch keeps its places
                    continue
                got = sorted(json.loads(data)["data"], key=lambda x: x.get("index", 0))
                out += [x["embedding"] for x in got]
            return out

        return run

    return factory


def token_usage(df: DataFrame, usage: str = "usage", by: Sequence[str] = ("model",)) -> DataFrame:
    """Sums of prompt, completion and total tokens over the JSON that services report of their calls; what is missing counts as 0."""
    n = lambda k: F.coalesce(F.sum(F.get_json_object(usage, f"$.{k}").cast("long")), F.lit(0)).alias(k)
    return df.groupBy(*by).agg(*[n(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")])


def event_lines(lines: Iterable[bytes]) -> Iterator[dict]:
    """The objects of a stream of server-sent events, up to its end mark."""
    for line in lines:
        kind, _, data = line.decode("utf-8", "replace").strip().partition(":")
        if kind == "data" and data.strip() and data.strip() != "[DONE]":
            yield json.loads(data)


def chat_service(url: str, api_key: str | Secret, model: str, transport=None, on_chunk: Callable[[str], None] | None = None, lines=None, **options: Any) -> Factory:
    """A chat service of the common wire format. Batches are lists of message lists.

    With on_chunk the reply is asked for as a stream, and on_chunk gets each piece of text as it arrives. `lines` (url, headers, body) gives
    the lines of a streamed answer; by default they are read from the connection.
    """

    def factory():
        from lexloom.sources.web import http, http_lines, request

        def one(messages: list[dict], tools: list[dict] | None = None):
            body = {"model": model, "messages": messages, **options} | ({"tools": [{"type": "function", "function": t} for t in tools]} if tools else {})
            headers = {"Authorization": f"Bearer {value_of(api_key)}", "api-key": value_of(api_key), "Content-Type": "application/json"}
            if on_chunk:
                got = stream_text(event_lines((lines or http_lines)(url, headers, json.dumps(body | {"stream": True}).encode())), on_chunk)
                calls = [{**c, "arguments": json.loads(c["arguments"] or "{}")} for c in got["tool_calls"]]
                return {"text": got["text"] or None, "tool_calls": calls} if calls else got["text"]
            status, _, data = request(transport or http, url, "POST", headers, json.dumps(body).encode())
            if status >= 400:
                raise OSError(f"the chat service answers {status}")
            m = json.loads(data)["choices"][0]["message"]
            calls = [{"id": c.get("id"), "tool_name": c["function"]["name"], "arguments": json.loads(c["function"]["arguments"] or "{}")} for c in m.get("tool_calls") or []]
            return {"text": m.get("content"), "tool_calls": calls} if calls else m.get("content")

        return lambda batch: [one(m) for m in batch]

    return factory


def stream_text(chunks: Iterator[dict], on_chunk: Callable[[str], None] | None = None) -> dict:
    """Joins the deltas of a streamed reply: text, and tool calls whose arguments come in pieces."""
    text, calls = [], {}
    for c in chunks:
        if "choices" in c and not c["choices"]:
            continue  # usage alone
        d = c["choices"][0]["delta"] if "choices" in c else c
        if d.get("content"):
            text.append(d["content"])
            if on_chunk:
                on_chunk(d["content"])
        for t in d.get("tool_calls") or []:
            call = calls.setdefault(t["index"], {"id": None, "tool_name": "", "arguments": ""})
            call["id"] = t.get("id") or call["id"]
            call["tool_name"] += (t.get("function") or {}).get("name") or ""
            call["arguments"] += (t.get("function") or {}).get("arguments") or ""
    return {"text": "".join(text), "tool_calls": list(calls.values())}


def apply_model(model: str | Factory, returns: str, batch: int = 1024) -> Callable[..., Column]:
    """A model as a function of one column; an Arrow function of batches, loaded once in each worker."""

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load(model)
        for s in parts:
            for i in range(0, len(s), batch):  # given on as they are made, so that one batch of results is held
                yield pd.Series(list(f(s.iloc[i : i + batch].tolist())))

    return run


def embed_documents(df: DataFrame, model: str | Factory = "hashing", content: str = "content", meta_fields: Sequence[str] = (), prefix: str = "", suffix: str = "", separator: str = "\n", keep_empty: bool = True, output: str = "embedding") -> DataFrame:
    """Adds a vector of each document, from chosen meta fields and its content. A vector belongs to the row that it was made from."""
    text = embedding_text(F.col(content), [F.col(m) for m in meta_fields], prefix, suffix, separator, keep_empty)
    return df.withColumn(output, apply_model(model, "array<double>")(text))


def embed_text(text: Column, model: str | Factory = "hashing", prefix: str = "", suffix: str = "") -> Column:
    return apply_model(model, "array<double>")(F.concat(F.lit(prefix), text, F.lit(suffix)))


def generate(df: DataFrame, model: str | Factory, prompt: str = "prompt", output: str = "reply", system: str | None = None) -> DataFrame:
    """Adds the model's reply to each prompt."""
    p = F.col(prompt) if system is None else F.concat(F.lit(system + "\n\n"), F.col(prompt))
    return df.withColumn(output, apply_model(model, "string")(p))


def images(df: DataFrame, model: str | Factory, prompt: str = "prompt") -> DataFrame:
    """Adds the url or encoded bytes of an image for each prompt."""
    return df.withColumn("image", apply_model(model, "string")(F.col(prompt)))


PATTERNS = {"EMAIL": r"[\w.+-]+@[\w-]+\.[\w.]+", "URL": r"https?://\S+", "DATE": r"\b\d{4}-\d{2}-\d{2}\b", "NUMBER": r"\b\d+(?:\.\d+)?\b", "NAME": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"}
ENTITY = "array<struct<entity:string,start:int,end:int,score:double>>"


@register("regex-entities")
def regex_entities() -> Callable[[list], Sequence]:
    compiled = {k: re.compile(p) for k, p in PATTERNS.items()}

    def one(t: str | None) -> list[dict]:
        found = sorted(((m.start(), -m.end(), k) for k, p in compiled.items() for m in p.finditer(t or "")))
        out, end = [], 0
        for a, b, k in found:
            if a >= end:
                out.append({"entity": k, "start": a, "end": -b, "score": 1.0})
                end = -b
        return out

    return lambda texts: [one(t) for t in texts]


def named_entities(df: DataFrame, model: str | Factory = "regex-entities", content: str = "content") -> DataFrame:
    """Adds named_entities: entity, start, end and score of each."""
    return df.withColumn("named_entities", apply_model(model, ENTITY)(F.col(content)))


def extract_metadata(df: DataFrame, model: str | Factory, prompt: Column, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents with extracted JSON, documents that failed with a reason): one call each, the reply a JSON object with all keys."""
    from lexloom.functions.text import json_keys_present, valid_json

    got = df.withColumn("extracted", apply_model(model, "string")(prompt))
    ok = valid_json(F.col("extracted")) & json_keys_present(F.col("extracted"), keys)
    why = F.when(F.col("extracted").isNull(), "no reply").when(~valid_json(F.col("extracted")), "the reply is no JSON").otherwise("keys are missing")
    return got.where(ok), got.where(~F.coalesce(ok, F.lit(False))).withColumn("error", why)


def dedup_spans(spans: list[tuple[str, int, int, float]], most: float = 0.01) -> list[int]:
    """Which of (document, start, end, score) stay, best first: one that overlaps a better one of its document by more than `most` goes."""
    kept: list[int] = []
    for i in sorted(range(len(spans)), key=lambda i: -spans[i][3]):
        d, a, b, _ = spans[i]
        if all(d != spans[j][0] or max(0, min(b, spans[j][2]) - max(a, spans[j][1])) <= most * min(max(1, b - a), max(1, spans[j][2] - spans[j][1])) for j in kept):
            kept.append(i)
    return sorted(kept)


def read_answers(df: DataFrame, model: str | Factory, top_k: int = 20, no_answer: bool = True, overlap: float = 0.01, threshold: float | None = None) -> DataFrame:
    """Extractive answers. df: query_id, query, id, content; the model gives (start, end, score) spans for (query, content) pairs.

    Returns query_id, id, answer, start, end, page, score: the best top_k without overlaps, then, with no_answer, a row without
    answer whose score is the product of one minus the others'. A query's retrieved candidates are handled together.
    """
    kind = df.schema["id"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        f = load(model)
        rows = [(i, a, b, s, t) for i, t, spans in zip(p["id"], p["content"], f(list(zip(p["query"], p["content"], strict=True))), strict=True) for a, b, s in spans]
        rows.sort(key=lambda r: -r[3])
        keep = dedup_spans([(str(r[0]), r[1], r[2], r[3]) for r in rows], overlap)
        rows = [rows[i] for i in keep]
        rows.sort(key=lambda r: -r[3])
        rows = rows[:top_k]
        q = p["query_id"].iloc[0]
        out = [(q, i, t[a:b], a, b, 1 + t[:a].count("\f"), float(s)) for i, a, b, s, t in rows]
        if no_answer:
            out.append((q, None, None, None, None, None, float(np.prod([1 - r[3] for r in rows]))))
        return pd.DataFrame([r for r in out if threshold is None or r[6] >= threshold], columns=["query_id", "id", "answer", "start", "end", "page", "score"]).astype({"start": "Int64", "end": "Int64", "page": "Int64"})

    return df.select("query_id", "query", "id", "content").groupBy("query_id").applyInPandas(run, f"query_id long, id {kind}, answer string, start long, end long, page long, score double")
