"""Rows from web services: pages by url, search results and REST operations, over a transport that tests replace."""

from __future__ import annotations

import fnmatch
import html.parser
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.secrets import Secret, value_of

#: (url, method, headers, body, timeout) -> (status, content type, body)
Transport = Callable[[str, str, dict, bytes | None, float], tuple[int, str, bytes]]
AGENTS = ("Mozilla/5.0 (compatible; lexloom)", "Mozilla/5.0 (X11; Linux x86_64; lexloom)")


def http(url: str, method: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, str, bytes]:
    req = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return r.status, r.headers.get_content_type(), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get_content_type(), e.read()


def http_lines(url: str, headers: dict, body: bytes, timeout: float = 60.0) -> Iterator[bytes]:
    """The lines of an answer as they arrive."""
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as r:
        yield from r


def request(transport: Transport, url: str, method: str = "GET", headers: dict | None = None, body: bytes | None = None, retries: int = 2, timeout: float = 3.0, pause: float = 2.0) -> tuple[int, str, bytes]:
    """One request, repeated with growing pauses (2 to 10 seconds) on failures that may pass."""
    for i in range(retries + 1):
        try:
            got = transport(url, method, {"User-Agent": AGENTS[i % len(AGENTS)], **(headers or {})}, body, timeout)
            if got[0] < 400 or got[0] not in (408, 418, 429, 500, 502, 503, 504) or i == retries:
                return got
        except OSError:
            if i == retries:
                raise
        time.sleep(min(10.0, pause * 2**i) * (0.5 + random.random() / 2) if pause else 0)
    raise RuntimeError("unreachable")


#: Content types that are text, by pattern; others stay binary.
TEXT_TYPES = ("text/*", "application/json", "application/xml", "application/xhtml+xml")


def fetch(urls: DataFrame, url: str = "url", transport: Transport = http, retries: int = 2, timeout: float = 3.0, pause: float = 2.0, raise_on_failure: bool = False) -> DataFrame:
    """Adds status, content_type, text, data and error to each url; a failure is a row, unless asked to raise."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for u in p[url]:
                try:
                    status, kind, body = request(transport, u, retries=retries, timeout=timeout, pause=pause)
                    if status >= 400:
                        raise OSError(f"status {status}")
                    is_text = any(fnmatch.fnmatch(kind, t) for t in TEXT_TYPES)
                    rows.append((status, kind, body.decode("utf-8", "replace") if is_text else None, None if is_text else body, None))
                except Exception as e:
                    if raise_on_failure:
                        raise
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.concat([p.reset_index(drop=True), pd.DataFrame(rows, columns=["status", "content_type", "text", "data", "error"]).astype({"status": "Int32"})], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInPandas(run, ddl + ", status int, content_type string, text string, data binary, error string")


def search_results(kind: str, answer: dict, top_k: int | None = 10) -> list[tuple[str, str, str]]:
    """(title, content, link) of a search service's answer: answer box, knowledge, results, then related questions."""
    rows = []
    if kind == "serper":
        box = answer.get("answerBox")
        if box:
            text = box.get("answer") or box.get("snippet") or ""
            rows.append((box.get("title", ""), " ".join(text) if isinstance(text, list) else text, box.get("link", "")))
        rows += [(x.get("title", ""), x.get("snippet", ""), x.get("link", "")) for x in answer.get("organic", [])]
        rows += [(x.get("title") or x.get("question", ""), x.get("snippet", ""), x.get("link", "")) for x in answer.get("peopleAlsoAsk", [])]
    elif kind == "searchapi":
        for key in ("answer_box", "knowledge_graph"):
            box = answer.get(key)
            if box:
                rows.append((box.get("title", ""), box.get("answer") or box.get("snippet") or box.get("description", ""), box.get("link", "")))
        rows += [(x.get("title", ""), x.get("snippet", ""), x.get("link", "")) for x in answer.get("organic_results", [])]
        rows += [(x.get("question", ""), x.get("answer", ""), (x.get("source") or {}).get("link", "")) for x in answer.get("related_questions", [])]
    else:
        raise ValueError(f"unknown search service {kind!r}")
    return rows[:top_k]


ENDPOINTS = {"serper": ("https://google.serper.dev/search", "POST"), "searchapi": ("https://www.searchapi.io/api/v1/search", "GET")}


def web_search(queries: DataFrame, kind: str, api_key: str | Secret, query: str = "query", top_k: int | None = 10, allowed_domains: Sequence[str] = (), transport: Transport = http) -> DataFrame:
    """query_id, rank, title, content, link of each query's results. Domains become site: terms."""
    address, method = ENDPOINTS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for qid, text in zip(p["query_id"], p[query], strict=True):
                text = (" OR ".join(f"site:{d}" for d in allowed_domains) + " " if allowed_domains else "") + text
                if method == "POST":
                    got = request(transport, address, "POST", {"X-API-KEY": value_of(api_key), "Content-Type": "application/json"}, json.dumps({"q": text, "num": top_k}).encode())
                else:
                    got = request(transport, f"{address}?{urllib.parse.urlencode({'q': text, 'engine': 'google'})}", "GET", {"Authorization": f"Bearer {value_of(api_key)}"})
                if got[0] >= 400:
                    raise OSError(f"the search service answers {got[0]}")
                rows += [(qid, i, *r) for i, r in enumerate(search_results(kind, json.loads(got[2]), top_k))]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "title", "content", "link"])

    return queries.select("query_id", query).mapInPandas(run, "query_id long, rank long, title string, content string, link string")


def call_operation(spec: dict, operation_id: str, arguments: dict, transport: Transport = http, headers: dict | None = None) -> dict:
    """Invokes one operation of an OpenAPI specification: path and query parameters and the JSON body from the arguments."""
    for path, methods in spec["paths"].items():
        for method, op in methods.items():
            if isinstance(op, dict) and op.get("operationId") == operation_id:
                rest, query = dict(arguments), {}
                for p in op.get("parameters", []):
                    if p["name"] not in rest:
                        if p.get("required"):
                            raise ValueError(f"{operation_id} needs {p['name']!r}")
                        continue
                    v = rest.pop(p["name"])
                    if p["in"] == "path":
                        path = path.replace("{" + p["name"] + "}", urllib.parse.quote(str(v), safe=""))
                    elif p["in"] == "query":
                        query[p["name"]] = v
                    elif p["in"] == "header":
                        headers = {**(headers or {}), p["name"]: str(v)}
                url = spec["servers"][0]["url"].rstrip("/") + path + ("?" + urllib.parse.urlencode(query) if query else "")
                body = json.dumps(rest).encode() if "requestBody" in op else None
                status, _, data = request(transport, url, method.upper(), {"Content-Type": "application/json", **(headers or {})}, body)
                if status >= 400:
                    raise OSError(f"{operation_id} answers {status}")
                return json.loads(data) if data else {}
    raise ValueError(f"no operation {operation_id!r}")


def call_operations(calls: DataFrame, spec: dict, transport: Transport = http, headers: dict | None = None) -> DataFrame:
    """Adds response (JSON) and error to rows of operation_id and arguments (JSON)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for op, args in zip(p["operation_id"], p["arguments"], strict=True):
                try:
                    got.append((json.dumps(call_operation(spec, op, json.loads(args or "{}"), transport, headers)), None))
                except Exception as e:
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield pd.concat([p.reset_index(drop=True), pd.DataFrame(got, columns=["response", "error"])], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields)
    return calls.mapInPandas(run, ddl + ", response string, error string")


def tool_calls(messages: DataFrame, column: str = "messages") -> DataFrame:
    """The calls in each row's last assistant message, as operation_id and arguments."""
    last = F.element_at(F.filter(column, lambda m: m["role"] == "assistant"), -1)
    parts = F.filter(last["content"], lambda c: c["kind"] == "tool_call")
    return messages.select("*", F.explode(parts).alias("__c")).select(*messages.columns, F.col("__c.tool_call.tool_name").alias("operation_id"), F.col("__c.tool_call.arguments").alias("arguments"), F.col("__c.tool_call.id").alias("call_id"))


def transcriber(url: str, api_key: str | Secret, model: str = "whisper-1", transport: Transport = http, **options: str) -> Callable[[bytes, str], list[tuple[str, dict]]]:
    """A reader of audio files (see files.convert) over a transcription service: the text, with the file's name as meta."""

    def run(data: bytes, path: str) -> list[tuple[str, dict]]:
        name, edge = path.rpartition("/")[2] or "audio.wav", uuid.uuid4().hex
        head = "".join(f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in {"model": model, "response_format": "json", **options}.items())
        head += f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = head.encode() + data + f"\r\n--{edge}--\r\n".encode()
        status, _, got = request(transport, url, "POST", {"Authorization": f"Bearer {value_of(api_key)}", "Content-Type": f"multipart/form-data; boundary={edge}"}, body, timeout=60.0)
        if status >= 400:
            raise OSError(f"the transcription service answers {status}")
        return [(json.loads(got)["text"], {"audio_file": name})]

    return run


def text_service(url: str = "http://localhost:9998/tika", transport: Transport = http) -> Callable[[bytes, str], list[tuple[str, dict]]]:
    """A reader of any file over a text extraction server that answers in XHTML with a div of class page for each page.

    Pages are joined by form feeds, words broken at line ends are joined.
    """

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        status, _, got = request(transport, url, "PUT", {"Accept": "text/html"}, data, timeout=60.0)
        if status >= 400:
            raise OSError(f"the text extraction server answers {status}")
        p = _Pages()
        p.feed(got.decode("utf-8", "replace"))
        p.close()
        pages = [x.strip() for x in ("".join(page) for page in p.pages)] if p.pages else ["".join(p.rest).strip()]
        return [("\f".join(re.sub(r"-\n(?=\w)", "", x) for x in pages), {})]

    return run


class _Pages(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pages: list[list[str]] = []
        self.rest: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag == "div"
        elif tag == "div" and ("class", "page") in attrs:
            self.pages.append([])
            self.depth = 1

    def handle_endtag(self, tag):
        self.depth -= bool(self.depth) and tag == "div"

    def handle_data(self, data):
        (self.pages[-1] if self.depth else self.rest).append(data)
