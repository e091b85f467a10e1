"""Readers of files as documents. Each takes binaryFile rows or paths; a file that can't be read gives a row with an error, not a failed job."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.errors import ModelUnavailable
from lexloom.functions.text import excel_column

OUT = "path string, content string, meta string, error string"


def read_binary(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """path, content (binary), length and modificationTime of each file."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def decode_rows(raw: DataFrame, encoding: str = "utf-8", store_full_path: bool = False) -> DataFrame:
    """binaryFile rows with their bytes as text. A column `encoding` names the encoding of a row; where it is null or missing the default holds."""
    name = F.col("path") if store_full_path else F.regexp_extract("path", "([^/]*)$", 1)
    how = F.coalesce(F.col("encoding"), F.lit(encoding)) if "encoding" in raw.columns else F.lit(encoding)
    rest = [c for c in raw.columns if c not in ("path", "content", "encoding", "length", "modificationTime")]
    return raw.select(name.alias("file_path"), F.call_function("decode", F.col("content"), how).alias("content"), *rest)


def read_text(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", store_full_path: bool = False) -> DataFrame:
    """Whole files as content, decoded by Spark itself. Files of several encodings: `decode_rows` over read_binary."""
    return decode_rows(read_binary(spark, path), encoding, store_full_path)


def convert(raw: DataFrame, function: Callable[[bytes, str], list[tuple[str, dict]]], store_full_path: bool = False, meta: dict | None = None) -> DataFrame:
    """Applies a reader of bytes to each file: rows of file_path, content, meta (JSON) and error.

    The meta of a document is what the caller gives for all files (`meta`), then for its own in a column `meta` (JSON), then what the reader finds.
    """
    own = F.col("meta") if "meta" in raw.columns else F.lit(None).cast("string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data, given in zip(p["path"], p["content"], p["meta"], strict=True):
                name = path if store_full_path else path.rpartition("/")[2]
                try:
                    more = {**(meta or {}), **(json.loads(given) if given else {})}
                    rows += [(name, t, json.dumps(more | m, sort_keys=True), None) for t, m in function(data, path)]
                except Exception as e:  # any broken file
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "meta", "error"])

    return raw.select("path", "content", own.alias("meta")).mapInPandas(run, OUT).withColumnRenamed("path", "file_path")


def good(converted: DataFrame) -> DataFrame:
    return converted.where("error is null").drop("error")


def bad(converted: DataFrame) -> DataFrame:
    return converted.where("error is not null").select("file_path", "error")


class _Text(html.parser.HTMLParser):
    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "form", "svg", "title"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "blockquote", "pre"}

    MAIN = {"article", "main"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.main: list[str] = []
        self.depth, self.title, self.in_title, self.inside = 0, "", False, 0

    def put(self, text: str) -> None:
        self.out.append(text)
        if self.inside:
            self.main.append(text)

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        self.inside += tag in self.MAIN
        self.in_title |= tag == "title"
        if tag in self.BLOCK:
            self.put("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.depth:
            self.depth -= 1
        if tag == "title":
            self.in_title = False
        if tag in self.BLOCK:
            self.put("\n")
        if tag in self.MAIN and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.put(data)


def html_text(source: str) -> tuple[str, str]:
    """(main text, title): that of its articles or main part if the page marks any with text, else of the whole page; menus, scripts and
    forms left out, one line for each block."""
    p = _Text()
    p.feed(source)
    p.close()
    main = "".join(p.main)
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in (main if main.strip() else "".join(p.out)).split("\n"))
    return "\n".join(x for x in lines if x), p.title.strip()


def marked_title(source: str) -> str:
    """What stands between the first plain title tags without a tag inside, with &lt;, &gt; and &amp; read, in this order, and no other reference."""
    m = re.search("<title>([^<]*)</title>", source)
    title = m[1] if m else ""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = title.replace(name, char)
    return title.strip(" ")


def html_reader(title: Callable[[str], str] | None = None):
    """Main text of a page, with its title as meta: the parser's, with all references read, or what `title` finds in the source."""

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        source = data.decode("utf-8", "replace")
        text, found = html_text(source)
        return [(text, {"title": title(source) if title else found})]

    return run


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html_text(x)[0], na_action="ignore")


def markdown_text(source: str, table_to_single_line: bool = False) -> str:
    """Markdown without its marks."""
    out, fence = [], False
    for line in source.splitlines():
        if line.lstrip().startswith("```"):
            fence = not fence
            continue
        if not fence:
            if re.match(r"\s*\|?\s*:?-{2,}", line) and "|" in line:
                continue
            if line.lstrip().startswith("|"):
                cells = [x.strip() for x in line.strip().strip("|").split("|")]
                out.append((", " if table_to_single_line else "\t").join(cells))
                continue
            line = re.sub(r"^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", line)
            line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"(\*\*|__|\*|_|`|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
        out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


_STEP = re.compile(r"\.(?:\[\]|\[(\d+)\]|([\w]+)|\[\"([^\"]+)\"\])?|\[\]|\[(\d+)\]")


def jq(value, path: str) -> list:
    """A subset of jq: .a.b, .a[], .a[0], joined by |."""
    now = [value]
    for part in path.split("|"):
        part, at = part.strip(), 0
        while at < len(part):
            m = _STEP.match(part, at)
            if not m or m.end() == at:
                raise ValueError(f"can't read {path!r}")
            key, num = m[2] or m[3], m[1] or m[4]
            if key:
                now = [v.get(key) if isinstance(v, dict) else None for v in now]
            elif num:
                now = [v[int(num)] if isinstance(v, list) and int(num) < len(v) else None for v in now]
            elif "[]" in m[0]:
                now = [x for v in now for x in (v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else [])]
            at = m.end()
    return now


def json_reader(jq_schema: str | None = None, content_key: str | None = None, extra_meta_fields: set[str] | str | None = None):
    """Objects of a JSON file: content_key gives the content, further fields the meta; what has no scalar content is left out."""
    if jq_schema is None and content_key is None:
        raise ValueError("a jq schema or a content key is needed")

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        value = json.loads(data)
        found = jq(value, jq_schema) if jq_schema else [value]
        out = []
        for o in found:
            text, meta = o, {}
            if content_key is not None:
                if not isinstance(o, dict) or content_key not in o:
                    continue
                text = o[content_key]
                keys = set(o) - {content_key} if extra_meta_fields == "*" else set(extra_meta_fields or ())
                meta = {k: o.get(k) for k in sorted(keys)}
            if isinstance(text, (dict, list)) or text is None:
                continue
            out.append((str(text), meta))
        return out

    return run


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def table_text(rows: list[list[str]], table_format: str = "csv") -> str:
    if table_format == "markdown":
        if not rows:
            return ""
        line = lambda r: "| " + " | ".join(x.replace("\n", " ") for x in r) + " |"
        return "\n".join([line(rows[0]), "|" + "|".join(" --- " for _ in rows[0]) + "|", *map(line, rows[1:])])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().rstrip("\n")


def docx_reader(table_format: str = "csv", link_format: str = "none"):
    """Paragraphs and tables of a Word file in order, page breaks as form feeds, core properties in meta."""

    def paragraph(p, links: dict[str, str]) -> str:
        out = []
        for e in p.iter():
            if e.tag == W + "t":
                out.append(e.text or "")
            elif e.tag == W + "tab":
                out.append("\t")
            elif e.tag == W + "br":
                out.append("\f" if e.get(W + "type") == "page" else "\n")
            elif e.tag == W + "hyperlink" and link_format != "none":
                text = "".join(t.text or "" for t in e.iter(W + "t"))
                url = links.get(e.get(R + "id") or "", "")
                out.append(f"[{text}]({url})" if link_format == "markdown" else f"{text} ({url})")
                for t in e.iter(W + "t"):
                    t.text = ""
        return "".join(out)

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
            links = {}
            if "word/_rels/document.xml.rels" in names:
                links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
            meta = {e.tag.rpartition("}")[2]: e.text for e in ET.fromstring(z.read("docProps/core.xml"))} if "docProps/core.xml" in names else {}
        out = []
        for e in body:
            if e.tag == W + "p":
                out.append(paragraph(e, links))
            elif e.tag == W + "tbl":
                out.append(table_text([["\n".join(paragraph(p, links) for p in c.iter(W + "p")) for c in r.iter(W + "tc")] for r in e.iter(W + "tr")], table_format))
        return [("\n".join(out), {"docx": meta})]

    return run


def pptx_reader(data: bytes, _: str) -> list[tuple[str, dict]]:
    """Texts of shapes by line, slides by form feed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        pages = []
        for n in slides:
            root = ET.fromstring(z.read(n))
            pages.append("\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in root.iter(A + "p")))
    return [("\f".join(pages), {})]


def xlsx_reader(table_format: str = "csv", sheet_name: str | None = None):
    """One document for each sheet, with row numbers and column letters."""

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = []
            for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
                if sheet_name is not None and sheet.get("name") != sheet_name:
                    continue
                cells: dict[tuple[int, int], str] = {}
                for c in ET.fromstring(z.read("xl/" + rels[sheet.get(R + "id")].removeprefix("/xl/"))).iter(S + "c"):
                    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    col = 0
                    for ch in letters:
                        col = col * 26 + ord(ch) - 64
                    v = c.find(S + "v")
                    text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "")
                    cells[int(row), col] = text or ""
                rows, cols = max((r for r, _ in cells), default=0), max((k for _, k in cells), default=0)
                table = [["", *map(excel_column, range(cols))]] + [[str(r), *[cells.get((r, k), "") for k in range(1, cols + 1)]] for r in range(1, rows + 1)]
                out.append((table_text(table, table_format), {"xlsx": {"sheet_name": sheet.get("name")}}))
        return out

    return run


def eml_reader(data: bytes, path: str) -> list[tuple[str, dict]]:
    """Headers and body of a message; each attachment is a further row with parent_file_path."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(text)[0]
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Subject", "Date") if m[k])
    out = [(f"{head}\n\n{text}".strip(), {"kind": "message"})]
    for a in m.iter_attachments():
        c = a.get_content()
        out.append((c if isinstance(c, str) else c.hex(), {"kind": "attachment", "name": a.get_filename(), "parent_file_path": path}))
    return out


def optional_reader(package: str, function: Callable[[object, bytes], list[tuple[str, dict]]]):
    """A reader that needs a package which may be missing; then every file gets an error that names it."""

    def run(data: bytes, _: str) -> list[tuple[str, dict]]:
        import importlib

        try:
            module = importlib.import_module(package)
        except ImportError as e:
            raise ModelUnavailable(f"reading these files needs the package {package}") from e
        return function(module, data)

    return run


def _pdf(pypdf, data: bytes) -> list[tuple[str, dict]]:
    pages = [p.extract_text() for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    text = "\f".join(pages)
    lost = len(re.findall(r"\(cid:\d+\)", text))
    return [(text, {"undecoded_glyphs": lost} if lost else {})]


def _pdfminer(module, data: bytes) -> list[tuple[str, dict]]:
    import importlib

    text = importlib.import_module("pdfminer.high_level").extract_text(io.BytesIO(data))
    lost = len(re.findall(r"\(cid:\d+\)", text))
    return [(text, {"undecoded_glyphs": lost, "undecoded_share": lost / max(1, len(text))})]


def _whisper(module, data: bytes) -> list[tuple[str, dict]]:
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".audio") as f:
        f.write(data)
        f.flush()
        got = module.load_model("large").transcribe(f.name)
    return [(got.pop("text"), {k: v for k, v in got.items() if isinstance(v, (str, int, float))})]


def _msg(oxmsg, data: bytes) -> list[tuple[str, dict]]:
    """An Outlook message as head and body; attachments as further rows. An encrypted one is an error."""
    m = oxmsg.Message.load(io.BytesIO(data))
    if "encrypted" in str(m.message_headers.get("Content-Type", "")):
        raise ValueError("the message is encrypted")
    to = ", ".join(f"{r.name} <{r.email_address}>" for r in m.recipients)
    head = "\n".join(f"{k}: {v}" for k, v in (("From", m.sender), ("To", to), ("Cc", m.message_headers.get("CC")), ("Bcc", m.message_headers.get("BCC")), ("Subject", m.subject)) if v)
    out = [(f"{head}\n\n{m.body or ''}".strip(), {"kind": "message"})]
    return out + [(a.file_bytes.hex(), {"kind": "attachment", "name": a.file_name}) for a in m.attachments]


READERS = {
    "txt": lambda data, _: [(data.decode("utf-8"), {})], "csv": lambda data, _: [(data.decode("utf-8"), {})],
    "html": html_reader(), "md": lambda data, _: [(markdown_text(data.decode("utf-8")), {})],
    "docx": docx_reader(), "pptx": pptx_reader, "xlsx": xlsx_reader(), "eml": eml_reader,
    "pdf": optional_reader("pypdf", _pdf), "pdfminer": optional_reader("pdfminer", _pdfminer), "audio": optional_reader("whisper", _whisper), "msg": optional_reader("oxmsg", _msg),
}


def ocr_documents(response: dict, context: int = 3) -> list[tuple[str, dict]]:
    """Documents of an OCR service's analysis: each table as CSV with the lines before and after, then the text, pages by form feed."""
    out, taken = [], []
    lines = [line["content"] for page in response.get("pages", []) for line in page.get("lines", [])]
    for table in response.get("tables", []):
        grid = [[""] * table["columnCount"] for _ in range(table["rowCount"])]
        for c in table["cells"]:
            for i in range(c["rowIndex"], c["rowIndex"] + c.get("rowSpan", 1)):
                for j in range(c["columnIndex"], c["columnIndex"] + c.get("columnSpan", 1)):
                    grid[i][j] = c.get("content", "")
        inside = {x for r in grid for x in r}
        at = [i for i, x in enumerate(lines) if x in inside]
        before, after = (lines[max(0, at[0] - context) : at[0]], lines[at[-1] + 1 : at[-1] + 1 + context]) if at else ([], [])
        taken += at
        out.append((table_text(grid), {"preceding_context": "\n".join(before), "following_context": "\n".join(after), "page": (table.get("boundingRegions") or [{}])[0].get("pageNumber")}))
    gone = set(taken)
    pages, i = [], 0
    for page in response.get("pages", []):
        own = []
        for line in page.get("lines", []):
            if i not in gone:
                own.append(line["content"])
            i += 1
        pages.append("\n".join(own))
    return [*out, ("\f".join(pages), {})]


def single_column(lines: list[tuple[float, float, str]], threshold_y: float = 0.05) -> list[str]:
    """Lines (x, y, text) read across columns: those within threshold_y of their row's first share a row, from left to right."""
    rows: list[list[tuple[float, float, str]]] = []
    for line in sorted(lines, key=lambda x: (x[1], x[0])):
        if rows and abs(rows[-1][-1][1] - line[1]) <= threshold_y:
            rows[-1].append(line)
        else:
            rows.append([line])
    return [" ".join(t for _, _, t in sorted(r)) for r in rows]


def openapi_functions(spec: dict) -> list[dict]:
    """Function-calling schemas of an OpenAPI specification's operations."""

    def resolve(x):
        while isinstance(x, dict) and "$ref" in x:
            at = spec
            for p in x["$ref"].lstrip("#/").split("/"):
                at = at[p]
            x = at
        if isinstance(x, dict):
            return {k: resolve(v) for k, v in x.items()}
        return [resolve(v) for v in x] if isinstance(x, list) else x

    out = []
    for methods in spec.get("paths", {}).values():
        for op in methods.values():
            if not isinstance(op, dict) or "operationId" not in op:
                continue
            props, need = {}, []
            for p in resolve(op.get("parameters", [])):
                props[p["name"]] = {**p.get("schema", {}), **({"description": p["description"]} if "description" in p else {})}
                need += [p["name"]] if p.get("required") else []
            body = resolve(op.get("requestBody", {})).get("content", {}).get("application/json", {}).get("schema", {})
            props |= body.get("properties", {})
            need += body.get("required", [])
            text = op.get("description") or op.get("summary") or ""
            if text and props:
                out.append({"name": op["operationId"], "description": text, "parameters": {"type": "object", "properties": props, **({"required": need} if need else {})}})
    return out
