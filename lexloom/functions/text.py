"""Column expressions over text: tokens, cleaning, units, windows, and small scalar functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]{2,}"
DELIMITERS = {"page": "\f", "passage": "\n\n", "period": ".", "word": " ", "line": "\n"}


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def normalize_unicode(form: str, ascii_only: bool = False):
    """An Arrow function for NFC, NFKC, NFD or NFKD, which Spark has no expression for; ascii_only drops the rest after NFKD."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if t is None:
                return None
            t = unicodedata.normalize(form, t) if form else t
            return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() if ascii_only else t

        for s in parts:
            yield s.map(one, na_action="ignore")

    return run


def _per_page(text: Column, f) -> Column:
    return F.array_join(F.transform(F.split(text, "\f"), f), "\f")


def strip(text: Column) -> Column:
    """Without white space at the ends, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze_spaces(text: Column) -> Column:
    """Runs of two or more white spaces become a blank, page by page."""
    return _per_page(text, lambda p: strip(F.regexp_replace(p, r"(?U)\s\s+", " ")))


def drop_empty_lines(text: Column) -> Column:
    return _per_page(text, lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: x.rlike(r"(?U)\S")), "\n"))


def drop_substrings(text: Column, subs: Sequence[str]) -> Column:
    for s in subs:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def drop_regex(text: Column, pattern: str) -> Column:
    return _per_page(text, lambda p: strip(F.regexp_replace(p, pattern, "")))


def shared_run(texts: list[str], least: int = 3, most: int = 29) -> str:
    """The longest run of `least` to `most` words, white space between them included, that all texts hold; "" where there is none."""

    def runs(t: str) -> dict[int, set[str]]:
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        return {n: {t[at[i][0] : at[i + n - 1][1]] for i in range(len(at) - n + 1)} for n in range(least, most + 1)}

    held = [runs(t) for t in texts]
    both = [set.intersection(*[h[n] for h in held]) for n in range(least, most + 1)] if held else []
    return max(sorted(set().union(*both)), key=len, default="")


def without_edges(text: str, chars: int = 300) -> str:
    """A text without the header and footer of its pages: what the first, then the last `chars` characters of all pages but the first and the last share.

    They go from every page: a run that begins a page with the white space after it, of which one blank stays, any other with that before it.
    """
    pages = text.split("\f")
    for part in (slice(None, chars), slice(-chars, None)):
        found = re.escape(shared_run([p[part] for p in pages[1:-1] if p]))
        if found:
            cut = re.compile(rf"^(?:{found})(\s)?\s*|\s*{found}")
            pages = [cut.sub(lambda m: " " if m[1] else "", p) for p in pages]
    return "\f".join(pages)


@F.pandas_udf(T.StringType())
def drop_repeated_edges(texts: pd.Series) -> pd.Series:
    """Headers and footers that inner pages share are cut from every page."""
    return texts.map(without_edges, na_action="ignore")


def clean(text: Column, spaces: bool = True, empty_lines: bool = True, substrings: Sequence[str] = (), regex: str | None = None, repeated: bool = False, unicode_form: str | None = None, ascii_only: bool = False) -> Column:
    """The document cleaner: normal form, ASCII, white space, empty lines, substrings, pattern, then headers and footers."""
    if unicode_form or ascii_only:
        text = normalize_unicode(unicode_form or "", ascii_only)(text)
    if spaces:
        text = squeeze_spaces(text)
    if empty_lines:
        text = drop_empty_lines(text)
    text = drop_substrings(text, substrings)
    if regex:
        text = drop_regex(text, regex)
    return drop_repeated_edges(text) if repeated else text


def clean_answers(text: Column, regexes: Sequence[str] = (), lower: bool = False, punctuation: bool = False, numbers: bool = False) -> Column:
    """The text cleaner used before comparisons: patterns without regard to case, case, punctuation and digits."""
    if regexes:
        text = F.regexp_replace(text, "(?i)" + "|".join(f"(?:{r})" for r in regexes), "")
    if lower:
        text = F.lower(text)
    drop = ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if punctuation else "") + ("0123456789" if numbers else "")
    return F.translate(text, drop, "") if drop else text


def window_bounds(n: int, length: int, overlap: int, threshold: int = 0) -> list[tuple[int, int]]:
    """First and end of each window over n units; a tail of fewer than `threshold` units joins its predecessor."""
    if not 0 <= overlap < length:
        raise ValueError("overlap must be less than the length")
    step = length - overlap
    out = [(i, min(n, i + length)) for i in range(0, max(1, n - overlap), step)] if n else []
    if len(out) > 1 and out[-1][1] - out[-1][0] < threshold:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out


#: Characters and rows of input whose chunks a task holds at once.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 256


def slices(p: pd.DataFrame, content: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most SLICE_CHARS characters of content, or one row, and at most SLICE_ROWS: what is made of a batch need not be held whole."""
    begin, held = 0, 0
    for i, n in enumerate(p[content].map(len, na_action="ignore").fillna(0).astype(int).tolist()):
        if i > begin and (held + n > SLICE_CHARS or i - begin >= SLICE_ROWS):
            yield p.iloc[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(p):
        yield p.iloc[begin:]


OVERLAP = "array<struct<split_id: int, start: int, end: int>>"


def overlap_ranges(bounds: list[tuple[int, int]]) -> list[list[dict]]:
    """For chunks at these places of a text, the neighbours that share characters with each, and the shared range in the neighbour."""
    out: list[list[dict]] = [[] for _ in bounds]
    for k in range(1, len(bounds)):
        (a, b), (c, _) = bounds[k - 1], bounds[k]
        if c < b:
            out[k].insert(0, {"split_id": k - 1, "start": c - a, "end": b - a})
            out[k - 1].append({"split_id": k, "start": 0, "end": b - c})
    return out


def split_documents(df: DataFrame, by: str, length: int, overlap: int = 0, threshold: int = 0, content: str = "content", source: str = "id", function=None) -> DataFrame:
    """Chunks of each document: source_id, split_id, content, split_idx_start, page_number, overlap_prev (characters shared with the
    chunk before) and split_overlap. `function` (text to units) replaces the delimiter.

    split_overlap names the neighbours that share text with a chunk, by split_id, and the range of characters that is shared in
    the neighbour's content. Where a function drops text between units, starts count the units alone. Empty and null contents give no chunks. Rows are split where they are, in one pass over each text; array expressions
    would build every chunk's offset from the start of its text again.
    """
    window_bounds(1, length, overlap)
    made = ("source_id", "split_id", "split_idx_start", "page_number", "overlap_prev", "split_overlap")
    rest = [c for c in df.columns if c not in (content, *made)]
    src = df.where(F.length(content) > 0).select(*rest, F.col(source).alias("source_id"), F.col(content))
    d = DELIMITERS.get(by, "")
    if not d and function is None:
        raise ValueError(f"unknown unit {by!r}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for batch in parts for x in slices(batch, content)):
            at: list[int] = []
            out: dict[str, list] = {k: [] for k in ("split_id", content, "split_idx_start", "page_number", "overlap_prev", "split_overlap")}
            for i, text in enumerate(p[content]):
                if function is not None:
                    u = function(text)
                else:
                    u = text.split(d)
                    u[:-1] = [x + d for x in u[:-1]]
                start = [0]
                for x in u:
                    start.append(start[-1] + len(x))
                pages, seen, end = 1, 0, 0
                bounds = [(start[a], start[b]) for a, b in window_bounds(len(u), length, overlap, threshold)]
                shared = overlap_ranges(bounds)
                for k, ((a, b), (lo, hi)) in enumerate(zip(window_bounds(len(u), length, overlap, threshold), bounds, strict=True)):
                    pages, seen = pages + text.count("\f", seen, lo), lo
                    for c, v in zip(out.values(), (k, "".join(u[a:b]), lo, pages, max(0, end - lo), shared[k]), strict=True):
                        c.append(v)
                    end = hi
                    at.append(i)
            yield pd.concat([p[[*rest, "source_id"]].iloc[at].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in [*rest, "source_id"]] + [f"split_id int, `{content}` string, split_idx_start int, page_number int, overlap_prev int, split_overlap {OVERLAP}"])
    return src.mapInPandas(run, ddl)


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def expand_ranges(pages: Sequence[str | int]) -> list[int]:
    """["1-3", 5] is [1, 2, 3, 5]."""
    out: list[int] = []
    for p in pages:
        lo, dash, hi = str(p).partition("-")
        out += range(int(lo), int(hi) + 1) if dash else [int(lo)]
    if not out:
        raise ValueError("no pages given")
    return out


def excel_column(i: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


MIME = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".msg": "application/vnd.ms-outlook", ".csv": "text/csv", ".json": "application/json", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".jpg": "image/jpeg", ".png": "image/png", ".xml": "application/xml", ".yml": "application/yaml", ".yaml": "application/yaml"}


def mime_type(path: Column) -> Column:
    """By extension, null where unknown."""
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./?#]+)(?:[?#].*)?$", 1)))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_keys_present(text: Column, keys: Sequence[str]) -> Column:
    """True where text is a JSON object with all keys."""
    have = F.json_object_keys(F.when(valid_json(text), text))
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), have)) == 0, F.lit(False))


def now_formatted(zone: str = "UTC", fmt: str = "yyyy-MM-dd HH:mm:ss", **offset: int) -> Column:
    """The time of the query in a zone, moved by an offset such as days=1, as text."""
    at = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.current_timestamp().cast("timestamp_ntz"))
    for unit, n in offset.items():
        at = F.timestamp_add(unit.rstrip("s").upper(), F.lit(n), at)
    return F.date_format(at, fmt)
