"""Chunkers that need more than a delimiter: sentences, recursion, hierarchies and tables in CSV text."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import OVERLAP, overlap_ranges, slices, window_bounds

ABBREVIATIONS = {"en": "mr mrs ms dr prof st vs etc inc ltd e.g i.e fig no jr sr approx dept est".split(), "de": "z.b d.h u.a bzw ca dr hr fr nr str usw vgl evtl ggf".split()}


def sentence_spans(text: str, language: str = "en") -> list[tuple[int, int]]:
    """Starts and ends of sentences; the white space after one belongs to it. No end inside quotes, after numbering or abbreviations, or before a bracket."""
    short = set(ABBREVIATIONS.get(language, ()))
    out, begin, quoted = [], 0, False
    for m in re.finditer(r"[\"“”«»]|[.!?…]+[\"'”»)\]]*(?=\s|$)", text):
        if m[0][0] in "\"“”«»":
            quoted = not quoted if m[0] == '"' else m[0] in "“«"
            continue
        if m[0][-1] in "\"”»":
            quoted = False
        elif quoted and '"' in text[m.end() : m.end() + 200]:
            continue
        before = re.search(r"(\S+)$", text[begin : m.start()])
        word = before[1].lower().strip("(\"'") if before else ""
        if m[0][0] == "." and (word in short or re.fullmatch(r"\d{1,3}", word) and before.start() == 0 or re.fullmatch(r"[a-z]", word)):
            continue
        end = m.end() + len(re.match(r"\s*", text[m.end() :])[0])
        if end < len(text) and text[end] in "([" and not text[m.end() : end].count("\n"):
            continue
        out.append((begin, end))
        begin = end
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def sentences(text: str, language: str = "en") -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text, language)]


def pack_sentences(text: str, length: int, overlap: int = 0, language: str = "en") -> list[str]:
    """Whole sentences up to `length` words a chunk; whole sentences of up to `overlap` words repeat."""
    parts, chunks = sentences(text, language), []
    now: list[str] = []
    n = lambda s: len(s.split())
    for s in parts:
        if now and sum(map(n, now)) + n(s) > length:
            chunks.append("".join(now))
            keep: list[str] = []
            for x in reversed(now[1:]):
                if sum(map(n, keep)) + n(x) > overlap:
                    break
                keep.insert(0, x)
            now = keep
        now.append(s)
    return [*chunks, "".join(now)] if now else chunks


def units_of(text: str, unit: str, encode: Callable[[str], list[int]] | None = None, decode: Callable[[list[int]], str] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, weight) of the words (form feeds are words), characters or tokens of a text. Tokens that end inside a character count with it."""
    if unit == "word":
        return [(m.start(), m.end(), 1) for m in re.finditer(r"\f|[^\s]+", text)]
    if unit == "char":
        return [(i, i + 1, 1) for i in range(len(text))]
    out, held, at = [], [], 0
    for token in encode(text):
        held.append(token)
        piece = decode(held)
        if text.startswith(piece, at):
            out.append((at, at + len(piece), len(held)))
            at, held = at + len(piece), []
    return out


def recursive_spans(text: str, length: int, separators: Sequence[str] = ("\n\n", "sentence", "\n", " "), unit: str = "word", overlap: int = 0, size: Callable[[str], int] | None = None, language: str = "en", encode: Callable[[str], list[int]] | None = None, decode: Callable[[list[int]], str] | None = None) -> list[tuple[int, int]]:
    """Bounds of chunks of at most `length` words, characters or tokens. A text is cut at its first separator and pieces are packed; a longer
    piece goes to the next separator, at last to fixed lengths.

    With an overlap a chunk begins `overlap` units before the end of the one before, ends where its own packed pieces end, or earlier
    where it would be too long; what is left begins the next. `size` counts the units of a piece in another way; tokens take
    encode and decode.
    """
    if length < 1 or not 0 <= overlap < length:
        raise ValueError("the length is at least 1, the overlap at least 0 and less than the length")
    if not all(isinstance(x, str) for x in separators):
        raise ValueError("separators are strings")
    if unit not in ("word", "char", "token") or unit == "token" and (encode is None or decode is None):
        raise ValueError("units are words, characters, or tokens with functions that encode and decode")
    count = size or (len if unit == "char" else (lambda t: len(encode(t))) if unit == "token" else lambda t: len(re.findall(r"\f|[^\s]+", t)))

    def fixed(a: int, b: int) -> list[tuple[int, int]]:
        cuts, held = [a], 0
        for lo, _, n in units_of(text[a:b], unit, encode, decode):
            if held and held + n > length:
                cuts.append(a + lo)
                held = 0
            held += n
        return list(zip(cuts, [*cuts[1:], b], strict=True))

    def pieces(a: int, b: int, separator: str) -> list[tuple[int, int]]:
        if separator == "sentence":
            return [(a + x, a + y) for x, y in sentence_spans(text[a:b], language)]
        ends = [a + m.end() for m in re.finditer(re.escape(separator), text[a:b])]
        ends += [b] if not ends or ends[-1] < b else []
        return list(zip([a, *ends[:-1]], ends, strict=True))

    def cut(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if count(text[a:b]) <= length:
            return [(a, b)] if a < b else []
        if level == len(separators):
            return fixed(a, b)
        out, begin = [], a
        for lo, hi in pieces(a, b, separators[level]):
            if count(text[begin:hi]) <= length:
                continue  # goes on with what is packed
            if begin < lo:
                out.append((begin, lo))
            begin = lo
            if count(text[lo:hi]) > length:
                out += cut(lo, hi, level + 1)
                begin = hi
        return [*out, (begin, b)] if begin < b else out

    base = cut(0, len(text), 0)
    if not overlap or len(base) < 2:
        return base
    units = units_of(text, unit, encode, decode)
    starts, total = [u[0] for u in units], [0]
    for _, _, n in units:
        total.append(total[-1] + n)
    ends = [bisect_left(starts, b) for _, b in base]  # units before the end of each packed chunk
    out, first, last, k = [base[0]], 0, ends[0], 0
    while last < len(units):
        k = min(k + 1, len(base) - 1)
        first = max(first, bisect_left(total, total[last] - overlap))
        end = min(ends[k], bisect_right(total, total[first] + length) - 1)
        if end <= last:  # a unit of several tokens may be longer than the rest
            first, end = last, last + 1
        at_end = end == len(units) or end in ends[: k + 1]
        out.append((starts[first], base[ends.index(end)][1] if at_end and end in ends else units[end - 1][1]))
        last = end
    return out


def recursive_chunks(text: str, length: int, separators: Sequence[str] = ("\n\n", "sentence", "\n", " "), unit: str = "word", overlap: int = 0, **options) -> list[str]:
    """The texts of recursive_spans."""
    return [text[a:b] for a, b in recursive_spans(text, length, separators, unit, overlap, **options)]


def split_recursively(df: DataFrame, length: int, content: str = "content", source: str = "id", **options) -> DataFrame:
    """Chunks of recursive_spans: source_id, split_id, content, split_idx_start, page_number and split_overlap, in one pass over each text.

    A chunk stands on the page of its last character, form feeds at its end left aside. Empty and null contents give no chunks.
    """
    recursive_spans("", length, **options)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for batch in parts for x in slices(batch, "t")):
            rows = []
            for s, t in zip(p["s"], p["t"], strict=True):
                spans = recursive_spans(t, length, **options)
                for i, ((a, b), near) in enumerate(zip(spans, overlap_ranges(spans), strict=True)):
                    c = t[a:b]
                    rows.append((s, i, c, a, 1 + t.count("\f", 0, a + len(c.rstrip("\f"))), near))
            yield pd.DataFrame(rows, columns=["source_id", "split_id", content, "split_idx_start", "page_number", "split_overlap"])

    src = df.where(F.length(content) > 0).select(F.col(source).alias("s"), F.col(content).alias("t"))
    return src.mapInPandas(run, f"source_id {src.schema['s'].dataType.simpleString()}, split_id int, `{content}` string, split_idx_start int, page_number int, split_overlap {OVERLAP}")


def explode_chunks(df: DataFrame, function: Callable[[str], list[str]], content: str = "content", source: str = "id") -> DataFrame:
    """source_id, split_id and content of the chunks that a function makes of each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for batch in parts for x in slices(batch, "t")):
            rows = [(s, i, c) for s, t in zip(p["s"], p["t"], strict=True) for i, c in enumerate(function(t))]
            yield pd.DataFrame(rows, columns=["source_id", "split_id", content])

    src = df.where(F.length(content) > 0).select(F.col(source).alias("s"), F.col(content).alias("t"))
    return src.mapInPandas(run, f"source_id {src.schema['s'].dataType.simpleString()}, split_id int, `{content}` string")


def hierarchy(text: str, sizes: Sequence[int], root: str, overlap: int = 0) -> list[tuple]:
    """(id, parent_id, level, block_size, n_children, content) of a text and its splits into ever smaller blocks of words.

    A level that would give a node one child alone is skipped for it.
    """
    sizes = sorted(set(sizes), reverse=True)
    nodes = [[root, None, 0, 0, 0, text]]
    now = [0]
    for level, n in enumerate(sizes, 1):
        nxt = []
        for at in now:
            u = nodes[at][5].split(" ")
            u[:-1] = [x + " " for x in u[:-1]]
            bounds = window_bounds(len(u), n, overlap)
            if len(bounds) < 2:
                nxt.append(at)
                continue
            nodes[at][4] = len(bounds)
            for i, (a, b) in enumerate(bounds):
                ident = hashlib.sha256(f"{nodes[at][0]}/{n}/{i}".encode()).hexdigest()[:24]
                nodes.append([ident, nodes[at][0], level, n, 0, "".join(u[a:b])])
                nxt.append(len(nodes) - 1)
        now = nxt
    return [tuple(x) for x in nodes]


def hierarchical(df: DataFrame, sizes: Sequence[int], content: str = "content", source: str = "id", overlap: int = 0) -> DataFrame:
    """All nodes of each document's hierarchy: id, parent_id, level, block_size, n_children, content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for batch in parts for x in slices(batch, "t")):
            rows = [r for s, t in zip(p["s"], p["t"], strict=True) for r in hierarchy(t, sizes, str(s), overlap)]
            yield pd.DataFrame(rows, columns=["id", "parent_id", "level", "block_size", "n_children", "content"])

    src = df.where(F.length(content) > 0).select(F.col(source).cast("string").alias("s"), F.col(content).alias("t"))
    return src.mapInPandas(run, "id string, parent_id string, level int, block_size int, n_children long, content string")


def read_csv(text: str) -> list[list[str]]:
    rows = list(csv.reader(io.StringIO(text)))
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def write_csv(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def clean_csv(text: str, ignore_rows: int = 0, ignore_columns: int = 0, empty_rows: bool = True, empty_columns: bool = True) -> str:
    """Without empty rows and columns, but for the first that are ignored. Text that is no CSV stays as it is."""
    try:
        rows = read_csv(text)
    except csv.Error:
        return text
    body = [r[ignore_columns:] for r in rows[ignore_rows:]]
    keep_r = [i for i, r in enumerate(body) if not empty_rows or any(x.strip() for x in r)]
    width = len(body[0]) if body else 0
    keep_c = [j for j in range(width) if not empty_columns or any(r[j].strip() for r in body)]
    cols = [*range(ignore_columns), *[j + ignore_columns for j in keep_c]]
    return write_csv([[r[j] for j in cols if j < len(r)] for r in [*rows[:ignore_rows], *[rows[i + ignore_rows] for i in keep_r]]])


def split_csv(text: str, rows_gap: int = 2, columns_gap: int = 2, by_row: bool = False) -> list[tuple[int, int, str]]:
    """(first row, first column, CSV) of the tables between runs of at least so many empty rows or columns; or of each row."""
    table = read_csv(text)
    if by_row:
        return [(i, 0, write_csv([r])) for i, r in enumerate(table)]

    def parts(empty: list[bool], gap: int) -> list[tuple[int, int]]:
        out, begin, run = [], 0, 0
        for i, e in enumerate([*empty, False]):
            run = run + 1 if e and i < len(empty) else run
            if i == len(empty) or not e:
                if run >= gap and i < len(empty) or run >= gap:
                    if i - run > begin:
                        out.append((begin, i - run))
                    begin = i
                run = 0
        if begin < len(empty):
            out.append((begin, len(empty)))
        return [p for p in out if not all(empty[p[0] : p[1]])]

    def cut(r0: int, r1: int, c0: int, c1: int) -> list[tuple[int, int, int, int]]:
        rows = parts([not any(x.strip() for x in table[i][c0:c1]) for i in range(r0, r1)], rows_gap)
        out = []
        for a, b in rows:
            cols = parts([not any(table[i][j].strip() for i in range(r0 + a, r0 + b)) for j in range(c0, c1)], columns_gap)
            for x, y in cols:
                box = (r0 + a, r0 + b, c0 + x, c0 + y)
                out += [box] if box == (r0, r1, c0, c1) else cut(*box)
        return out

    found = cut(0, len(table), 0, len(table[0]) if table else 0)
    return [(a, x, write_csv([r[x:y] for r in table[a:b]])) for a, b, x, y in sorted(found, key=lambda f: (f[0], f[2]))]
