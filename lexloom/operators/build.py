"""Prompts, answers and projections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VAR = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")
_READ = re.compile(r"\{\{\s*([\w.]+)[^}]*\}\}")
#: Filters that any template knows; a call may bring others.
FILTERS: dict[str, Callable] = {"upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "length": lambda x: len(x or ()), "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None, "join": lambda x: "".join(map(str, x or ()))}
_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)


def template_variables(template: str) -> list[str]:
    """Names that a template reads, loop variables left out."""
    bound = set(re.findall(r"\{%-?\s*for\s+(\w+)\s+in", template))
    names = _READ.findall(template) + re.findall(r"\{%-?\s*(?:for\s+\w+\s+in|if|elif)\s+(?:not\s+)?([\w.]+)", template)
    return sorted({n.split(".")[0] for n in names} - bound)


def prompt(template: str, columns: Sequence[str], required: Sequence[str] = (), optional: Sequence[str] = ()) -> Column:
    """A template of {{ column }} marks as one expression. Null required columns make the row fail when read; others count as empty."""
    parts, at = [], 0
    for m in _VAR.finditer(template):
        name = m[1]
        if name.split(".")[0] not in columns and name not in optional:
            raise ValueError(f"the template reads {name!r}, which is no column")
        parts.append(F.lit(template[at : m.start()]))
        v = F.col(name).cast("string") if name.split(".")[0] in columns else F.lit("")
        parts.append(F.when(v.isNull(), F.raise_error(F.lit(f"no value for {name}"))).otherwise(v) if name in required else F.coalesce(v, F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render(template: str, values: dict, filters: Mapping[str, Callable] | None = None) -> str:
    """A template with {{ a.b | filter }}, {% for x in xs %} ... {% endfor %} and {% if a %} ... {% else %} ... {% endif %}.

    Filters are functions of one value, applied from left to right; an unknown one is an error.
    """
    tokens, at, known = [], 0, {**FILTERS, **(filters or {})}
    for m in _TAG.finditer(template):
        tokens += [("text", template[at : m.start()]), ("tag", m[1]) if m[1] is not None else ("out", m[2])]
        at = m.end()
    tokens.append(("text", template[at:]))

    def get(path: str, scope: dict):
        v = scope
        for p in path.split("."):
            v = v.get(p) if isinstance(v, dict) else getattr(v, p, None)
            if v is None:
                return None
        return v

    def block(i: int, scope: dict, live: bool, ends: tuple[str, ...]) -> tuple[str, int]:
        out = []
        while i < len(tokens):
            kind, x = tokens[i]
            if kind == "text" and live:
                out.append(x)
            elif kind == "out" and live:
                path, *then = [part.strip() for part in x.split("|")]
                v = get(path, scope)
                for f in then:
                    if f not in known:
                        raise ValueError(f"unknown filter {f!r}")
                    v = known[f](v)
                out.append("" if v is None else str(v))
            elif kind == "tag":
                word = x.split()[0]
                if word in ends:
                    return "".join(out), i
                if word == "for":
                    name, seq = re.match(r"for\s+(\w+)\s+in\s+([\w.]+)", x).groups()
                    end = i
                    for item in (get(seq, scope) or []) if live else []:
                        t, end = block(i + 1, scope | {name: item}, True, ("endfor",))
                        out.append(t)
                    i = end if end > i else block(i + 1, scope, False, ("endfor",))[1]
                elif word == "if":
                    _, neg, path = re.match(r"(if)\s+(not\s+)?([\w.]+)", x).groups()
                    yes = bool(get(path, scope)) != bool(neg)
                    t, i = block(i + 1, scope, live and yes, ("else", "endif"))
                    out.append(t)
                    if tokens[i][1].split()[0] == "else":
                        t, i = block(i + 1, scope, live and not yes, ("endif",))
                        out.append(t)
                else:
                    raise ValueError(f"unknown tag {x!r}")
            i += 1
        return "".join(out), i

    return block(0, values, True, ())[0]


def prompt_rows(df: DataFrame, template: str, output: str = "prompt", required: Sequence[str] = (), filters: Mapping[str, Callable] | None = None) -> DataFrame:
    """Renders a template with loops and conditions for each row, in Arrow batches; columns are the variables."""
    names = [c for c in template_variables(template) if c in df.columns]
    lost = set(required) - set(df.columns)
    if lost:
        raise ValueError(f"required variables {sorted(lost)} are no columns")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{output: [render(template, _plain(r), filters) for r in p[names].to_dict("records")]})

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != output] + [f"`{output}` string"])
    return df.drop(output).mapInPandas(run, ddl)


def _plain(v):
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def chat_prompt(messages: Column, values: dict[str, Column]) -> Column:
    """Replaces {{ name }} in the text of user and system messages (array of structs with role and text)."""

    def one(m: Column) -> Column:
        t = m["text"]
        for n, v in values.items():
            t = F.regexp_replace(t, F.lit(r"\{\{\s*" + n + r"\s*\}\}"), F.coalesce(F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("")))
        return m.withField("text", F.when(m["role"].isin("user", "system"), t).otherwise(m["text"]))

    return F.transform(messages, one)


def answers(df: DataFrame, reply: str = "reply", documents: str | None = None, pattern: str | None = None, reference_pattern: str | None = None) -> DataFrame:
    """Adds answer (the pattern's group or match, empty without one) and references: the documents that [n] marks name, from 1.

    Marks out of range are left out. Without a reference pattern all documents are references.
    """
    if pattern is not None and re.compile(pattern).groups > 1:
        raise ValueError("a pattern has one group at most")
    text = F.col(reply)
    if pattern is not None:
        text = F.regexp_extract(text, pattern, re.compile(pattern).groups)
    df = df.withColumn("answer", text)
    if documents is None:
        return df
    if reference_pattern is None:
        return df.withColumn("references", F.col(documents))
    ns = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.col(reply), F.lit(reference_pattern), F.lit(1)), lambda x: x.try_cast("int"))))
    ok = F.filter(ns, lambda n: (n >= 1) & (n <= F.size(documents)))
    return df.withColumn("references", F.transform(ok, lambda n: F.try_element_at(documents, n)))


def adapt(df: DataFrame, expression: str, output: str = "output", output_type: str | None = None) -> DataFrame:
    """Any columns through one SQL expression."""
    e = F.expr(expression)
    return df.withColumn(output, e.cast(output_type) if output_type else e)


def embedding_text(content: Column, meta: Sequence[Column] = (), prefix: str = "", suffix: str = "", separator: str = "\n", keep_empty: bool = True) -> Column:
    """What an embedder reads of a document: the meta values that are there, then the content. keep_empty keeps empty values and 0."""
    fields = [c.cast("string") if keep_empty else F.when(~c.cast("string").isin("", "0", "false"), c.cast("string")) for c in meta]
    return F.concat(F.lit(prefix), F.concat_ws(separator, *fields, F.coalesce(content, F.lit(""))), F.lit(suffix))
