"""Routing: named predicates over rows, file types, conditions, languages and labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import PipelineError

from lexloom.functions.filters import compile_filter, resolver, validate
from lexloom.functions.text import mime_type


def metadata_routes(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """One row for each rule that a row matches, with its name in `route`; `unmatched` where none does. One pass over the table."""
    for r in rules.values():
        validate(r)
    find = resolver(df)
    names = F.filter(F.array(*[F.when(compile_filter(r, find), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("route", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unmatched")))))


def split_routes(df: DataFrame, names: Sequence[str], column: str = "route") -> dict[str, DataFrame]:
    """A table for each route."""
    return {n: df.where(F.col(column) == n).drop(column) for n in names}


def file_type_route(df: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """The first pattern that matches the whole mime type, else `unclassified`."""
    for p in patterns:
        re.compile(p)
    mime = mime_type(F.col(path))
    route = F.lit("unclassified")
    for p in reversed(patterns):
        route = F.when(mime.rlike(f"^(?:{p})$"), F.lit(p)).otherwise(route)
    return df.withColumns({"mime_type": mime, "route": route})


def conditional_route(df: DataFrame, routes: Sequence[tuple[str, ...]]) -> DataFrame:
    """routes: (SQL condition, SQL output, name) or (condition, output, name, type); the first that is true counts. A row that none takes is an error when read.

    An output whose type is not the stated one raises PipelineError before anything runs. Conditions and outputs may call any function
    that is registered with the session, which is how custom filters are given.
    """
    name, out = F.raise_error(F.lit("no route matched")).cast("string"), F.lit(None).cast("string")
    for cond, expr, n, *kind in reversed(routes):
        if kind and (found := df.select(F.expr(expr).alias("x")).schema["x"].dataType.simpleString()) != kind[0]:
            raise PipelineError(f"the output of route {n!r} is {found}, not {kind[0]}")
        hit = F.coalesce(F.expr(cond), F.lit(False))
        name, out = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, F.expr(expr).cast("string")).otherwise(out)
    return df.withColumns({"route": name, "output": out})


#: Frequent words by language, for the detector that needs no model.
FREQUENT = {
    "de": "der die das und ist ein eine nicht mit zu den",
    "en": "the of and to in is that for with was are",
    "es": "el los las y en una que por con del es la",
    "fr": "le la les des et un une est que dans qui pour",
    "it": "il gli che di non per sono una della nel anche",
    "nl": "het een van niet dat op te voor met zijn aan",
    "pl": "nie na się jest do że to jak przez oraz w",
    "pt": "os as não uma para com do da dos em mais",
    "sv": "och att det som på är av för den inte med",
}


def detect_language(text: Column) -> Column:
    """The language whose frequent words occur most often; null where none does."""
    low = F.lower(text)

    def hits(s: str) -> Column:
        return F.regexp_count(low, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(s.split())})(?!\p{{L}})"))

    counts = [F.struct(hits(s).alias("n"), F.lit(lang).alias("lang")) for lang, s in sorted(FREQUENT.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"])


def language_route(df: DataFrame, languages: Sequence[str], text: str = "text", detector: Callable[[Column], Column] = detect_language) -> DataFrame:
    """Adds the detected language where it is listed, else `unmatched`."""
    found = df.withColumn("language", detector(F.col(text)))
    return found.withColumn("language", F.when(F.col("language").isin(*languages), F.col("language")).otherwise("unmatched"))


def label_route(df: DataFrame, classify: Callable[[Column], Column], labels: Sequence[str], text: str = "text") -> DataFrame:
    """Routes by a model's label (an Arrow function of text to a label); a label that isn't listed is an error when read."""
    got = classify(F.col(text))
    return df.withColumn("route", F.when(got.isin(*labels), got).otherwise(F.raise_error(F.concat(F.lit("unexpected label "), F.coalesce(got, F.lit("null"))))))


def zero_shot(df: DataFrame, scores: Callable[[Column], Column], labels: Sequence[str], text: str = "text", multi_label: bool = False) -> DataFrame:
    """Adds classification (label, score, details) from a model's array of scores, one for each label; multi_label takes them as they are, else softmax."""
    s = scores(F.col(text))
    if not multi_label:
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        s = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    details = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), s.alias("score"))
    best = F.array_max(F.transform(details, lambda d: F.struct(d["score"].alias("score"), d["label"].alias("label"))))
    return df.withColumn("classification", F.struct(best["label"].alias("label"), best["score"].alias("score"), details.alias("details")))
