"""Operator 7: quality rules as a threshold table compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE

STOP_WORDS = tuple(
    "the of and to in is that it was for on are as with be at by from this or an "
    "der die das und ist von zu den mit ein eine nicht des sich auf für im dem "
    "le la les de des et un une du est que qui dans pour au sur par pas "
    "el los las y en una por con se del al lo su".split()
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """A row of the threshold table: a measured ratio must lie between least and most (None: no bound)."""

    name: str
    ratio: str
    least: float | None
    most: float | None


#: Ratios are SQL over the measures. The bounds are wide: prose in any of the languages passes all of them.
RULES = (
    Rule("words", "n_words", 20, None),
    Rule("word_length", "word_chars / n_words", 1.5, 20),
    Rule("symbols", "n_symbols / word_chars", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.5),
)


def measures(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds the counts of each whole text; only built-in expressions, each array built once.

    Null text counts as empty: all counts 0. Existing columns of the added names are replaced.
    """
    t = "__text"
    gone = {"word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words", "n_lines", "n_stop_words", "n_ellipsis_lines"}
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in gone], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    df = df.withColumns({
        "__words": F.array_remove(F.split(t, f"[{SPACE}]+"), ""),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("__lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).cast("long"),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(*stop_words))).cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__words", "__lines", t)
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__windows", F.transform(at, lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))).drop("__hashes")
    twice = F.size("__windows") > F.size(F.array_distinct("__windows"))
    sorted_ = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(twice, sorted_).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("__windows")
    near = lambda x, j: F.coalesce(F.get("__sorted", j)["h"] == x["h"], F.lit(False))
    found = F.filter("__sorted", lambda x, j: near(x, j - 1) | near(x, j + 1))
    df = df.withColumn("__found", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("__sorted")
    covered = F.transform("__found", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__found", j + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__found")


def compile_rules(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(kept, names of the rules that fail). A ratio over 0 fails no rule, as nothing was measured."""
    failed = []
    for r in rules:
        num, _, den = r.ratio.partition(" / ")
        ratio = F.try_divide(F.col(num), F.col(den)) if den else F.col(num).cast("double")
        bad = [ratio < r.least] * (r.least is not None) + [ratio > r.most] * (r.most is not None)
        failed.append((r.name, F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False))))
    kept = ~reduce(lambda a, b: a | b, [b for _, b in failed])
    return kept, F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in failed]), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, base_failed, kept and failed_rules. Null and empty texts have no words, so base_failed holds."""
    kept, failed = compile_rules(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = measures(docs.drop("base_failed", "kept", "failed_rules"), text)
    return df.select("*", base.alias("base_failed"), (~base & kept).alias("kept"), failed.alias("failed_rules"))
