"""Joining ranked lists. Lists come as one table: query_id, list_idx, rank (from 0), id, score; other columns are payload."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("concatenate", "merge", "reciprocal_rank_fusion", "distribution_based_rank_fusion")


def as_lists(*ranked: DataFrame) -> DataFrame:
    """Ranked tables one below the other, numbered."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.withColumn("list_idx", F.lit(i)) for i, r in enumerate(ranked)])


def _weight(weights: Sequence[float] | None, n: int) -> Column:
    w = list(weights) if weights else [1.0] * n
    if len(w) != n:
        raise ValueError("one weight for each list")
    return F.element_at(F.array(*[F.lit(float(x) / sum(w)) for x in w]), F.col("list_idx") + 1)


def _best(lists: DataFrame) -> DataFrame:
    """One row per id: the best score; none and 0 rank below all others, and the first list wins ties."""
    order = [F.nullif(F.col("score"), F.lit(0.0)).desc_nulls_last(), "list_idx", "rank"]
    w = Window.partitionBy("query_id", "id").orderBy(*order)
    return lists.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def join_documents(lists: DataFrame, n_lists: int, mode: str = "concatenate", weights: Sequence[float] | None = None, top_k: int | None = None, sort: bool = True) -> DataFrame:
    """Fuses lists by `mode`; returns query_id, id, score, rank (best first, null scores last)."""
    if mode not in MODES:
        raise ValueError(f"unknown join mode {mode!r}")
    key = ["query_id", "id"]
    if mode == "merge":
        out = lists.groupBy(*key).agg(F.sum(F.coalesce("score", F.lit(0.0)) * _weight(weights, n_lists)).alias("score"), F.min(F.struct("list_idx", "rank")).alias("__at"))
    elif mode == "reciprocal_rank_fusion":
        out = lists.groupBy(*key).agg(F.sum(61 * _weight(weights, n_lists) / (61 + F.col("rank"))).alias("score"), F.min(F.struct("list_idx", "rank")).alias("__at"))
    else:
        if mode == "distribution_based_rank_fusion":
            s = F.coalesce("score", F.lit(0.0))
            w = Window.partitionBy("query_id", "list_idx")
            mu, sd = F.avg(s).over(w), F.stddev_pop(s).over(w)
            lists = lists.withColumns({"__mu": mu, "__sd": sd}).withColumn("score", F.when(F.col("__sd") == 0, 0.0).otherwise((s - (F.col("__mu") - 3 * F.col("__sd"))) / (6 * F.col("__sd")))).drop("__mu", "__sd")
        out = _best(lists).select(*key, "score", F.struct("list_idx", "rank").alias("__at"))
    order = [F.col("score").desc_nulls_last(), "__at"] if sort else ["__at"]
    out = out.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long"))
    if top_k is not None:
        out = out.where(F.col("rank") < top_k)
    return out.select("query_id", "id", "score", "rank")


def join_answers(answers: DataFrame, top_k: int | None = None, sort: bool = False) -> DataFrame:
    """Answer lists one after the other, by score (missing last) if asked. Needs query_id, list_idx, rank and score."""
    order = ([F.col("score").desc_nulls_last()] if sort else []) + ["list_idx", "rank"]
    out = answers.withColumn("__rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long")).drop("rank").withColumnRenamed("__rank", "rank")
    return out if top_k is None else out.where(F.col("rank") < top_k)


def join_lists(*lists: DataFrame) -> DataFrame:
    """All rows in order of arrival: list_idx tells the list."""
    return as_lists(*lists)


def join_strings(*texts: Column) -> Column:
    return F.array(*texts)


def join_branches(*branches: DataFrame | None) -> DataFrame:
    """The one branch that delivers."""
    there = [b for b in branches if b is not None]
    if len(there) != 1:
        raise ValueError(f"exactly one branch delivers, not {len(there)}")
    return there[0]
