"""Re-ranking of ranked lists (query_id, rank, id, score and what they sort by) by windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import expit


def _renumber(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("__r", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long")).drop("rank").withColumnRenamed("__r", "rank")


def meta_field(df: DataFrame, field: str, weight: float = 1.0, mode: str = "reciprocal_rank_fusion", ascending: bool = False, missing: str = "bottom", value_type: str | None = None, top_k: int | None = None) -> DataFrame:
    """Sorts by a field and fuses that order with the one before.

    missing: drop, top or bottom. value_type (float, int or date) parses text. Ties keep the order before. Weight 0 passes
    the list through; 1 sorts by the field alone. Score and rank are new.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight lies between 0 and 1")
    if mode not in ("reciprocal_rank_fusion", "linear_score") or missing not in ("drop", "top", "bottom"):
        raise ValueError("unknown mode or treatment of missing values")
    if weight == 0:
        return df if top_k is None else df.where(F.col("rank") < top_k)
    v = F.col(field)
    if value_type:
        v = F.try_to_timestamp(v) if value_type == "date" else v.try_cast({"float": "double", "int": "bigint"}[value_type])
    df = df.withColumn("__v", v)
    if missing == "drop":
        df = df.where("__v is not null")
    null_first = missing == "top"
    vo = (F.col("__v").asc_nulls_first() if null_first else F.col("__v").asc_nulls_last()) if ascending else (F.col("__v").desc_nulls_first() if null_first else F.col("__v").desc_nulls_last())
    per = Window.partitionBy("query_id")
    df = df.withColumns({"__prev": F.row_number().over(per.orderBy("rank")) - 1, "__meta": F.row_number().over(per.orderBy(vo, "rank")) - 1, "__n": F.count(F.lit(1)).over(per)})
    if mode == "reciprocal_rank_fusion":
        score = (1 - weight) / (61 + F.col("__prev")) + weight / (61 + F.col("__meta"))
    else:
        ok = F.when(F.col("score").between(0, 1), F.col("score")).otherwise(0.0)
        score = (1 - weight) * ok + weight * (F.col("__n") - F.col("__meta")) / F.col("__n")
    df = df.withColumn("score", score)
    out = _renumber(df, F.when(F.coalesce("score", F.lit(0.0)) == 0, -1.0).otherwise(F.col("score")).desc(), "__meta").drop("__v", "__prev", "__meta", "__n")
    return out if top_k is None else out.where(F.col("rank") < top_k)


def meta_grouping(df: DataFrame, group: str, subgroup: str | None = None, sort_by: str | None = None) -> DataFrame:
    """Brings rows of a group together, groups and subgroups in the order of their first row, rows without group last."""
    g = F.nullif(F.col(group).cast("string"), F.lit(""))
    sg = F.coalesce(F.nullif(F.col(subgroup).cast("string"), F.lit("")), F.lit("no_subgroup")) if subgroup else F.lit("no_subgroup")
    df = df.withColumns({"__g": g, "__sg": sg})
    df = df.withColumns({"__g0": F.min("rank").over(Window.partitionBy("query_id", "__g")), "__s0": F.min("rank").over(Window.partitionBy("query_id", "__g", "__sg"))})
    has = F.col("__g").isNotNull()
    order = [F.when(has, 0).otherwise(1), F.when(has, F.col("__g0")), F.when(has, F.col("__s0"))]
    if sort_by:
        order.append(F.when(has, F.col(sort_by)).asc_nulls_last())
    return _renumber(df, *order, "rank").drop("__g", "__sg", "__g0", "__s0")


def lost_in_the_middle(df: DataFrame, word_count_threshold: int | None = None, top_k: int | None = None, content: str = "content") -> DataFrame:
    """Best rows at both ends: even ranks ascending, then odd ones descending; a word budget ends with the row that reaches it."""
    if top_k is not None:
        df = df.where(F.col("rank") < top_k)
    if word_count_threshold is not None:
        before = F.coalesce(F.sum(F.size(F.split(F.col(content), r"\s+"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        df = df.withColumn("__b", before).where(F.col("__b") < word_count_threshold).drop("__b")
    return _renumber(df, F.col("rank") % 2, F.when(F.col("rank") % 2 == 0, F.col("rank")).otherwise(-F.col("rank")))


def top_p(df: DataFrame, p: float = 1.0, min_top_k: int = 0, score: str = "score") -> DataFrame:
    """Rows whose softmax reaches a share p, at least min_top_k and at least one; rows without score go, unless none has one."""
    if not 0 <= p <= 1:
        raise ValueError("top_p lies between 0 and 1")
    per = Window.partitionBy("query_id")
    s = F.col(score)
    df = df.withColumns({"__any": F.max(s.isNotNull()).over(per), "__max": F.max(s).over(per)})
    df = df.where("__any = false or " + f"`{score}` is not null")
    down = per.orderBy(s.desc_nulls_last(), "rank").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__e", F.exp(s - F.col("__max")))
    df = df.withColumns({"__cum": F.sum("__e").over(down) / F.sum("__e").over(per), "__rn": F.row_number().over(per.orderBy(s.desc_nulls_last(), "rank"))})
    near = F.abs(F.col("__cum") - p) <= 1e-6 + 1e-5 * p
    df = df.where(~F.col("__any") | (F.col("__cum") <= p) | near | (F.col("__rn") <= max(1, min_top_k)))
    return _renumber(df, F.col("__rn")).drop("__any", "__max", "__e", "__cum", "__rn")


def diversity(df: DataFrame, strategy: str = "greedy_diversity_order", top_k: int = 10, lambda_threshold: float = 0.5, query_embedding: str = "query_embedding", embedding: str = "embedding") -> DataFrame:
    """Orders each query's rows by greedy diversity or maximum marginal relevance over unit vectors; returns query_id, id, score, rank.

    Either picks rows one after the other, so a query's candidates, a retrieved list, are handled together.
    """
    if strategy not in ("greedy_diversity_order", "maximum_margin_relevance"):
        raise ValueError(f"unknown strategy {strategy!r}")
    kind = df.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
        d, q = unit(np.stack(pdf["d"].to_list()).astype(float)), unit(np.asarray(pdf["q"].iloc[0], float))
        rel, sim = d @ q, d @ d.T
        left, picked = list(range(len(pdf))), []
        while left and len(picked) < top_k:
            if not picked:
                best = max(left, key=lambda i: (rel[i], -i))
            elif strategy == "greedy_diversity_order":
                best = min(left, key=lambda i: (sim[i, picked].mean(), i))
            else:
                best = max(left, key=lambda i: (lambda_threshold * rel[i] - (1 - lambda_threshold) * sim[i, picked].max(), -i))
            picked.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": pdf["id"].to_numpy()[picked], "score": rel[picked], "rank": range(len(picked))})

    src = df.select("query_id", "rank", "id", F.col(query_embedding).cast("array<double>").alias("q"), F.col(embedding).cast("array<double>").alias("d"))
    return src.groupBy("query_id").applyInPandas(run, f"query_id long, id {kind}, score double, rank long")


def similarity_rank(df: DataFrame, scorer, query: str = "query", content: str = "content", calibration: float = 1.0, scale: bool = True, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """Cross-encoder order: `scorer` is an Arrow function of (query, content) to a number; sigmoid, threshold and cut follow."""
    s = scorer(F.col(query), F.col(content))
    df = df.withColumn("score", expit(s * calibration) if scale else s)
    if threshold is not None:
        df = df.where(F.col("score") >= threshold)
    out = _renumber(df, F.col("score").desc_nulls_last(), "rank")
    return out if top_k is None else out.where(F.col("rank") < top_k)
