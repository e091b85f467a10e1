"""Retrieval and answer metrics. truth: query_id, rank, id, content, score; retrieved: the same. Queries come from truth.

Where many queries share their truth, it is given as GroupedTruth, and no row is made for each pair of a query and what is true for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class GroupedTruth:
    """The truth of queries (query_id, group) as the members of their group (group, id, content, score); queries whose group is null or
    has no members have no truth. A query has one group."""

    queries: DataFrame
    members: DataFrame

    def asked(self) -> DataFrame:
        """Queries with truth, with their groups."""
        return self.queries.join(F.broadcast(self.members.select("group").distinct()), "group", "left_semi")

    def among(self, retrieved: DataFrame, key: str) -> DataFrame:
        """The true (query_id, key, score) among what was retrieved: one row for each retrieved key, query and true row."""
        r = retrieved.where(F.col(key).isNotNull()).select("query_id", F.col(key).alias("__key")).distinct().join(self.queries, "query_id")
        m = self.members.select(F.col("group").alias("__g"), F.col(key).alias("__k"), "score")
        return r.join(m, (F.col("__key") == F.col("__k")) & (F.col("group") == F.col("__g"))).select("query_id", F.col("__key").alias(key), "score")


Truth = DataFrame | GroupedTruth

#: Ranks whose discounts one row adds up.
RANKS = 4096


def _discounts(first: Column, last: Column) -> Column:
    """The sum of 1 / log2(rank + 2) over ranks first to last."""
    return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(2.0)))


def _ideal(truth: GroupedTruth) -> DataFrame:
    """query_id and idcg. Members of one gain share a run of ranks, so ranks come from the counts of gains, in blocks, and no group is sorted."""
    gains = truth.members.where("group is not null").groupBy("group", F.coalesce("score", F.lit(1.0)).alias("gain")).agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy("group").orderBy(F.desc("gain")).rowsBetween(Window.unboundedPreceding, 0))
    runs = gains.withColumn("end", end - 1).withColumn("first", F.col("end") - F.col("n") + 1)
    blocks = runs.select("group", "gain", "end", F.explode(F.sequence("first", "end", F.lit(RANKS).cast("long"))).alias("first"))
    sums = blocks.groupBy("group").agg(F.sum(F.col("gain") * _discounts(F.col("first"), F.least(F.col("end"), F.col("first") + RANKS - 1))).alias("idcg"))
    return truth.queries.join(sums, "group").select("query_id", "idcg")


def _hits(truth: Truth, retrieved: DataFrame, key: str = "content") -> DataFrame:
    """Retrieved rows with `hit`: whether their key is among the truth of their query."""
    if isinstance(truth, GroupedTruth):
        truth = truth.among(retrieved, key)
    t = truth.where(F.col(key).isNotNull()).select("query_id", F.col(key).alias("__key")).distinct().withColumn("hit", F.lit(1))
    r = retrieved.select("query_id", "rank", F.col(key).alias("__key"))
    return r.join(t, ["query_id", "__key"], "left").select("query_id", "rank", "__key", F.coalesce("hit", F.lit(0)).alias("hit"))


def _queries(truth: Truth, values: DataFrame) -> DataFrame:
    truth = truth.asked() if isinstance(truth, GroupedTruth) else truth
    return truth.select("query_id").distinct().join(values, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def mean(scores: DataFrame) -> DataFrame:
    """The mean over queries."""
    return scores.agg(F.avg("score").alias("score"))


def average_precision(truth: Truth, retrieved: DataFrame) -> DataFrame:
    """Average precision at the hits, over the number of hits (not of all that is true)."""
    h = _hits(truth, retrieved)
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("p", so_far / (F.col("rank") + 1))
    return _queries(truth, h.groupBy("query_id").agg(F.try_divide(F.sum(F.col("p") * F.col("hit")), F.sum("hit")).alias("score")))


def reciprocal_rank(truth: Truth, retrieved: DataFrame) -> DataFrame:
    h = _hits(truth, retrieved)
    return _queries(truth, h.where("hit = 1").groupBy("query_id").agg(F.max(1.0 / (F.col("rank") + 1)).alias("score")))


def ndcg(truth: Truth, retrieved: DataFrame) -> DataFrame:
    """Normalised discounted gain by id; gains are the truth's scores, or 1 where it has none."""
    grouped = isinstance(truth, GroupedTruth)
    t = (truth.among(retrieved, "id") if grouped else truth).select("query_id", F.col("id"), F.coalesce("score", F.lit(1.0)).alias("gain"))
    if grouped:
        ideal = _ideal(truth)
    else:
        ideal = t.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"))) - 1)
        ideal = ideal.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + F.lit(2.0))).alias("idcg"))
    got = retrieved.select("query_id", "rank", "id").join(t.groupBy("query_id", "id").agg(F.max("gain").alias("gain")), ["query_id", "id"])
    got = got.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + F.lit(2.0))).alias("dcg"))
    both = ideal.join(got, "query_id", "left").select("query_id", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.col("idcg")), F.lit(0.0)).alias("score"))
    return _queries(truth, both)


def recall(truth: Truth, retrieved: DataFrame, mode: str = "single_hit") -> DataFrame:
    """single_hit: 1 where anything true was retrieved; multi_hit: distinct true contents retrieved over all true rows."""
    if mode not in ("single_hit", "multi_hit"):
        raise ValueError(f"unknown recall mode {mode!r}")
    grouped = isinstance(truth, GroupedTruth)
    t = (truth.among(retrieved, "content") if grouped else truth).select("query_id", "content").distinct()
    r = retrieved.select("query_id", F.col("content").alias("__c")).distinct().withColumnRenamed("query_id", "__q")
    found = t.join(r, (F.col("query_id") == F.col("__q")) & F.col("content").eqNullSafe(F.col("__c"))).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    if mode == "single_hit":
        return _queries(truth, found.select("query_id", F.lit(1.0).alias("score")))
    if grouped:
        n = truth.queries.join(truth.members.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group").select("query_id", "n")
    else:
        n = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return _queries(truth, found.join(n, "query_id").select("query_id", (F.col("found") / F.col("n")).alias("score")))


def exact_match(pairs: DataFrame, truth: str = "answer", predicted: str = "predicted_answer") -> DataFrame:
    return pairs.select("query_id", (F.col(truth) == F.col(predicted)).cast("int").cast("double").alias("score"))


def semantic_similarity(pairs: DataFrame, embed: Callable | None = None, truth: str = "answer", predicted: str = "predicted_answer", cross: Callable | None = None) -> DataFrame:
    """Similarity of two answers: the cosine of their vectors (embed: a function of a text column to a vector), or what a model says of
    both (cross: a function of two text columns to a number), through a sigmoid where it leaves 0 to 1."""
    from lexloom.functions.text import cosine, expit

    if (embed is None) == (cross is None):
        raise ValueError("one model is needed: embed or cross")
    if cross is not None:
        s = pairs.select("query_id", cross(F.col(truth), F.col(predicted)).cast("double").alias("s"))
        unit = s.agg(F.coalesce(F.min("s") >= 0, F.lit(True)) & F.coalesce(F.max("s") <= 1, F.lit(True))).first()[0]
        return s.select("query_id", (F.col("s") if unit else expit(F.col("s"))).alias("score"))
    both = pairs.select("query_id", embed(F.col(truth)).alias("a"), embed(F.col(predicted)).alias("b"))
    return both.select("query_id", F.coalesce(cosine(F.col("a"), F.col("b")), F.lit(0.0)).alias("score"))


def judged(pairs: DataFrame, judge: Callable, prompt: str, kind: str = "faithfulness") -> DataFrame:
    """Scores by a model that answers with JSON {"statements": [...], "statement_scores": [...]} to the prompt column.

    faithfulness: mean of statement scores, 0 without statements; relevance: 1 with any relevant statement. A reply that can't be
    read gives NaN.
    """
    got = pairs.select("query_id", F.from_json(judge(F.col(prompt)), "statements array<string>, statement_scores array<double>", {"mode": "PERMISSIVE"}).alias("r"))
    s = F.col("r.statement_scores")
    m = F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), F.size(s))
    score = F.when(s.isNull() & F.col("r.statements").isNull(), float("nan")).when(F.coalesce(F.size(s), F.lit(0)) <= 0, 0.0).otherwise(m)
    if kind == "relevance":
        score = F.when(F.isnan(score), score).otherwise((F.coalesce(F.size("r.statements"), F.lit(0)) > 0).cast("double"))
    return got.select("query_id", score.alias("score"))


def aggregated_report(metrics: dict[str, DataFrame]) -> DataFrame:
    """metric and its mean score."""
    rows = [m.agg(F.avg("score").alias("score")).select(F.lit(n).alias("metrics"), "score") for n, m in metrics.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def detailed_report(inputs: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """Inputs by query_id with a column for each metric."""
    for n, m in metrics.items():
        inputs = inputs.join(m.select("query_id", F.col("score").alias(n)), "query_id", "left")
    return inputs


def compare_reports(one: DataFrame, other: DataFrame, names: Sequence[str], metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Two detailed reports side by side; metric columns carry the run's name, inputs stand once unless in `keep`."""
    inputs = [c for c in one.columns if c not in metrics and c != "query_id"]
    a = one.select("query_id", *[F.col(c).alias(f"{names[0]}_{c}" if c in keep else c) for c in inputs], *[F.col(m).alias(f"{names[0]}_{m}") for m in metrics])
    b = other.select("query_id", *[F.col(c).alias(f"{names[1]}_{c}") for c in keep], *[F.col(m).alias(f"{names[1]}_{m}") for m in metrics])
    return a.join(b, "query_id")


def save_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes a report as csv, json or parquet: a folder with a file of each task, so that no task takes the whole report."""
    w = report.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)
