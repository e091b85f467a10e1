"""Operator 2: toxicity classifier, regularised by counterfactuals over identity terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

#: Groups of identity terms; a term is swapped with others of its group.
IDENTITIES = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("immigrants", "foreigners", "refugees", "citizens", "locals", "migrants"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
WORDS = re.compile(r"[^\W\d_]+")


class Settings(NamedTuple):
    """max_rows bounds the labelled rows that are fitted on (a sample by hash of doc_id); all else covers every row."""

    max_rows: int = 20_000
    max_features: int = 512
    least_rows: int = 5
    least_gain: float = 25.0
    ridge: float = 0.05
    swap_penalty: float = 4.0
    identities: Sequence[Sequence[str]] = IDENTITIES


def features(text: str) -> set[str]:
    """Distinct lower-cased words of a whole text, and their beginnings of 4 to 6 letters (marked by *)."""
    words = set(WORDS.findall(text.lower()))
    out = set(words)
    for n in (4, 5, 6):
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def swapped(text: str, groups: Sequence[Sequence[str]]) -> list[str]:
    """The text with each identity term replaced by the next, and by the one after it, of the term's group; [] without terms."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    low = text.lower()
    if not any(w in place for w in set(WORDS.findall(low))):
        return []

    def by(step: int):
        def one(m: re.Match) -> str:
            g, i = place.get(m[0], ((m[0],), 0))
            return g[(i + step) % len(g)]

        return one

    return [WORDS.sub(by(k), low) for k in (1, 2)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def fit_weights(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, ridge: float, penalty: float, steps: int = 25) -> np.ndarray:
    """Newton's method for logistic loss + ridge |w|^2 / 2 + penalty * sum of squared score changes under swaps / 2.

    The last column of x is the constant; it is not regularised.
    """
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    fixed = np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-9])
    if len(swaps):
        fixed[:-1, :-1] += penalty * (swaps.T @ swaps)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + fixed @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + fixed, grad)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> Model:
    """Fits on labelled rows that aren't held out.

    Features are chosen by their gain (likelihood ratio with the label) from counts over the fitted rows. Documents
    without label, labels without document, and null labels or doc_ids are left out; with several labels the largest counts. Without
    labelled rows every score is 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    n = known.count()
    if not n:
        return Model(-40.0, {})
    share = min(1.0, settings.max_rows / n)
    chosen = F.pmod(F.xxhash64(F.lit(11), F.col("__id").cast("long")), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).where(chosen)
    rows = scratch.keep(rows.join(known.where(chosen), "__id").select("text", "__toxic"), "labelled")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_pydict({"f": pa.array(keys, pa.string()), "neg": pa.array([seen[0][k] for k in keys], pa.int64()), "pos": pa.array([seen[1][k] for k in keys], pa.int64())})

        for p in parts:
            for t, y in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                seen[y > 0].update(features(t))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out()
                    seen = (Counter(), Counter())
        yield out()

    per = rows.groupBy((F.col("__toxic") > 0).alias("y")).count().collect()
    total = {bool(r["y"]): r["count"] for r in per}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    sums = rows.mapInArrow(count, "f string, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sums = sums.where(F.col("neg") + F.col("pos") >= settings.least_rows)
    k, m = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_, part = float(max(1, n1 + n0)), lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    gain = 2 * (part(k, (k + m) * (n1 / all_)) + part(m, (k + m) * (n0 / all_)) + part(n1 - k, (all_ - k - m) * (n1 / all_)) + part(n0 - m, (all_ - k - m) * (n0 / all_)))
    best = sums.withColumn("gain", gain).where(F.col("gain") >= settings.least_gain).orderBy(F.desc("gain"), "f").limit(settings.max_features)
    terms = {t for g in settings.identities for t in g}
    # Identity terms are features in any case, so that what the labels say about them is seen and penalised.
    vocab = sorted({r["f"] for r in best.collect()} | terms)
    place, groups = {f: i for i, f in enumerate(vocab)}, settings.identities

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lambda t: sorted(place[f] for f in features(t) if f in place)
        for p in parts:
            texts = p.column(0).to_pylist()
            x = pa.array([ids(t) for t in texts], pa.list_(pa.int32()))
            s = pa.array([[ids(v) for v in swapped(t, groups)] for t in texts], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([x, s, p.column(1)], names=["x", "s", "y"])

    got = rows.mapInArrow(project, "x array<int>, s array<array<int>>, y int").toArrow().to_pylist()
    got.sort(key=lambda r: (r["x"], r["y"], r["s"]))
    x, swaps = np.zeros((len(got), len(vocab) + 1), np.float64), []
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
        for other in r["s"]:
            d = -x[i, :-1]
            d[other] += 1
            swaps.append(d)
    w = fit_weights(x, np.array([float(r["y"] > 0) for r in got]), np.array(swaps), settings.ridge, settings.swap_penalty)
    return Model(float(w[-1]), {f: float(v) for f, v in zip(vocab, w, strict=False) if abs(v) > 1e-4})


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds toxicity (double, 0 to 1) from each whole text alone; null and empty texts get the score of no features.

    A column toxicity of the input is replaced; others pass through.
    """
    base = docs.drop("toxicity")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + ["toxicity double"])
    bias, weights = model
    heads = {n: {f[:n]: v for f, v in weights.items() if f.endswith("*") and len(f) == n + 1} for n in (4, 5, 6)}
    whole = {f: v for f, v in weights.items() if not f.endswith("*")}

    def one(t: str | None) -> float:
        words = set(WORDS.findall((t or "").lower()))
        z = bias + math.fsum(whole[w] for w in whole.keys() & words)
        for n, table in heads.items():
            if table:
                z += math.fsum(table[h] for h in table.keys() & {w[:n] for w in words if len(w) > n})
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            col = p.column(p.schema.get_field_index(text))
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array([one(t) for t in col.to_pylist()], pa.float64())], names=[*p.schema.names, "toxicity"])

    return base.mapInArrow(run, schema)
