"""Operator 8: near-duplicate embeddings by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, components, in_groups

BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; dividing by the largest component first keeps squares in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def code(dims: int, parts: int, words: int, seed: int) -> list[np.ndarray]:
    """Random unit code words for each part of the coordinates, after which a filter is one word from each part."""
    rng = np.random.Generator(np.random.PCG64([seed, dims]))
    out = []
    for cols in np.array_split(np.arange(dims), min(parts, dims)):
        # Few coordinates hold few directions that differ.
        c = rng.normal(size=(min(words, 4 ** len(cols)), len(cols))) if len(cols) > 1 else np.array([[1.0], [-1.0]])
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out


@lru_cache(maxsize=8)
def turns(dims: int, rotations: int, seed: int) -> np.ndarray:
    """Random rotations: a vector whose length is unevenly spread over the parts in one of them isn't in the others."""
    rng = np.random.Generator(np.random.PCG64([seed, dims, 2]))
    out = []
    for _ in range(rotations):
        q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def decode(parts: list[np.ndarray], least: float) -> np.ndarray:
    """Numbers of all filters whose inner product with a vector is at least `least`, from its products with the code words of each part.

    List decoding: a choice of words for the first parts is dropped as soon as even the best words of the remaining
    parts can't reach the threshold.
    """
    rest = np.append(np.cumsum([p.max() for p in parts][::-1])[::-1], 0.0)
    ids, sums = np.zeros(1, np.int64), np.zeros(1)
    for i, p in enumerate(parts):
        room = least - rest[i + 1]
        words = np.flatnonzero(p >= room - sums.max())
        total = sums[:, None] + p[None, words]
        a, b = np.nonzero(total >= room)
        ids, sums = ids[a] * len(p) + words[b], total[a, b]
        if not len(ids):
            break
    return ids


def products(x: np.ndarray, codes: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each vector (row), its products with the code words of each part."""
    cols = np.cumsum([0] + [c.shape[1] for c in codes])
    parts = [x[:, cols[i] : cols[i + 1]] @ c.T for i, c in enumerate(codes)]
    return [[p[k] for p in parts] for k in range(len(x))]


class Plan(NamedTuple):
    parts: int
    words: int
    least: float
    hits: float


#: Vectors in a filter on average, the share of pairs at the least cosine that may have no filter in common, and words of a part at most.
LOAD, MISS, MOST_WORDS = 2.0, 1e-3, 4096


@lru_cache(maxsize=8)
def plan(dims: int, n: int, cosine: float, rotations: int, seed: int) -> Plan:
    """A code for n vectors: filters in proportion to n, so that a filter holds about LOAD vectors at every size, and the threshold.

    Measured on drawn vectors: the threshold that lets a vector into `hits` filters on average, and the share of pairs at `cosine`
    that meet in no filter of one rotation; hits grow until that share, to the power of the rotations, is at most MISS.
    """
    rng = np.random.Generator(np.random.PCG64([seed, dims, 1]))
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 200, dims)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    hits = 4.0
    while True:
        size = max(1 << 14, n * hits / LOAD)
        parts = 2
        while size ** (1 / parts) > MOST_WORDS and 4 * (parts + 1) <= dims:
            parts += 1
        words = math.ceil(size ** (1 / parts))
        codes = code(dims, parts, words, seed)
        most = math.prod(len(c) for c in codes)
        px, py = products(x, codes), products(y, codes)
        count = lambda t, px=px: float(np.mean([len(decode(p, t)) for p in px[:48]]))
        low = high = max(sum(p.max() for p in q) for q in px)  # what no vector exceeds
        while low > -high and count(low) < min(hits, most):
            low -= 0.03 * high
        for _ in range(6):
            t = (low + high) / 2
            low, high = (t, high) if count(t) >= hits else (low, t)
        alone = np.mean([not np.intersect1d(decode(p, low), decode(q, low)).size for p, q in zip(px, py, strict=True)])
        if alone**rotations <= MISS or hits >= most:
            return Plan(parts, words, low, hits)
        hits *= 1.5


def near_duplicates(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rotations: int = 8, seed: int = 5) -> DataFrame:
    """One row per vector: vec_id, label, n_links (other vectors with cosine >= least and equal label), component_id, kept.

    Only these columns return; vec_id holds whole numbers. A vector that is null, empty or zero or holds null or non-finite
    components, or has a null label, links with nothing; its component is itself. Vectors of other lengths don't link. Equal vectors
    are held once with their number and link with one another. Rows that share a vec_id are rows of their own with one
    component_id. Cosines are taken in double precision.

    Each vector enters all filters whose direction it exceeds, in each of `rotations` turned copies of a code whose size and
    threshold `plan` derives from the number of vectors: at cosine `least`, one pair in a thousand has no filter in common (the tests
    measure the recall). Filters with one vector are dropped before vectors move. Vectors in one filter meet in blocks of about BLOCK
    rows, whose products are taken as matrices; a pair counts in its least common filter only. What leaves a block are sums of
    links and one edge for each vector, never the pairs.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "embeddings")
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are equal; a power of two of the largest component keeps squares in range.
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(9), "label", "v")})
    ok = rows.where("v is not null")
    groups = ok.groupBy("label", "h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least_id"), F.first("v").alias("v"))
    groups = tmp.keep(groups.withColumn("g", F.monotonically_increasing_id()), "groups")

    n = groups.count()

    def enter(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts_:
            for at in range(0, len(whole), 1_000):
                p = whole.slice(at, 1_000)
                g, v = p.column(0).to_numpy(), p.column(1)
                lengths = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(lengths) - lengths
                for d in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == d)
                    x = unit(flat[starts[rows][:, None] + np.arange(d)])
                    chosen = plan(d, n, least, rotations, seed) if d > 1 else Plan(1, 2, -1.0, 1.0)
                    codes = code(d, chosen.parts, chosen.words, seed)
                    size = math.prod(len(c) for c in codes)
                    for k, turn in enumerate(turns(d, rotations, seed)):
                        found = [decode(q, chosen.least) for q in products(x @ turn.T, codes)]
                        many = [len(f) for f in found]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g[rows], many)), pa.array(np.full(sum(many), d, np.int32)), pa.array(np.concatenate(found) + k * size)], names=["g", "dims", "f"])

    labels = groups.select("g", "label")
    entered = tmp.keep(groups.select("g", "v").mapInArrow(enter, "g bigint, dims int, f bigint").join(labels, "g"), "entered")
    key = ["label", "dims", "f"]
    full = entered.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c")
    shared = tmp.keep(entered.join(full, key), "shared")
    tmp.drop(entered)
    held = shared.groupBy("g").agg(F.sort_array(F.collect_list("f")).alias("fs")).join(groups.select("g", "m", "v"), "g")
    entered = shared.join(held, "g")
    own = F.pmod(F.xxhash64("g", "f"), F.col("nb")).cast("int")
    placed = entered.withColumn("b", own)
    # Block i meets block j >= i once; a row is in as many block pairs as there are blocks.
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    met = placed.select(*key, "g", "m", "v", "fs", "b", F.inline(pairs))

    def meet(t: pa.Table, lo: int, hi: int) -> pa.RecordBatch | None:
        col = lambda c: t.column(c).slice(lo, hi - lo)
        f, i, j = (t.column(c)[lo].as_py() for c in ("f", "i", "j"))
        g, m, b = (col(c).to_numpy() for c in ("g", "m", "b"))
        x = unit(col("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1))
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        link = cos >= least
        if i != j:
            link &= b[:, None] != b[None, :]
        some = link.any(1)
        if not some.any():
            return None
        earlier = [fs[fs < f] for fs in map(np.asarray, col("fs").to_pylist())]
        names, where = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(g), len(names)), np.float32)
        held[np.repeat(np.arange(len(g)), [len(e) for e in earlier]), where] = 1
        first = (held @ held.T) == 0 if len(names) else np.ones_like(link)
        # Edges, to the least vector reached inside the block, may repeat among filters; counts may not.
        to, before = g.copy(), None
        while before is None or (to != before).any():
            before, to = to, np.minimum(to, np.where(link, to[None, :], np.iinfo(np.int64).max).min(1))
        counts = (link & first) @ m
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (g, counts, to)], names=["g", "n", "to"])

    links = tmp.keep(in_groups(met, [*key, "i", "j"], meet, "g bigint, n bigint, to bigint", rows=5_000), "links")
    roots = components(links.select(F.col("g").alias("a"), F.col("to").alias("b")), tmp)
    counts = links.groupBy("g").agg(F.sum("n").alias("others"))
    state = groups.select("label", "h1", "h2", "g", "m", "least_id").join(counts, "g", "left").join(roots.withColumnRenamed("node", "g"), "g", "left")
    state = state.withColumn("root", F.coalesce("root", "g"))
    ids = state.groupBy("root").agg(F.min("least_id").alias("component"))
    state = tmp.keep(state.join(ids, "root").select(F.col("label").alias("__l"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "component"), "state")
    same = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & (F.col("label") == F.col("__l")) & F.col("v").isNotNull()
    out = rows.join(state, same, "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


