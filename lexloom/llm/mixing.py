"""Operator 6: mixing sources to target weights by fitting word budgets with a bounded-knapsack program."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, Scratch, text_key, with_rank

REPEAT = 3


def targets(totals: dict[str | None, int], weight: Callable[[int, str | None], float], repeat: int = REPEAT) -> dict[str | None, float]:
    """Words for each source: shares of all words by weight, at most `repeat` times its own, the excess shared again.

    Sources are numbered by code point, null last.
    """
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: float(weight(i, s)) for i, s in enumerate(order)}
    left, out, free = float(sum(totals.values())), {}, list(order)
    while free:
        whole = sum(w[s] for s in free)
        share = {s: left * w[s] / whole if whole else 0.0 for s in free}
        over = [s for s in free if share[s] > repeat * totals[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(repeat * totals[s])
            left -= out[s]
        left, free = max(left, 0.0), [s for s in free if s not in out]
    return out


def fit(lengths: list[tuple[int, int]], budget: int, slack: int = 4_096) -> dict[int, int]:
    """How many documents of each length to take so that lengths sum to the budget, or to the sum nearest to it.

    lengths: (length, count). An even share of each length comes first; whole documents, longest first, then bring the
    rest below `slack`; the rest is a bounded knapsack over the documents left, solved exactly by sets of reachable sums
    kept as bits, counts split into powers of two. The work depends on the number of distinct lengths, not of documents.
    Where that misses the budget, `nearest` searches with documents given back.
    """
    have = {size: n for size, n in lengths if size > 0 and n > 0}
    total = sum(size * n for size, n in have.items())
    budget = min(budget, total)
    if not budget:
        return {}
    take = {size: n * budget // total for size, n in have.items()}
    rest = budget - sum(size * n for size, n in take.items())
    for size in sorted(have, reverse=True):
        if rest > slack:
            more = min(have[size] - take[size], max(0, rest - slack // 2) // size)
            take[size] += more
            rest -= more * size
    top = rest + slack
    mask, reached, steps = (1 << (top + 1)) - 1, 1, []
    for size in sorted(have):
        n, part = min(have[size] - take[size], top // size), 1
        while n > 0 and not reached >> rest & 1:
            k = min(part, n)
            steps.append((size, k, reached))
            reached |= reached << (size * k) & mask
            n, part = n - k, part * 2
        if reached >> rest & 1:
            break
    at = (reached & ((2 << rest) - 1)).bit_length() - 1
    over = reached >> rest
    if over and (gap := (over & -over).bit_length() - 1) < rest - at:
        at = rest + gap
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            take[size] += k
            at -= size * k
    if sum(size * n for size, n in take.items()) != budget:
        take = nearest(have, budget)
    return {size: n for size, n in take.items() if n}


def nearest(have: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length (have: count by length) to take for the sum nearest to the budget, at most the total.

    An even share and whole documents, longest first, come within the longest length L of the budget. Then documents of ever
    more lengths, and ever more of each, are taken back and chosen anew among all sums (as bits, in units of the lengths' common
    divisor), until the budget is met or all are free. 3 L of a length suffice: with more changes, in an order that keeps
    running sums within 3 L, two sums are equal, and what lies between can be undone. Above half of the total, what is left out is fitted.
    """
    total = sum(size * n for size, n in have.items())
    if 2 * budget > total:
        out = nearest(have, total - budget)
        return {size: n - out.get(size, 0) for size, n in have.items()}
    unit = math.gcd(*have)
    sizes, goal = sorted(have), (2 * budget + unit) // (2 * unit)
    base = {size: n * budget // total for size, n in have.items()}
    rest = budget - sum(size * n for size, n in base.items())
    for size in reversed(sizes):
        more = min(have[size] - base[size], rest // size)
        base[size] += more
        rest -= more * size
    best, gap = base, rest
    lengths, each, most = 16, 1, min(3 * sizes[-1] // unit, max(have.values()))
    while gap:
        free = sizes[:lengths]
        back = {size: min(base[size], each) for size in free}
        ways = {size: back[size] + min(have[size] - base[size], each) for size in free}
        start = {size: n - back.get(size, 0) for size, n in base.items()}
        want = goal - sum(size * n for size, n in start.items()) // unit
        top = want + gap // unit + 1
        mask, reached, steps = (1 << (top + 1)) - 1, 1, []
        for size in free:
            n, part = min(ways[size], top * unit // size), 1
            while n > 0 and not reached >> want & 1:
                k = min(part, n)
                steps.append((size, k, reached))
                reached |= reached << (size // unit * k) & mask
                n, part = n - k, part * 2
        below = (reached & ((2 << want) - 1)).bit_length() - 1
        over = reached >> want
        ends = [below, want + (over & -over).bit_length() - 1] if over else [below]
        off, at = min((abs((goal - want + e) * unit - budget), e) for e in ends)
        if off < gap:
            best, gap = dict(start), off
            for size, k, before in reversed(steps):
                if not before >> at & 1:
                    best[size] += k
                    at -= size // unit * k
        if over & 1 or (lengths >= len(sizes) and each >= most):
            break
        lengths, each = lengths * 4, each * 2
    return best


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weight: Callable[[int, str | None], float], keys: Sequence[str] = ("doc_id",), source: str = "source", text: str = "text", seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: its keys, carried columns, source, size, source_size, target, copies (0 to 3) and taken words.

    A source's documents are all taken as often as its target holds it whole; the remaining budget is fitted by document
    length, and documents of a length are chosen in the order of a seeded hash of keys and text, so reruns agree. Null text
    has no words and size 0; documents of size 0 are taken only with whole repeats of their source. Repeated rows are
    documents of their own: which of several equal rows is taken does not show. Null sources are one source.
    Only the list of sources and word totals comes to the driver.
    """
    a, b = text_key(text)
    cols = list(dict.fromkeys([*keys, *carry]))
    rows = sizes(docs, text).select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{source}`").alias("__source"), F.col("size").alias("__size"), F.xxhash64(F.lit(seed), a, b, *[F.col(f"`{k}`") for k in keys]).alias("__hash"))
    # Words are counted once: all else reads these rows.
    rows = Scratch(docs.sparkSession, "mixing").keep(rows, "sizes")
    histogram = rows.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("n"))
    found = histogram.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()
    totals = {r["__source"]: int(r["words"]) for r in found}
    goal = targets(totals, weight)
    plan_of = [(s, totals[s], goal[s], int(goal[s] // totals[s]) if totals[s] else 0) for s in totals]
    plan_of = [(s, t, g, q, min(t, round(g - q * t))) for s, t, g, q in plan_of]
    schema = "s string, source_size long, target double, whole int, budget long"
    per_source = docs.sparkSession.createDataFrame(plan_of, schema)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(list(zip(pdf["__size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]))
        return pdf.assign(extra=[take.get(x, 0) for x in pdf["__size"].tolist()])[["s", "z", "source_size", "target", "whole", "extra"]]

    per_length = histogram.join(per_source, F.col("__source").eqNullSafe(F.col("s"))).withColumn("z", F.col("__size"))
    chosen = per_length.groupBy("__source").applyInPandas(choose, "s string, z long, source_size long, target double, whole int, extra long")
    buckets = max(64, sum(r["n"] for r in found) // 20_000)
    ranked = with_rank(rows, ["__source", "__size"], F.col("__hash"), [F.col("__hash"), *[F.col(f"`{k}`") for k in keys]], "__rank", buckets)
    out = ranked.join(chosen, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__size") == F.col("z")))
    copies = (F.col("whole") + (F.col("__rank") < F.col("extra")).cast("int")).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in cols], F.col("__source").alias("source_name"), F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("__size") * copies).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weight: Callable[[int, str | None], float], seed: int = 7) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken, columns as in docs.

    Sizes and choices are settled on rows without text; the texts move once, by the seeded hash. Rows that are equal in
    doc_id and text share a hash and divide the copies that they are given together. Names that begin with __ are reserved.
    """
    a, b = text_key("text")
    mine = docs.withColumn("__key", F.xxhash64(F.lit(seed), a, b, F.col("doc_id")))
    slim = mix(mine.select("doc_id", "source", "text", "__key"), weight, seed=seed, carry=["__key"])
    given = slim.groupBy("__key").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    rows = mine.withColumn("__nth", nth).join(given.where("__all > 0"), "__key")
    copies = F.floor(F.col("__all") / F.col("__rows")) + (F.col("__nth") <= F.col("__all") % F.col("__rows")).cast("long")
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def thirds(i: int, _: str | None) -> float:
    """Weights 1, 2, 3, repeating."""
    return float(i % 3 + 1)


