"""Operator 1: sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, with_rank


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (i < n % shards) for i in range(shards)]


def _pick(position: str, ends: list[tuple[int, int]]):
    """The shard whose span holds a position; ends: (shard, end of its span), ascending."""
    last = F.array(*[F.lit(e).cast("long") for _, e in ends])
    return F.element_at(F.array(*[F.lit(s) for s, _ in ends]), F.size(F.filter(last, lambda e: e <= F.col(position))) + 1)


def propagate(cells: DataFrame, key: Sequence[str], quota: Sequence[int], tmp: Scratch, buckets: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """Moves the rows of each link value (cells: key, s, n) towards its fullest shard; returns cells and loads by shard.

    One round: among shards with room, each link value's target is the one that holds most of its rows. Its rows in other,
    not fuller shards ask to move there. Each shard grants requests by falling gain (rows met there) until its room is full; the running sums come from counts by (shard, level of gain, slice of hash) and inside
    those, so no task sorts all requests of a shard. Rounds end when nothing moves, or after `rounds`: with little room they
    go on for long, so `_pack` settles what is still divided then.
    """
    spark = cells.sparkSession
    for r in range(rounds):
        load = {x["s"]: x["n"] for x in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        room = spark.createDataFrame([(i, int(q - load.get(i, 0))) for i, q in enumerate(quota)], "t int, room long").where("room > 0")
        there = cells.join(F.broadcast(room), F.col("s") == F.col("t"))
        best = there.groupBy(*key).agg(F.max(F.struct(F.col("n").alias("met"), F.xxhash64(*key, "t").alias("h"), "t", "room")).alias("b"))
        best = best.select(*[F.col(k).alias(f"{k}b") for k in key], "b.*")
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}b"))
        asks = cells.join(best, same, "left").drop(*[f"{k}b" for k in key]).withColumn("asks", F.coalesce((F.col("s") != F.col("t")) & (F.col("n") <= F.col("met")), F.lit(False)))
        level = F.lit(63) - F.least(F.lit(63), F.floor(F.log2(F.col("met").cast("double")) * 2)).cast("int")
        asks = tmp.keep(asks.withColumns({"__level": level, "__fine": F.pmod(F.xxhash64(*key, "s"), F.lit(max(1, buckets // 8))).cast("int")}), f"asks{r}")
        want = asks.where("asks")
        sums = want.groupBy("t", "__level", "__fine").agg(F.sum("n").alias("m"))
        above = Window.partitionBy("t").orderBy("__level", "__fine").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("t").alias("tt"), F.col("__level").alias("tl"), F.col("__fine").alias("tf"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("above"))
        upto = F.sum("n").over(Window.partitionBy("t", "__level", "__fine").orderBy(*key, "s").rowsBetween(Window.unboundedPreceding, 0))
        told = want.withColumn("upto", upto).join(sums, (F.col("t") == F.col("tt")) & (F.col("__level") == F.col("tl")) & (F.col("__fine") == F.col("tf")))
        # A request across the end of the room is met in part.
        got = F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("above") - F.col("upto") + F.col("n"))).cast("long")
        parts = F.array(F.struct(F.col("t").alias("s"), got.alias("n"), F.lit(True).alias("moved")), F.struct(F.col("s").alias("s"), (F.col("n") - got).alias("n"), F.lit(False).alias("moved")))
        told = told.select(*key, F.inline(F.filter(parts, lambda x: x["n"] > 0)))
        stay = asks.where("not asks").select(*key, "s", "n", F.lit(False).alias("moved"))
        nxt = tmp.keep(told.unionByName(stay).groupBy(*key, "s").agg(F.sum("n").alias("n"), F.max("moved").alias("moved")), f"cells{r}")
        moved = nxt.where("moved").limit(1).count()
        tmp.drop(asks, cells)
        cells = nxt.select(*key, "s", "n")
        if not moved:
            break
    load = {x["s"]: x["n"] for x in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return cells, [load.get(i, 0) for i in range(len(quota))]


def shard(docs: DataFrame, link: Sequence[str], order: Sequence[str], shards: int = 40, rounds: int = 8) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to each row, so that linked rows stay together.

    Rows with equal values in the `link` columns are linked with one another (null is a value); the graph is kept as a
    star for each link value, never as pairs. Linked rows start in shards drawn by hash and are moved by `propagate`; a link value
    is held as its counts by shard, at most `shards` rows of whatever size. One with more rows than a quota fills
    several shards; it fills one in a round, so there are as many rounds as shards if need be, `rounds` at least, and link
    values that are divided after them are laid out whole. Rows without links take the places left. Quotas are N/shards rounded up or down, so counts differ by
    one at most (the `rows` law), and no edge is cut but where a shard is full.

    Ranks come from bucket counts, so no task sorts a large group; only one row for each shard is broadcast. Rows that
    are equal in link and order columns are interchangeable. An empty table gives an empty result. Columns shard and slot of
    the input are replaced.
    """
    tmp = Scratch(docs.sparkSession, "shard")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    key = [f"__k{i}" for i in range(len(link))]
    ordered = [F.col(f"`{c}`") for c in order]
    named = docs.withColumns({k: F.col(f"`{c}`") for k, c in zip(key, link, strict=True)} | {"__h": F.xxhash64(*[F.col(f"`{c}`") for c in [*order, *link]])})
    named = named.withColumn("__s", F.pmod(F.xxhash64(F.lit(3), "__h"), F.lit(shards)).cast("int"))
    counts = tmp.keep(named.groupBy(*key, F.col("__s").alias("s")).agg(F.count(F.lit(1)).alias("n")), "counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    buckets, quota = max(64, n // 20_000), _quotas(n, shards)
    linked = counts.groupBy(*key).agg(F.sum("n").alias("__all"), F.collect_list(F.struct("s", "n")).alias("__cells")).where("__all > 1")
    # A hash may start more linked rows in a shard than its quota; those beyond it are dealt on before rounds begin.
    cells = tmp.keep(linked.select(*key, F.inline("__cells")), "cells")
    cells, load = propagate(cells, key, quota, tmp, buckets, max(rounds, shards))
    while any(x > q for x, q in zip(load, quota, strict=True)):
        cells, load = _shed(cells, key, load, quota, tmp, buckets)
    cells, load = _pack(cells, key, load, quota, tmp, buckets)
    over = Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    spans = cells.withColumn("hi", F.sum("n").over(over)).groupBy(*[F.col(k).alias(f"{k}c") for k in key]).agg(F.sort_array(F.collect_list(F.struct("hi", "s"))).alias("__spans"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}c"))
    ranked = with_rank(named, key, F.col("__h"), [F.col("__h"), *ordered], "__rank", buckets)
    at = F.get(F.col("__spans"), F.size(F.filter("__spans", lambda x: x["hi"] <= F.col("__rank"))))["s"]
    rows = tmp.keep(ranked.join(spans, same, "left").select(*[F.col(f"`{c}`") for c in names], "__h", at.alias("__shard")), "rows")
    ends, total = [], 0
    for i, (q, x) in enumerate(zip(quota, load, strict=True)):
        if q > x:
            ends.append((i, total := total + q - x))
    free = with_rank(rows.where("__shard is null"), [], F.col("__h"), [F.col("__h"), *ordered], "__i", buckets)
    free = free.withColumn("__shard", _pick("__i", ends or [(0, 0)]).cast("int")).drop("__i")
    both = tmp.keep(rows.where("__shard is not null").unionByName(free), "both")
    # Free places were dealt in the order of __h, so another hash spreads the rows of a shard over buckets.
    out = with_rank(both, ["__shard"], F.xxhash64(F.lit(8), "__h"), [F.col("__h"), *ordered], "__slot", buckets)
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def _shed(cells: DataFrame, key: Sequence[str], load: list[int], quota: Sequence[int], tmp: Scratch, buckets: int) -> tuple[DataFrame, list[int]]:
    """Deals the rows of overfull shards beyond their quota to shards with room, smallest cells first."""
    full = [i for i, (x, q) in enumerate(zip(load, quota, strict=True)) if x > q]
    ends, total = [], 0
    for i, (q, x) in enumerate(zip(quota, load, strict=True)):
        if q > x:
            ends.append((i, total := total + q - x))
    spill, base = cells.where(F.col("s").isin(full)), 0
    parts = [cells.where(~F.col("s").isin(full)).select(*key, "s", "n")]
    for i in full:
        mine = spill.where(F.col("s") == i).withColumn("__fine", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        sums = mine.groupBy("__fine").agg(F.sum("n").alias("m"))
        before = F.coalesce(F.sum("m").over(Window.orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select(F.col("__fine").alias("tf"), before.alias("before"))
        upto = F.sum("n").over(Window.partitionBy("__fine").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
        mine = mine.withColumn("upto", upto).join(sums, F.col("__fine") == F.col("tf")).withColumn("lo", F.col("before") + F.col("upto") - F.col("n"))
        # Places 0 to quota stay; later ones go to the places left elsewhere. A cell across bounds is cut there.
        cuts = F.array(*[F.lit(0).cast("long"), F.lit(quota[i]).cast("long"), *[F.lit(quota[i] - base + e).cast("long") for _, e in ends]])
        to = F.array(F.lit(i), *[F.lit(s) for s, _ in ends])
        pieces = F.transform(to, lambda s, j: F.struct(s.alias("s"), (F.least(F.col("lo") + F.col("n"), F.get(cuts, j + 1)) - F.greatest(F.col("lo"), F.get(cuts, j), F.when(j > 0, quota[i]).otherwise(0))).alias("n")))
        parts.append(mine.select(*key, F.inline(F.filter(pieces, lambda p: p["n"] > 0))))
        base += load[i] - quota[i]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    nxt = tmp.keep(out.groupBy(*key, "s").agg(F.sum("n").alias("n")), "shed")
    got = {x["s"]: x["n"] for x in nxt.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return nxt, [got.get(i, 0) for i in range(len(quota))]


def _pack(cells: DataFrame, key: Sequence[str], load: list[int], quota: Sequence[int], tmp: Scratch, buckets: int) -> tuple[DataFrame, list[int]]:
    """Lays link values that are divided side by side over the places that whole ones leave, largest first, widest room first.

    So a link value is cut only where a shard is full. No shard may be over its quota.
    """
    values = tmp.keep(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("s"), F.sum("n").alias("n")), "values")
    if not values.where("c > 1").limit(1).count():
        return cells, load
    whole = values.where("c = 1").select(*key, "s", "n")
    taken = {x["s"]: x["n"] for x in whole.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    rooms, ends = sorted(((q - taken.get(i, 0), i) for i, q in enumerate(quota)), key=lambda x: (-x[0], x[1])), [0]
    for room, _ in rooms:
        ends.append(ends[-1] + room)
    level = F.lit(126) - F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int")
    apart = values.where("c > 1").withColumns({"__level": level, "__fine": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})
    sums = apart.groupBy("__level", "__fine").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("__level", "__fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("__level").alias("tl"), F.col("__fine").alias("tf"), before.alias("before"))
    upto = F.sum("n").over(Window.partitionBy("__level", "__fine").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
    laid = apart.withColumn("upto", upto).join(sums, (F.col("__level") == F.col("tl")) & (F.col("__fine") == F.col("tf"))).withColumn("lo", F.col("before") + F.col("upto") - F.col("n"))
    cuts, to = F.array(*[F.lit(e).cast("long") for e in ends]), F.array(*[F.lit(i) for _, i in rooms])
    pieces = F.transform(to, lambda s, j: F.struct(s.alias("s"), (F.least(F.col("lo") + F.col("n"), F.get(cuts, j + 1)) - F.greatest(F.col("lo"), F.get(cuts, j))).alias("n")))
    nxt = tmp.keep(whole.unionByName(laid.select(*key, F.inline(F.filter(pieces, lambda p: p["n"] > 0)))), "packed")
    got = {x["s"]: x["n"] for x in nxt.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return nxt, [got.get(i, 0) for i in range(len(quota))]
