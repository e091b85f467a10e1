"""Operator 9: exact substring deduplication by bucket-pointer refinement.

Each position of a text points to the bucket of the q bytes that follow it: its initial pointer is the code of that q-gram. An open
bucket, one of several positions that don't agree on everything that matters, is refined by sorting its positions on
(pointer to the bucket so far, pointers of q-grams at the offsets where the refined bucket begins and ends), and the refined
pointers are written for the next level, which refines them in the same way. A bucket of one position is finished, as is one
whose positions all agree. Pointers are numbers drawn from content (two of 64 bits where they stand alone) instead of ranks in
a suffix array: equality is all that deduplication asks of them, and no order among buckets has to be agreed on by tasks.

Only positions that the text itself selects are refined: of each `least - q + 1` neighbouring q-grams the one of least
code. Each string of `least` bytes holds such an anchor, at the same offset wherever the string stands, so two equal
strings always meet in an anchor's bucket. For an anchor, offset d stands for the string that begins d bytes before it, so
that one refined bucket stands for a range of strings, and a level halves the ranges two or six times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesview import MASK, Rolling, mix, slices, view
from lexloom.llm.common import Scratch, text_key

CHUNK = 1_000_000
#: Lower half of a code or pair.
LOW = 0xFFFFFFFF
#: Offsets that a bucket of each level of refinement spans.
STEPS = (64, 16, 4, 1)
#: Odd factors that keep the two halves of a pointer independent.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def pack(texts: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The named columns and the text as compressed bytes, for shuffles of text that Python reads next."""
    src = texts.select(*names, F.coalesce(F.col(column), F.lit("")).cast("binary").alias("__t"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["__z binary", "__size bigint"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for p in parts:
            raw = p.column(p.num_columns - 1).to_pylist()
            z = pa.array([codec.compress(t, asbytes=True) if t else b"" for t in raw], pa.binary())
            size = pa.array([len(t) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([*p.columns[:-1], z, size], names=[*p.schema.names[:-1], "__z", "__size"])

    return src.mapInArrow(run, schema)


def unpack(z: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, decompressed_size=size, asbytes=True) if size else b""


def pointers(data: np.ndarray, q: int, roll: Rolling) -> np.ndarray:
    """Initial bucket pointers: the code of the q-gram at each position."""
    return mix(roll.feed(data).runs(q)) >> np.uint64(1)


def find_anchors(data: np.ndarray, off: np.ndarray, least: int, q: int, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in texts laid end to end, and their initial pointers.

    The upper half of a code decides, and among equals the first in the string; codes carry their positions, so that the
    least of neighbouring ones names its place.
    """
    w = least - q + 1
    h = pointers(data, q, roll)
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    low = (h & np.uint64(MASK ^ LOW)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < w:
        more = min(span, w - span)
        low = np.minimum(low[:-more], low[more:])
        span += more
    inside = np.ones(len(low), bool)  # strings that lie in one text
    late = np.maximum(off[1:, None] - np.arange(1, least), off[:-1, None])[np.diff(off) > 0]
    inside[late[late < len(low)]] = False
    at = (low[inside] & np.uint64(LOW)).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    return at, h[at]


def cut(step: int, per: int, q: int, least: int, roll: Rolling, off: np.ndarray, texts: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Offset ranges of the rows, each cut into `per` of `step` offsets: index of the row, k, refined pointers c1 and c2, and u.

    texts: t1, t2, pos and left (bytes before the position) by context; `roll` was fed the contexts, which `off` bounds. rows: context, k, c1 and c2.

    What the strings of a part share begins and ends at most q - 1 bytes beyond what those of the whole range share, so the
    range's pointer and those of the first and last q-gram name it. What any of them holds reaches at most `step` bytes further.
    """
    t1, t2, pos, left = texts
    i = np.repeat(np.arange(len(rows[0])), per)
    row, k = rows[0][i], rows[1].astype(np.int64)[i] * per + np.tile(np.arange(per), len(rows[0]))
    anchor, first, last = off[row] + left[row], off[row], off[row + 1]
    lo, hi = anchor - k * step, anchor - (k * step + step - 1) + least
    # A range of which no string lies in the text ends here.
    ok = (lo >= first) & (hi <= last)
    i, row, k, lo, hi, first, last = (x[ok] for x in (i, row, k, lo, hi, first, last))
    u0, u1 = lo - (step - 1), hi + (step - 1)

    def at(x: np.ndarray) -> np.ndarray:
        return mix(roll(x, x + q)) >> np.uint64(1)

    place = mix(k.astype(np.uint64))  # the range's pointer counts at its place in the part
    begin, end = at(lo), at(hi - q)
    c1, c2 = (mix(mix(b[i].view(np.uint64) + place ^ begin * np.uint64(odd)) + end) for b, odd in zip(rows[2:], ODD, strict=True))
    # Ranges over the edge of a text have no equal but in copies of that text.
    over = (u0 < first) | (u1 > last)
    own = mix(t1[row].view(np.uint64) ^ mix(t2[row].view(np.uint64) + pos[row].astype(np.uint64)) ^ place)
    u = np.where(over, own, mix(mix(c1 ^ at(np.maximum(u0, first))) + at(np.minimum(u1, last) - q)))
    return i, k, c1.view(np.int64), c2.view(np.int64), u


def refine_whole(texts: tuple[np.ndarray, ...], n: np.ndarray, c: np.ndarray, bytes_: pa.Array, least: int, q: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """All levels of buckets that are there whole: context, begin and end of what is repeated around it, in the text.

    texts: t1, t2, pos and left by context; n: the positions (2: or more) that it stands for; c: its bucket. Levels are those of `settle`.
    """
    data, off = view(bytes_)
    roll.feed(data)
    row, k, b1, b2 = np.arange(len(c)), np.zeros(len(c), np.int64), c, np.zeros(len(c), np.int64)
    pos, found, before = texts[2].astype(np.int64), [], least - q + 1
    for step in STEPS:
        i, k, c1, c2, u = cut(step, before // step, q, least, roll, off, texts, (row, k, b1, b2))
        before = step
        order = np.lexsort((u, c2, c1))
        row, n, k, c1, c2, u = (x[order] for x in (row[i], n[i], k, c1, c2, u))
        if not len(row):
            break
        bucket = np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
        kind = bucket | np.concatenate([[True], u[1:] != u[:-1]])
        of_bucket, of_kind, at_kind = np.cumsum(bucket) - 1, np.cumsum(kind) - 1, np.flatnonzero(kind)
        many = np.add.reduceat(n, at_kind)  # positions of each kind
        mixed = (np.bincount(of_bucket[at_kind]) > 1)[of_bucket]
        done = many[of_kind] > 1  # a bucket of one kind is repeated as that kind is
        base = pos[row[done]] - k[done] * step
        found.append((row[done], base - (step - 1), base + least))
        go = at_kind[mixed[at_kind]]
        n = np.minimum(many[mixed[at_kind]], 2)
        row, k, b1, b2 = row[go], k[go], c1[go], c2[go]
    row, lo, hi = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    far = row << 40  # spans that touch become one
    top = np.maximum.accumulate(far + hi) if len(row) else far
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (far[1:] + lo[1:] > top[:-1])])[: len(row)]
    starts = np.flatnonzero(new)
    return row[starts], lo[starts], (top - far)[np.append(starts[1:], len(row)) - 1] if len(row) else hi


def dedup_substrings(docs: DataFrame, least: int = 200, q: int = 73, text: str = "text", whole: int = 4_096) -> DataFrame:
    """Removes every byte covered by a string of `least` bytes that also starts elsewhere, in any text, the same included.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes (binary: the remaining bytes). Strings are judged
    on the input and never cross documents. Null text counts as empty; texts shorter than `least` stay. Equal rows have
    equal results. Columns of the added names are replaced, others pass through (names that begin with __ are reserved). All texts are read whole, and counts
    of fingerprints are aggregated before each shuffle, so a passage in a third of all documents is one row per task.
    Buckets of at most `whole` kinds are refined where they are, in one task; larger ones level by level by all tasks, with the same results.
    """
    w = least - q + 1
    if w < STEPS[0] or w % STEPS[0]:
        raise ValueError(f"least - q + 1 must be a multiple of {STEPS[0]}")
    if q < max([w, *STEPS][i] - s for i, s in enumerate(STEPS)) or q < STEPS[0]:
        raise ValueError("q is too short to reach from a range to its parts")
    tmp = Scratch(docs.sparkSession, "suffixes")
    a, b = text_key(text)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes")
    number = F.col("doc_id").cast("long") if "doc_id" in base.columns else F.lit(None).cast("long")
    keyed = base.withColumns({"__t1": a, "__t2": b, "__id": number})
    long_ = keyed.where(F.octet_length(t) >= least)

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(1), Rolling(2)
        for p in parts:
            for s in slices(p, "t", CHUNK):
                data, off = view(s.column(2))
                at, h = find_anchors(data, off, least, q, one)
                doc = np.searchsorted(off, at, "right") - 1
                lo, hi = at - (w - 1), at + least
                clipped = (lo < off[doc]) | (hi > off[doc + 1])
                two.feed(data)
                whole = mix(two(np.maximum(lo, off[doc]), np.minimum(hi, off[doc + 1])))
                t1, t2 = (s.column(k).to_numpy()[doc] for k in (0, 1))
                alone = mix(t1.view(np.uint64) ^ mix(t2.view(np.uint64) + at.astype(np.uint64) - off[doc].astype(np.uint64)))
                whole = np.where(clipped, alone, whole)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1, t2, (at - off[doc]).astype(np.int32), h.view(np.int64), whole.view(np.int64))], names=["t1", "t2", "pos", "c", "u"])

    src = long_.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), t.alias("t"))
    found = tmp.keep(src.mapInArrow(anchors, "t1 bigint, t2 bigint, pos int, c bigint, u bigint"), "anchors")

    def settle(rows: DataFrame, step: int, label: str) -> tuple[DataFrame, DataFrame]:
        """One level of buckets. rows: a position with offsets k * step to k * step + step - 1, standing for n positions (2: or more),
        c1 and c2, the pointer to the bucket of the bytes that all strings at these offsets hold, and u, that of the bytes that any of them holds.

        A bucket c of one position is finished: none of its strings is repeated. One of a single u is finished too: all are. In
        any other, the positions of a repeated u are finished, and one position of each u goes on to the next level with its pointer.
        """
        c = ["c1", "c2"]
        sums = rows.groupBy(*c).agg(F.sum("n").alias("m"), (F.min("u") != F.max("u")).alias("mixed")).where("m > 1")
        # Written, so that Spark deals out the rows of one very frequent bucket to several tasks of the join.
        sums = tmp.keep(sums, f"sums{label}")
        live = tmp.keep(rows.join(sums, c), f"live{label}")
        split = live.where("mixed")
        kinds = split.groupBy(*c, "u").agg(F.sum("n").alias("n"), F.max("m").alias("m"), F.min(F.struct("t1", "t2", "pos", "k")).alias("r"))
        kinds = tmp.keep(kinds.select(*c, "u", F.least("n", F.lit(2)).cast("int").alias("n"), "m", "r.*"), f"kinds{label}")
        same = split.join(kinds.where("n > 1").select(*c, "u"), [*c, "u"])
        at = F.col("pos") - F.col("k") * step
        span = ["t1", "t2", (at - (step - 1)).alias("lo"), (at + least).alias("hi")]
        done = tmp.keep(live.where("not mixed").select(*span).unionByName(same.select(*span)).distinct(), f"done{label}")
        tmp.drop(live, sums)
        tmp.release()
        return done, kinds.select("t1", "t2", "pos", "k", "n", "m", *c)

    first = found.select("t1", "t2", "pos", F.lit(0).alias("k"), F.lit(1).alias("n"), F.col("c").alias("c1"), F.lit(0).cast("long").alias("c2"), "u")
    done, kinds = settle(first, w, "")
    tmp.drop(found)

    # Buckets of more kinds than a task takes: at most one for each `whole` kinds.
    large = kinds.where(F.col("m") > whole).groupBy("c1").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > whole)
    large = tmp.keep(large.select(F.col("c1").alias("c")), "large")

    # The bytes around one position of each kind, from one document of each text.
    asked = kinds.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "n", "c1")).alias("asks"))
    holder = keyed.groupBy(F.col("__t1").alias("t1"), F.col("__t2").alias("t2")).agg(F.min("__id").alias("__one"), F.count(F.lit(1)).alias("copies"))
    holder = tmp.keep(holder, "holders")
    packed = pack(long_, text, ["__t1", "__t2", "__id"])
    want = asked.join(holder, ["t1", "t2"])
    met = packed.join(want, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")) & F.col("__id").eqNullSafe(F.col("__one")))

    def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            t1, t2 = (p.column(i).to_numpy() for i in (0, 1))
            ends = np.append(0, np.cumsum(p.column(4).value_lengths().to_numpy()))
            pos, n, c = (p.column(i).flatten().to_numpy() for i in (4, 5, 6))
            out: list[bytes] = []
            held, start = 0, 0
            for i, (z, size) in enumerate(zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True)):
                raw = unpack(z, size)
                new = [raw[max(0, x - (w - 1)) : x + least] for x in pos[ends[i] : ends[i + 1]].tolist()]
                out += new
                held += len(new) * least
                if held > CHUNK or i == len(p) - 1:
                    a, b = ends[start], ends[i + 1]
                    doc = np.repeat(np.arange(start, i + 1), np.diff(ends[start : i + 2]))
                    cols = (c[a:b], t1[doc], t2[doc], pos[a:b], n[a:b])
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols], pa.array(out, pa.binary())], names=["c", *key, "n", "bytes"])
                    out, held, start = [], 0, i + 1

    key = ["t1", "t2", "pos"]
    asks = [F.col(f"asks.{x}").alias(f"ask_{x}") for x in ("pos", "n", "c1")]
    ctx = met.select("t1", "t2", "__z", "__size", *asks).mapInArrow(contexts, "c bigint, t1 bigint, t2 bigint, pos int, n int, bytes binary")
    heavy = not large.isEmpty()
    if heavy:
        ctx = tmp.keep(ctx, "contexts")

    def once(t):
        """Without repeated positions, which rows of one text and number hold."""
        x = [t.column(i).to_numpy() for i in range(4)]
        new = np.append(True, np.any([y[1:] != y[:-1] for y in x], axis=0))
        return t if new.all() else t.filter(pa.array(new))

    def buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        roll = Rolling(1)
        for batch in chain(parts, [None]):
            if batch is not None:
                held += [once(batch)] if len(batch) else []
                if sum(map(len, held)) < whole:
                    continue
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            if t is None or not len(t):
                return
            c = t.column(0).to_numpy()
            end = len(t) if batch is None else int(np.searchsorted(c, c[-1]))  # the last bucket may go on
            held = t.slice(end).to_batches()
            if not end:
                continue
            t = once(t.slice(0, end)).combine_chunks()
            c, t1, t2, pos, n = (t.column(i).to_numpy() for i in range(5))
            row, lo, hi = refine_whole((t1, t2, pos, np.minimum(pos, w - 1)), n, c, t.column(5).chunk(0), least, q, roll)
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (t1[row], t2[row], lo.astype(np.int32), hi.astype(np.int32))], names=["t1", "t2", "lo", "hi"])

    here = ctx.join(F.broadcast(large), "c", "left_anti") if heavy else ctx
    here = here.repartition("c").sortWithinPartitions("c", *key).mapInArrow(buckets, "t1 bigint, t2 bigint, lo int, hi int")
    done = done.unionByName(tmp.keep(here, "whole"))
    tmp.release()

    def refine(step: int, per: int):
        """Rows of the next level: each offset range of the last, cut into `per` of `step` offsets, with refined pointers."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roll = Rolling(1)
            for p in parts:
                for s in slices(p, "bytes", CHUNK):
                    t1, t2, pos, k, n, b1, b2 = (s.column(i).to_numpy() for i in (0, 1, 2, 4, 5, 6, 7))
                    data, off = view(s.column(3))
                    i, k, c1, c2, u = cut(step, per, q, least, roll.feed(data), off, (t1, t2, pos, np.minimum(pos, w - 1)), (np.arange(len(s)), k, b1, b2))
                    cols = (t1[i], t2[i], pos[i], k.astype(np.int32), n[i], c1, c2, u.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["t1", "t2", "pos", "k", "n", "c1", "c2", "u"])

        return run

    if heavy:
        near = tmp.bucketed(ctx.join(F.broadcast(large), "c", "left_semi").select(*key, "bytes").dropDuplicates(key), "near", key)
        kinds = kinds.join(F.broadcast(large.withColumnRenamed("c", "c1")), "c1", "left_semi")
        schema = "t1 bigint, t2 bigint, pos int, k int, n int, c1 bigint, c2 bigint, u bigint"
        before = w
        for step in STEPS:
            rows = tmp.keep(near.join(kinds, key).select(*key, "bytes", "k", "n", "c1", "c2").mapInArrow(refine(step, before // step), schema), f"rows{step}")
            more, kinds = settle(rows, step, str(step))
            done = done.unionByName(more)
            tmp.drop(rows)
            before = step
        tmp.drop(near, ctx)
    span = F.shiftleft(F.greatest("lo", F.lit(0)).cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    spans = done.groupBy("t1", "t2").agg(F.collect_list(span).alias("spans"))
    known = tmp.keep(holder.where("copies > 1").select("t1", "t2", "copies").join(spans, ["t1", "t2"], "full").select(F.col("t1").alias("__k1"), F.col("t2").alias("__k2"), (F.coalesce("copies", F.lit(1)) > 1).alias("__again"), F.col("spans").alias("__spans")), "spans")
    tmp.release()

    rest = [c for c in base.columns if c != text]
    z = pack(keyed, text, [*[f"`{c}`" for c in rest], "__t1", "__t2"])
    out = z.join(known, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")), "left").select(*[f"`{c}`" for c in rest], "__z", "__size", "__again", "__spans")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != text] + ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_bytes binary"])

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            m = p.num_columns - 4
            res: list[tuple] = []
            marks = p.column(m + 3)
            bounds, marks = np.append(0, np.cumsum(marks.value_lengths().fill_null(0).to_numpy())), marks.flatten().to_numpy()
            for i, (zz, size, again) in enumerate(zip(*[p.column(m + i).to_pylist() for i in range(3)], strict=True)):
                raw = unpack(zz, size)
                runs: list[tuple[int, int]] = []
                if again and size >= least:
                    runs = [(0, size)]
                elif bounds[i] < bounds[i + 1]:
                    x = np.sort(marks[bounds[i] : bounds[i + 1]])
                    lo, top = x >> 32, np.maximum.accumulate(np.minimum(x & LOW, size))
                    new = lo[1:] > top[:-1]
                    runs = list(zip(lo[np.append(True, new)].tolist(), top[np.append(new, True)].tolist(), strict=True))
                ends = [0, *[x for r in runs for x in r], size]
                kept = b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)) if runs else raw
                res.append((size, size - len(kept), len(runs), kept))
            cols = [pa.array([r[i] for r in res], pa.int64() if i < 3 else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*p.columns[:m], *cols], names=[*p.schema.names[:m], "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return out.mapInArrow(apply, ddl)


