"""Operator 5: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.bytesview import LOWER, MASK, Rolling, mix, slices, view, words
from lexloom.llm.common import SPACE, Scratch, components, in_groups, text_key
from lexloom.llm.suffixes import pack, unpack

CHUNK = 500_000
BLOCK = 128  # texts of a bucket that meet as a block
TABLE = 14  # bits of the tables of random draws
NIBBLE, PER_WORD = 4, 16  # bits of a sample in a sketch, and samples in each of its words


def portions(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about CHUNK bytes in all; one longer text is a run of its own."""
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, end
        at = end


def texts_of(z: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Compressed texts laid end to end, and their bounds."""
    return joined_up([unpack(t, n) for t, n in zip(z.to_pylist(), sizes.to_pylist(), strict=True)])


def joined_up(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def rows_of(col: pa.Array) -> list[np.ndarray | None]:
    """The rows of a list column as views."""
    flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(off[:-1].tolist(), off[1:].tolist(), col.is_valid().to_pylist(), strict=True)]


class Settings(NamedTuple):
    """Bands of rows samples each. Counts of words in at least a share `rare` of the documents are broadcast, all others joined; no result depends on it."""

    shingle: int = 5
    least: float = 0.8
    bands: int = 16
    rows: int = 4
    rare: float = 0.0005
    seed: int = 3


def idf(df: np.ndarray | float, n: int) -> np.ndarray:
    """1 + ln(n / df) / ln(n) of words in df of n documents: 1 for a word in all of them, 2 for a word in one, at every size of the corpus."""
    return (2 - np.log(df) / math.log(max(n, 2))).astype(np.float32)


class Corpus(NamedTuple):
    """Number of documents, and hashes (sorted) with IDF of the words that many documents hold."""

    n: int
    words: np.ndarray
    idf: np.ndarray


class Words(NamedTuple):
    """Words of texts: hashes, bounds by text, each word's text, whether it is common and its place there; places of all others sorted by
    text and hash, which of these are new, and bounds of the new ones by text."""

    hashes: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    common: np.ndarray
    place: np.ndarray
    rarer: np.ndarray
    new: np.ndarray
    distinct: np.ndarray


class Shingles:
    """Weighted shingles of texts: hashes, weights (term frequency times the mean IDF of the words) and bounds by text.

    IDF comes from the number of documents, copies included, that hold a word: from the corpus' common words, else from the
    counts of the text's own rarer ones. Words are runs without ASCII white space, A-Z
    lower-cased; a text of fewer words than a shingle has one shingle of all.
    """

    def __init__(self, settings: Settings, corpus: Corpus | None = None):
        self.s, self.corpus, self.roll = settings, corpus, Rolling(21)

    def word_hashes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[data]
        a, b, at = words(data, off)
        return mix(self.roll.feed(data)(a, b)), at

    def common(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is common, and its place among the common words."""
        if not len(self.corpus.words):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.corpus.words, h), len(self.corpus.words) - 1)
        return self.corpus.words[i] == h, i

    def parse(self, data: np.ndarray, off: np.ndarray) -> Words:
        h, at = self.word_hashes(data, off)
        text = np.repeat(np.arange(len(off) - 1), np.diff(at))
        hit, place = self.common(h)
        left = np.flatnonzero(~hit)
        left = left[np.lexsort((h[left], text[left]))]
        new = np.ones(len(left), bool)
        new[1:] = (h[left[1:]] != h[left[:-1]]) | (text[left[1:]] != text[left[:-1]])
        return Words(h, at, text, hit, place, left, new, np.searchsorted(text[left[new]], np.arange(len(off))))

    def __call__(self, w: Words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """counts: in how many documents the rarer words stand, in the order of `parse`."""
        k, h, at, doc = self.s.shingle, w.hashes, w.bounds, w.text
        count = np.diff(at)
        weights = np.empty(len(h), np.float32)
        weights[w.common] = self.corpus.idf[w.place[w.common]]
        weights[w.rarer] = idf(counts, self.corpus.n)[np.cumsum(w.new) - 1]
        n = len(h)
        grams, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
        for j in range(min(k, n)):
            grams[: n - j] = mix(grams[: n - j] + h[j:]) if j else h
            weight[: n - j] += weights[j:]
        # Full shingles start k - 1 words before a text's end at the latest; a shorter text is hashed as a whole.
        inside = np.arange(n) + k <= at[doc + 1]
        weight /= k
        for d in np.flatnonzero((count > 0) & (count < k)):
            g, f = h[at[d]], at[d]
            for x in h[f + 1 : at[d + 1]]:
                g = mix(np.array([g], np.uint64) + x)[0]
            grams[f], weight[f], inside[f] = g ^ np.uint64(0xABCDEF), weights[f : at[d + 1]].mean(), True
        doc, grams, weight = doc[inside], grams[inside], weight[inside]
        order = np.lexsort((grams, doc))
        doc, grams, weight = doc[order], grams[order], weight[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        begin = np.flatnonzero(first)
        tf = np.diff(np.r_[begin, len(doc)])
        doc, grams, weight = doc[begin], grams[begin], (weight[begin] * tf).astype(np.float32)
        return grams, weight, np.searchsorted(doc, np.arange(len(count) + 1))


class Sampler:
    """ICWS: for sample k and a shingle of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn by shingle and k,
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the sample is (shingle, t) of least a.

    Two texts agree in a sample with the probability of their weighted Jaccard similarity. Draws stand in tables of 2^14
    entries, chosen by a hash of the shingle that is new for each k; shingles with one entry are told apart by their hash.
    """

    def __init__(self, settings: Settings):
        self.s = settings
        rng = np.random.Generator(np.random.PCG64(settings.seed))
        n = 1 << TABLE
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.lc = (np.log(rng.gamma(2, 1, n)) - self.r).astype(np.float32)
        self.odd = rng.integers(1, 1 << 63, settings.bands * settings.rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, grams: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes of each text that has shingles (texts x bands), and its sketch: NIBBLE bits of each sample, in 64-bit words."""
        s, full, n = self.s, np.flatnonzero(np.diff(at) > 0), len(grams)
        begin = at[full]
        lw, count = np.log(weight), np.diff(np.append(begin, n))
        out = np.zeros((len(full), s.bands), np.uint64)
        sketch = np.zeros((len(full), -(-s.bands * s.rows // PER_WORD)), np.uint64)
        if not len(full):
            return out, sketch
        h, place = np.empty(n, np.uint64), np.empty(n, np.uint64)
        r, b, a, t = (np.empty(n, np.float32) for _ in range(4))
        for k in range(s.bands * s.rows):
            np.multiply(grams, self.odd[k], out=h)
            np.right_shift(h, np.uint64(64 - TABLE), out=place)
            for table, to in ((self.r, r), (self.b, b), (self.lc, a)):
                np.take(table, place.view(np.int64), out=to, mode="clip")
            np.divide(lw, r, out=t)
            t += b
            np.floor(t, out=t)
            b -= t
            b *= r
            a += b
            # Few shingles have the least a of their text; of several, one of the least identity of (shingle, t).
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begin), count))
            who = (h[hit] ^ (h[hit] >> np.uint64(29)) ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(0xFFFFFFFF)
            if len(hit) > len(full):
                who = np.minimum.reduceat(who, np.searchsorted(hit, begin))
            j = k // s.rows
            out[:, j] = mix(out[:, j] ^ who + np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & MASK))
            sketch[:, k // PER_WORD] |= (who >> np.uint64(12) & np.uint64(15)) << np.uint64(NIBBLE * (k % PER_WORD))
        return out, sketch


def enough(settings: Settings, miss: float = 1e-5) -> int:
    """How many samples of two sketches agree if the texts are similar enough, but for a chance of `miss`."""
    n, p = settings.bands * settings.rows, settings.least + (1 - settings.least) / (1 << NIBBLE)
    sure, m = 0.0, 0
    while sure + (step := math.comb(n, m) * p**m * (1 - p) ** (n - m)) <= miss:
        sure, m = sure + step, m + 1
    return m


def likely(settings: Settings, s1: Column, w1: Column, s2: Column, w2: Column) -> Column:
    """Whether two texts may be similar enough: neither total weight is less than `least` of the other's, which is exact, and their sketches agree."""
    n = settings.bands * settings.rows
    apart = F.lit(0)
    for i in range(-(-n // PER_WORD)):
        x = s1[i].bitwiseXOR(s2[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.least(w1, w2) >= F.greatest(w1, w2) * (settings.least * 0.9999)) & (apart <= n - enough(settings))


def similarity(g1: np.ndarray, w1: np.ndarray, g2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of shingles."""
    i = np.minimum(np.searchsorted(g2, g1), len(g2) - 1)
    hit = g2[i] == g1
    both = float(np.minimum(w1[hit], w2[i[hit]]).sum(dtype=np.float64))
    whole = float(w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64)) - both
    return both / whole if whole else 0.0


def count_words(docs: DataFrame, text: str, settings: Settings, tmp: Scratch) -> tuple[Corpus, DataFrame]:
    """The corpus' common words, and a table (w, n) of the words in at least two documents that are not common. Counts cover every document."""
    shingles = Shingles(settings)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, rows = [], [], 0

        def out() -> pa.RecordBatch:
            h, i = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(i, np.concatenate(sums)).astype(np.int64))], names=["w", "n"])

        for p in parts:
            for s in slices(p, "t", CHUNK):
                data, off = view(s.column(0))
                h, at = shingles.word_hashes(data, off)
                pair = np.repeat(np.arange(len(s), dtype=np.uint64), np.diff(at))
                order = np.lexsort((pair, h))
                h, pair = h[order], pair[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])
                u, c = np.unique(h[new], return_counts=True)
                held.append(u)
                sums.append(c)
                rows += len(u)
                if rows > 1_000_000:
                    yield out()
                    held, sums, rows = [], [], 0
        if held:
            yield out()

    src = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    n = docs.count()
    seen = src.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    seen, least = tmp.keep(seen, "words"), math.ceil(settings.rare * n)
    table = seen.where(F.col("n") >= least).toArrow()
    h = np.array(table.column("w").to_pylist(), np.int64).view(np.uint64)
    df = np.array(table.column("n").to_pylist(), np.float64)
    order = np.argsort(h)
    return Corpus(n, h[order], idf(df[order], n)), seen.where(F.col("n") < least)


def merge(labels: DataFrame | None, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, root) after further edges: components of the graph whose nodes are the roots so far."""
    if labels is None:
        return components(edges, tmp)
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("root").alias("__r")), end, "left").withColumn(end, F.coalesce("__r", end)).drop("__r")
    roots = components(edges.where("a <> b"), tmp)
    moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("__up")), "root", "left").select("node", F.coalesce("__up", "root").alias("root"))
    return tmp.keep(moved.unionByName(roots.join(labels.select("node"), "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Adds class_id (smallest doc_id of the class of near duplicates), class_size (rows in it) and kept to each row.

    Linked are equal texts and texts whose weighted Jaccard similarity over shingles is at least `settings.least`; classes are what
    links reach. kept holds for one row of each class: that with the smallest doc_id (null first), of equal ones any one.
    Null, empty and blank texts have no words: each is a class of its own and is kept. class_id of a class whose smallest doc_id
    is null is null. doc_id holds whole numbers. Columns of the added names are replaced, others pass through (names that begin with __ are reserved).

    Each distinct text enters once. In every band, texts are compared with one of their bucket, then what is not yet connected
    with another one. A bucket of thousands of copies costs one comparison each. After two such rounds, texts of different classes
    meet in their buckets block by block (two texts of similarity 0.8 share a bucket with probability 0.9998); what leaves a block are
    the links that connect its classes, never its pairs. Before texts are compared, a pair's total weights and sketches of all
    samples must allow the similarity (they do in all but 1e-5 of cases at 0.8), so texts that only share a common passage are told
    apart there; texts only move to the blocks of pairs that pass. Buckets and edges are rows; no bucket is collected in a task.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "minhash")
    a, b = text_key(text)
    base = docs.drop("class_id", "class_size", "kept")
    keyed = base.withColumns({"__t1": a, "__t2": b})
    real = keyed.where(F.col(f"`{text}`").rlike(f"[^{SPACE}]"))
    corpus, rarer = count_words(base, text, settings, tmp)
    corpus = spark.sparkContext.broadcast(corpus)

    # Distinct texts, each once and where its hash puts it; their words that are too rare to be broadcast ask for their counts.
    packed = pack(real, text, ["__t1", "__t2"]).groupBy(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"))
    distinct = packed.agg(F.first(F.struct(F.col("__z").alias("z"), F.col("__size").alias("size"))).alias("s")).select("t1", "t2", "s.*")
    distinct = tmp.bucketed(distinct.withColumn("i", F.monotonically_increasing_id()), "distinct", ["t1", "t2"])
    tmp.release()

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(settings, corpus.value)
        for p in parts:
            for at, end in portions(p.column(2)):
                w = shingles.parse(*texts_of(p.column(1).slice(at, end - at), p.column(2).slice(at, end - at)))
                first = w.rarer[w.new]
                k = np.arange(len(first)) - w.distinct[w.text[first]]
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes[first].view(np.int64)), p.column(0).slice(at, end - at).take(pa.array(w.text[first])), pa.array(k.astype(np.int32))], names=["w", "i", "k"])

    asked = distinct.select("i", "z", "size").mapInArrow(ask, "w bigint, i bigint, k int")
    counted = asked.join(rarer, "w").select("i", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("n")).alias("kn"))
    lists = counted.groupBy("i").agg(F.collect_list("kn").alias("kn"))
    lists = tmp.keep(lists.join(distinct.select("i", "t1", "t2"), "i").select("t1", "t2", "kn"), "lists")
    tmp.drop(rarer)
    tmp.release()

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler = Shingles(settings, corpus.value), Sampler(settings)
        for p in parts:
            for start, end in portions(p.column(4)):
                s = p.slice(start, end - start)
                words = shingles.parse(*texts_of(s.column(3), s.column(4)))
                counts = np.ones(words.distinct[-1], np.int32)
                for at, kn in zip(words.distinct.tolist(), rows_of(s.column(5)), strict=False):
                    if kn is not None:
                        counts[at + (kn >> 32)] = kn & 0xFFFFFFFF
                grams, weight, at = shingles(words, counts)
                bands, sketch = sampler(grams, weight, at)
                rare = pa.array([counts[a:b].tobytes() for a, b in zip(words.distinct[:-1].tolist(), words.distinct[1:].tolist(), strict=True)], pa.binary())
                two = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (bands, sketch)]
                whole = pa.array(np.add.reduceat(weight, at[:-1], dtype=np.float64))
                yield pa.RecordBatch.from_arrays([*s.columns[:3], rare, *two, whole], names=["t1", "t2", "i", "rare", "bands", "sketch", "weight"])

    signed = distinct.join(lists, ["t1", "t2"], "left").select("t1", "t2", "i", "z", "size", "kn")
    signed = tmp.keep(signed.mapInArrow(sign, "t1 bigint, t2 bigint, i bigint, rare binary, bands array<bigint>, sketch array<bigint>, weight double"), "signed")
    tmp.drop(lists)
    tmp.release()
    members = signed.select("i", F.posexplode("bands").alias("j", "h"))
    # Tables of buckets are written: joined from there, Spark deals out the rows of a hot bucket to several tasks.
    shared = tmp.keep(members.groupBy("j", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    members = members.join(shared, ["j", "h"]).join(signed.select("i", "sketch", "weight"), "i")
    members = tmp.keep(members, "members")

    own = signed.select("t1", "t2", "i", "rare").join(members.select("i").distinct(), "i", "left_semi")
    texts = tmp.keep(distinct.select("t1", "t2", "z", "size").join(own, ["t1", "t2"]).select("i", "z", "size", "rare"), "texts")
    tmp.drop(distinct)

    def verify(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are similar enough."""
        left, right = (texts.select(F.col("i").alias(e), *[F.col(c).alias(c + e) for c in ("z", "size", "rare")]) for e in "ab")
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "sizea", "rarea", "zb", "sizeb", "rareb")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(settings, corpus.value)
            for p in parts:
                size = pc.add(p.column(3), p.column(6))
                for at, end in portions(size):
                    cols = [c.slice(at, end - at).to_pylist() for c in p.columns]
                    names: dict[int, int] = {}
                    raw, rare = [], []
                    for row in zip(*cols, strict=True):
                        for k, z, n, r in ((row[0], *row[2:5]), (row[1], *row[5:])):
                            if k not in names:
                                names[k] = len(raw)
                                raw.append(unpack(z, n))
                                rare.append(r)
                    grams, weight, bound = shingles(shingles.parse(*joined_up(raw)), np.frombuffer(b"".join(rare), np.int32))
                    part = [(grams[bound[k] : bound[k + 1]], weight[bound[k] : bound[k + 1]]) for k in range(len(raw))]
                    good = [i for i, (x, y) in enumerate(zip(cols[0], cols[1], strict=True)) if similarity(*part[names[x]], *part[names[y]]) >= settings.least]
                    yield pa.RecordBatch.from_arrays([pa.array([cols[k][i] for i in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return met.mapInArrow(run, "a bigint, b bigint")

    held, needed = dict[str, Shingles](), enough(settings)
    nibble = np.arange(settings.bands * settings.rows)

    def likely_pairs(t: pa.Table, a: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows of a block pair that may be similar, in their first common bucket and of two classes, and how many samples agree."""
        j, bi, bj, root, w, block = (t.column(c).slice(a, e - a).to_numpy() for c in ("j", "bi", "bj", "root", "weight", "b"))
        bands, words = (np.stack(rows_of(t.column(c).slice(a, e - a).combine_chunks())) for c in ("bands", "sketch"))
        may = np.triu(root[:, None] != root[None, :], 1)
        if bi[0] != bj[0]:
            may &= block[:, None] != block[None, :]
        may &= np.minimum.outer(w, w) >= np.maximum.outer(w, w) * (settings.least * 0.9999)
        x, y = np.nonzero(may)
        if len(x):
            early = (bands[x, : j[0]] != bands[y, : j[0]]).all(1)
            x, y = x[early], y[early]
        nibbles = (words.view(np.uint64)[:, nibble // PER_WORD] >> (NIBBLE * (nibble % PER_WORD)).astype(np.uint64)).astype(np.uint8) & 15
        agree = (nibbles[x] == nibbles[y]).sum(1)
        ok = agree >= needed
        return x[ok], y[ok], agree[ok]

    def wanted(t: pa.Table, a: int, e: int) -> pa.RecordBatch | None:
        """The rows of a block pair whose texts have to be compared."""
        if e - a < 2:
            return None
        x, y, _ = likely_pairs(t, a, e)
        rows = pa.array(a + np.union1d(x, y))
        return t.take(rows).combine_chunks().to_batches()[0] if len(rows) else None

    def meet(t: pa.Table, a: int, e: int) -> pa.RecordBatch | None:
        """Links between the texts of two blocks of a bucket: enough to connect what is similar."""
        xs, ys, agree = likely_pairs(t, a, e)
        shingles = held.get("s") or held.setdefault("s", Shingles(settings, corpus.value))
        part: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size, need = t.column("size").slice(a, e - a), np.union1d(xs, ys)
        z, rare = (t.column(c).slice(a, e - a) for c in ("z", "rare"))
        for at, end in portions(size.take(pa.array(need)).combine_chunks()):
            raw = [unpack(z[k].as_py(), size[k].as_py()) for k in need[at:end].tolist()]
            held_counts = np.frombuffer(b"".join([rare[k].as_py() for k in need[at:end].tolist()]), np.int32)
            grams, weight, bound = shingles(shingles.parse(*joined_up(raw)), held_counts)
            part |= {x: (grams[bound[n] : bound[n + 1]], weight[bound[n] : bound[n + 1]]) for n, x in enumerate(need[at:end].tolist())}
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        out, names, i = [], t.column("root").slice(a, e - a).to_pylist(), t.column("i").slice(a, e - a).to_pylist()
        order = np.argsort(-agree, kind="stable")
        for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
            ra, rb = top(names[x]), top(names[y])
            if ra != rb and similarity(*part[x], *part[y]) >= settings.least:
                up[max(ra, rb)] = min(ra, rb)
                out.append((i[x], i[y]))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    labels, rounds = None, 2
    for r in range(rounds + 1):
        state = members
        if labels is not None:
            state = members.join(labels.withColumnRenamed("node", "i"), "i", "left")
        else:
            state = state.withColumn("root", F.lit(None).cast("long"))
        state = state.select("j", "h", "i", F.coalesce("root", "i").alias("root"), "sketch", "weight")
        # First the same text wherever it stands, as one comparison joins a copy; then another in each bucket, for texts that few resemble.
        draw = F.xxhash64(F.lit(r), "i") if r == 0 else F.xxhash64(F.lit(r), "j", "h", "i")
        split = state.groupBy("j", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(draw, "i")).alias("p")).where("lo <> hi")
        split = tmp.keep(split.select("j", "h", F.col("p.i").alias("p")), "split")
        open_ = tmp.keep(state.join(split, ["j", "h"]), "open")
        if r < rounds:
            # The pivot's own class is not compared again.
            own = open_.where("i = p").select("j", "h", F.col("root").alias("pr"), F.col("sketch").alias("ps"), F.col("weight").alias("pw"))
            met = open_.join(own, ["j", "h"]).where((F.col("root") != F.col("pr")) & likely(settings, F.col("sketch"), F.col("weight"), F.col("ps"), F.col("pw")))
            found = verify(met.select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct())
        else:
            # What is left, such as copies that differ from most others, meets in blocks; block i meets block j >= i once.
            sizes = tmp.keep(open_.groupBy("j", "h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")), "blocks")
            here = open_.join(sizes, ["j", "h"]).join(signed.select("i", "bands"), "i")
            here = here.withColumn("b", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int"))
            duo = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj")))
            group = ["j", "h", "bi", "bj"]
            here = here.select("j", "h", F.inline(duo), "i", "root", "b", "weight", "sketch", "bands")
            # Ids, weights and sketches meet first; texts only go where two of them may be similar.
            need = tmp.keep(in_groups(here, group, wanted, ", ".join(f"{c} {kind}" for c, kind in here.dtypes)), "wanted")
            found = in_groups(need.join(texts, "i"), group, meet, "a bigint, b bigint", rows=2_000)
        new = tmp.keep(found, "links")
        if new.limit(1).count():
            labels = merge(labels, new, tmp)
        if not open_.limit(1).count():
            break
    # Classes over distinct texts; then over rows.
    number = F.col(f"`{doc_id}`").cast("long")
    keys = signed.select("i", "t1", "t2")
    joined = keys.join(labels.withColumnRenamed("node", "i"), "i", "left") if labels is not None else keys.withColumn("root", F.lit(None).cast("long"))
    joined = tmp.keep(joined.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.coalesce("root", "i").alias("root")), "joined")
    rows = keyed.groupBy("__t1", "__t2", number.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    least = F.min(F.struct(F.col("d").isNotNull().alias("x"), "d", "c")).alias("m")
    per_text = rows.groupBy("__t1", "__t2").agg(least, F.sum("c").alias("n")).select("__t1", "__t2", F.struct("m.x", "m.d", F.col("__t1").alias("k1"), F.col("__t2").alias("k2"), "m.c").alias("m"), "n")
    per_text = per_text.join(joined, (F.col("__t1") == F.col("k1")) & (F.col("__t2") == F.col("k2")))
    classes = per_text.groupBy("root").agg(F.min("m").alias("f"), F.sum("n").alias("size")).where("size > 1").select("root", "f.d", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), (F.col("f.c") > 1).alias("__tie"), "size")
    plan = classes.join(joined, "root")
    plan = tmp.keep(plan.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("d").alias("class_id"), "__tie", F.col("size").alias("class_size"), ((F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).alias("__mine")), "plan")
    met = keyed.join(plan, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")), "left")
    alone = F.col("class_size").isNull()
    met = met.withColumn("__pick", alone | (F.col("__mine") & number.eqNullSafe(F.col("class_id"))))
    cols = [*[F.col(f"`{c}`") for c in base.columns], F.when(alone, number).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")]
    if not plan.where("__tie").limit(1).count():
        return met.select(*cols, F.col("__pick").alias("kept"))
    # Several rows have the text and the doc_id that stay: one of them does.
    tied = F.col("__pick") & F.coalesce("__tie", F.lit(False))
    nth = F.row_number().over(Window.partitionBy("__t1", "__t2").orderBy("__t1"))
    out = met.where(~tied).select(*cols, F.col("__pick").alias("kept"))
    return out.unionByName(met.where(tied).withColumn("__nth", nth).select(*cols, (F.col("__nth") == 1).alias("kept")))
