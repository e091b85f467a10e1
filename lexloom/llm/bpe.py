"""Operator 3: byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is an array of token ids. The leaves of its tree hold (rank, position) of the pair that begins there, each inner
node the lesser of its children, so the root yields the leftmost pair of lowest rank. A merge changes three leaves, whose
paths to the root are recomputed; it ends when the root holds no pair. Words of at most 64 bytes are merged in step, one
tree each in the rows of one array; longer ones with a tree of their own. Texts are cut, their words told apart and ids and
tokens laid end to end as whole columns; Python sees each different word of a slice once.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesview import slices

NONE = 1 << 62
#: Bytes of text that are encoded at once.
SLICE = 8_000_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\sLN]+|\s+(?!\S)|\s+"""
# White space of the pattern other than blank and line feed.
ODD_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Ranges of letters and numbers assigned after Unicode 16, which the tokenizer's classes end with.
LATE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)


def latin(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Words of a text by PATTERN, L and N being the letters and numbers of Unicode 16 whatever later ones the regex package knows."""

    def __init__(self):
        import regex

        late = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATE)
        self.late = regex.compile(f"[{late}]").search
        self.plain = regex.compile(PATTERN.replace("L", r"\p{L}").replace("N", r"\p{N}")).findall
        known = PATTERN.replace("[^\\sLN]", rf"(?:[{late}]|[^\s\p{{L}}\p{{N}}])")
        self.exact = regex.compile(known.replace(" ?L+", rf" ?(?:(?![{late}])\p{{L}})+").replace(" ?N+", rf" ?(?:(?![{late}])\p{{N}})+")).findall

    def __call__(self, t: str) -> list[str]:
        return self.plain(t) if t.isascii() or latin(t) or not self.late(t) else self.exact(t)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_model(path: str) -> dict:
    """Tables of a byte-level tokenizer file: token bytes by id, ids of bytes, merges by pair, and special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    tokens: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens |= {i: s.encode() for s, i in special.items()}
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
    first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    return {"tokens": tokens, "bytes": first, "merges": merges, "special": special, "slots": slots(merges)}


BITS = 18


def slot(want: np.ndarray, k: int) -> np.ndarray:
    return (want * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])) >> np.uint64(64 - BITS)


def slots(merges: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in a table where each stands in one of two slots: pair, rank and merged id by slot."""
    pair, value = np.zeros((2, 1 << BITS), np.int64) - 1, np.zeros((2, 1 << BITS), np.int64)
    keys = np.array([a << 32 | b for a, b in merges], np.int64)
    at = np.stack([slot(keys.view(np.uint64), k) for k in (0, 1)])
    for i in range(len(keys)):
        k = 0
        for _ in range(500):
            j = at[k, i]
            i, pair[k, j], value[k, j] = value[k, j] if pair[k, j] >= 0 else -1, keys[i], i
            if i < 0:
                break
            k = 1 - k
        else:
            raise ValueError("too many merges for the table")
    ranks = np.array([r for r, _ in merges.values()], np.int64)
    made = np.array([m for _, m in merges.values()], np.int64)
    return pair, ranks[value], made[value]


class Encoder:
    """Encodes words by segment trees; a bounded table remembers the ids of words seen before."""

    def __init__(self, model: dict, remember: int = 2_000_000):
        import regex

        self.bytes = np.array(model["bytes"], np.int64)
        self.merges, self.special, self.remember = model["merges"], model["special"], remember
        self.pair, self.rank, self.made = model["slots"]
        self.forget()
        self.split = Splitter()
        self.tokens = model["tokens"]
        self.token_column = pa.array([self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)], pa.large_binary())
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and merged id of pairs."""
        want = a << 32 | b
        i, j = slot(want.view(np.uint64), 0), slot(want.view(np.uint64), 1)
        first = self.pair[0, i] == want
        hit = (first | (self.pair[1, j] == want)) & (a >= 0) & (b >= 0)
        return np.where(hit, np.where(first, self.rank[0, i], self.rank[1, j]), NONE), np.where(first, self.made[0, i], self.made[1, j])

    def _batch(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most `width` bytes (a power of two), all trees at once."""
        n = len(words)
        size = np.array([len(w) for w in words])
        flat = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = flat
        col = np.arange(width)
        nxt = np.where(col + 1 < size[:, None], col + 1, -1)
        prv = np.broadcast_to(col - 1, (n, width)).copy()
        right = np.concatenate([ids[:, 1:], np.full((n, 1), -1)], 1)
        rank, made = self._look(ids, right)
        tree = np.full((n, 2 * width), NONE, np.int64)
        shift = width.bit_length()  # a leaf holds rank and position in one number
        tree[:, width:] = np.where(rank < NONE, rank << shift | col, NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            p = tree[live, 1] & ((1 << shift) - 1)
            q = nxt[live, p]
            after, before = nxt[live, q], prv[live, p]
            made[live, p], new = made[live, p], made[live, p]
            ids[live, p], ids[live, q] = new, -1
            nxt[live, p] = after
            has = after >= 0
            prv[live[has], after[has]] = p[has]
            r, m = self._look(new, np.where(has, ids[live, after], -1))
            made[live, p] = m
            tree[live, width + p] = np.where(r < NONE, r << shift | p, NONE)
            tree[live, width + q] = NONE
            has = before >= 0
            lb, pb = live[has], before[has]
            r, m = self._look(ids[lb, pb], new[has])
            made[lb, pb] = m
            tree[lb, width + pb] = np.where(r < NONE, r << shift | pb, NONE)
            for rows, leaf in ((live, p), (live, q), (lb, pb)):
                k = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                    k = k >> 1
            live = live[tree[live, 1] < NONE]
        keep = ids >= 0
        out, ends = ids[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, word: bytes) -> bytes:
        """Ids of one word of any length, with a tree of its own."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        width = 1 << max(0, n - 1).bit_length()
        get, none = self.merges.get, (NONE, 0)
        tree: list[tuple[int, int]] = [(NONE, 0)] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = (get((ids[i], ids[i + 1]), none)[0], i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]

        def put(i: int, rank: int) -> None:
            k = width + i
            tree[k] = (rank, i)
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a <= b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1][0] < NONE:
            p = tree[1][1]
            q = nxt[p]
            ids[p], ids[q] = get((ids[p], ids[q]))[1], -1
            nxt[p] = nxt[q]
            put(q, NONE)
            if nxt[p] >= 0:
                prv[nxt[p]] = p
            put(p, get((ids[p], ids[nxt[p]]), none)[0] if nxt[p] >= 0 else NONE)
            if prv[p] >= 0:
                put(prv[p], get((ids[prv[p]], ids[p]), none)[0])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def plain(self, t: str) -> bool:
        """Whether every white space of a text is one blank or line feed between others.

        Then a line feed, and what stands up to the next blank or line feed with the blank before it, are split alike on
        their own: no word of the pattern goes over such a bound.
        """
        if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or "\0" in t or t[:1] in " \n" or t[-1:] in " \n":
            return False
        return not any(c in t for c in (ODD_SPACE[:4] if t.isascii() else ODD_SPACE))

    def forget(self) -> None:
        """Empties the table of words seen before, but for special tokens."""
        self.words = pa.array(["\0special" + s for s in self.special], pa.large_string())
        self.codes = pa.array([np.array([i], "<u4").tobytes() for i in self.special.values()], pa.large_binary())

    def ids_of(self, kinds: pa.Array, units: bool = False) -> pa.Array:
        """Ids of different words, or of units of plain texts; what is not in the table is added to it."""
        at = pc.index_in(kinds, value_set=self.words)
        if not at.null_count:
            return self.codes.take(at)
        new = kinds.filter(at.is_null())
        codes = self._units(new.to_pylist()) if units else self._words(new.to_pylist())
        at = pc.fill_null(at, -1).to_numpy().copy()
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words, self.codes = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.codes, codes])
        return self.codes.take(pa.array(at))

    def _units(self, units: list[str]) -> pa.Array:
        # A line feed between units is a word of its own, whatever stands around it.
        some = [u for u in units if u != "\n"]
        flat = self.split("\n".join(some)) if some else []
        if len(flat) != 2 * len(some) - 1:
            parts: list[list[str]] = [[]]
            for w in flat:
                if w == "\n":
                    parts.append([])
                else:
                    parts[-1].append(w)
        else:
            parts = [[w] for w in flat[::2]]
        words = pa.array([w for p in parts for w in p] + ["\n"], pa.large_string()).dictionary_encode()
        ids, off = whole(self._of_words(words.dictionary), words.indices)
        cuts = off[np.cumsum([0, *map(len, parts), 1])].tolist()
        codes = [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(some) < len(units):
            codes.insert(units.index("\n"), codes[-1])
        return pa.array(codes[: len(units)], pa.large_binary())

    def _of_words(self, kinds: pa.Array) -> pa.Array:
        at = pc.index_in(kinds, value_set=self.words)
        new = self._words(kinds.filter(at.is_null()).to_pylist())
        at = pc.fill_null(at, -1).to_numpy().copy()
        at[at < 0] = len(self.words) + np.arange(len(new))
        return pa.concat_arrays([self.codes, new]).take(pa.array(at))

    def _words(self, words: list[str]) -> pa.Array:
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            b = w.encode()
            groups.setdefault(max(1, 1 << (len(b) - 1).bit_length()), []).append((i, b))
        out = [b""] * len(words)
        for width, group in groups.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(group), step):
                part = [b for _, b in group[k : k + step]]
                codes = [self.encode_long(b) for b in part] if width > 64 else self._batch(part, width)
                for (i, _), c in zip(group[k : k + step], codes, strict=True):
                    out[i] = c
        return pa.array(out, pa.large_binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        plain: list[int] = []
        words: list[str] = []
        other: list[tuple[int, int]] = []  # text and its number of words
        for i, t in enumerate(texts):
            if self.at_special is not None and any(s in t for s in self.special):
                mine = []
                for k, x in enumerate(self.at_special.split(t)):
                    mine += ["\0special" + x] if k % 2 else self.split(x)
            elif self.plain(t):
                plain.append(i)
                continue
            else:
                mine = self.split(t)
            other.append((i, len(mine)))
            words += mine
        if len(self.words) > self.remember:
            self.forget()

        # Units of plain texts begin at a blank, at and after a line feed, and where a text begins.
        joined = b"".join([raw[i] for i in plain])
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *[len(raw[i]) for i in plain]])
        line = data == 10
        bound = line | (data == 32)
        bound[1:] |= line[:-1]
        bound[begins[:-1][begins[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(bound), len(data))
        units = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined)).dictionary_encode()
        words_ = pa.array(words, pa.large_string()).dictionary_encode()

        out: list[bytes] = [b""] * len(texts)
        for column, ends, who in (
            (units, np.searchsorted(at, begins), plain),
            (words_, np.cumsum([0, *[n for _, n in other]]), [i for i, _ in other]),
        ):
            if len(column):
                ids, off = whole(self.ids_of(column.dictionary, column is units), column.indices)
                cuts = off[ends].tolist()
                for i, x, y in zip(who, cuts[:-1], cuts[1:], strict=True):
                    out[i] = ids[x:y]
        return out

    def decode_all(self, codes: list[bytes], expected: list[str]) -> list[bytes]:
        """UTF-8 of the texts of ids, as `decode` gives them. Bytes that equal those of the expected text need no check."""
        ids = np.frombuffer(b"".join(codes), "<u4")
        text, off = whole(self.token_column, pa.array(ids))
        cuts = off[np.cumsum([0, *[len(c) // 4 for c in codes]])].tolist()
        back = [text[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return [b if b == t.encode() else b.decode("utf-8", "replace").encode() for b, t in zip(back, expected, strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def whole(values: pa.Array, at: pa.Array) -> tuple[bytes, np.ndarray]:
    """The binary values at these places end to end, and the offsets of each."""
    if not len(at):
        return b"", np.zeros(1, np.int64)
    got = values.take(at)
    off = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1]
    return got.buffers()[2].to_pybytes() if got.buffers()[2] is not None else b"", off


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """Adds bpe_ids (array of int; only with ids), bpe_text (only with decoded), n_tokens, ids_sha256 and decoded_sha256.

    Words are those of Unicode 16, as in the tokenizers library. Null text counts as empty: no tokens, the hash of nothing. Whole texts are encoded, of any length; repeated rows give
    repeated results; other columns pass through, except that columns of the added names are replaced.
    """
    added = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    added += [("bpe_ids", pa.list_(pa.int32()))] * ids + [("bpe_text", pa.string())] * decoded
    names = [n for n, _ in added]
    rest = [c for c in docs.columns if c not in names and c != text]
    ddl = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "bpe_ids": "array<int>", "bpe_text": "string"}
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")) if text not in names else docs
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields] + [f"{n} {ddl[n]}" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small strings and no cycles
        try:
            yield from encoded(batches)
        finally:
            gc.enable()  # the process serves other tasks

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The words learnt stay with the worker's copy of the model, for its next tasks.
        enc = model.value.get("encoder") or model.value.setdefault("encoder", Encoder(model.value))
        for held in batches:
            for batch in slices(held, text, SLICE):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                codes = enc.encode(texts)
                back = enc.decode_all(codes, texts)
                cols = {
                    "n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                    "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                }
                if ids:
                    ends = np.cumsum([0] + [len(c) // 4 for c in codes])
                    cols["bpe_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32)))
                if decoded:
                    cols["bpe_text"] = pa.array([t.decode() for t in back], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[cols[n] for n in names]], names=[*batch.schema.names, *names])

    return src.mapInArrow(run, schema)

