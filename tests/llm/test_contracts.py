"""Each opN query against brute force, on the smallest table with awkward rows added and with an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def awkward_documents() -> list[tuple]:
    rng = random.Random(4)
    base = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    long = "\n".join(" ".join(rng.choice(["one", "two", "three", "é", "x" * 90]) + str(rng.randrange(400)) for _ in range(30)) for _ in range(150))
    extra = [None, "", " \n\t", "a", "ab cd", "z" * 700, "ab" * 350, long, long + " tail", "  Same line of twenty and more \nother", "same LINE of twenty and more\nb", "c\nsame line of twenty and more  ", "😀 " * 300, "w " * 40, "<|endoftext|> x", rows[3][1], rows[3][1], rows[4][1][: len(rows[4][1]) // 2]]
    rows += [(10_000 + i, t, "en", None if i % 3 else "src0", None) for i, t in enumerate(extra)]
    return rows


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    rows = awkward_documents()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), d / "documents.parquet")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist() + [{"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 1, "quality": None, "toxic": None}]
    pq.write_table(pa.Table.from_pylist(labels, pq.read_schema(f"{SF}/labels.parquet")), d / "labels.parquet")
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    odd = [None, "", "no scheme", "http://", "http://ORG", "https://Sub.Example.ORG/es/x?y#z", "ftp://a.org#f/x", "http://example.org/en/12", "x://com/fr/", "http://wwworg/", "http://m.example.com/de/1/?utm_x=1&b=2&a=1"]
    pages += [{"page_id": 9_000 + i, "url": u, "html": "scum" if i % 4 == 0 else None} for i, u in enumerate(odd)]
    pq.write_table(pa.Table.from_pylist(pages, pq.read_schema(f"{SF}/pages.parquet")), d / "pages.parquet")
    v = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rng = np.random.default_rng(2)
    for i in range(60):
        e = np.array(v[i % 7]["embedding"], float) + rng.normal(size=64) * 0.012 * (i % 5)
        v.append({"vec_id": 5_000 + i, "embedding": e.tolist(), "label": v[i % 7]["label"]})
    for i, e in enumerate([None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]):
        v.append({"vec_id": 6_000 + i, "embedding": e, "label": 1})
    v.append({"vec_id": 7_000, "embedding": v[0]["embedding"], "label": None})
    pq.write_table(pa.Table.from_pylist(v, pq.read_schema(f"{SF}/embeddings.parquet")), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_schema(f"{SF}/{t}.parquet").empty_table(), d / f"{t}.parquet")
    return str(d)


def table(d: str, name: str) -> list[dict]:
    return pq.read_table(f"{d}/{name}.parquet").to_pylist()


def result(spark, d: str, name: str, key: str = "doc_id") -> dict[int, dict]:
    rows = [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op1(spark, data):
    got, docs = result(spark, data, "op1_sharding"), table(data, "documents")
    assert set(got) == {r["doc_id"] for r in docs}
    for r in docs:
        raw = (r["text"] or "").encode()
        assert got[r["doc_id"]]["size"] == len(raw) + 16 and got[r["doc_id"]]["text_crc32"] == zlib.crc32(raw)
    per = defaultdict(list)
    for r in got.values():
        per[r["shard"]].append(r["slot"])
    assert set(per) == set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    sizes = [len(x) for x in per.values()]
    assert max(sizes) - min(sizes) <= 1
    groups = defaultdict(set)
    count = Counter(r["text"] or "" for r in docs)
    for r in docs:
        groups[r["text"] or ""].add(got[r["doc_id"]]["shard"])
    small = [len(s) for t, s in groups.items() if 1 < count[t] <= 4]
    assert sum(x == 1 for x in small) >= 0.9 * len(small)


def test_op1_hot_group(spark):
    from lexloom.llm.sharding import shard

    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3_000)], "i int, t string")
    out = shard(df, ["t"], ["i"], shards=7).toPandas()
    assert sorted(out.i) == list(range(3_000))
    n = out.groupby("shard").size()
    assert len(n) == 7 and n.max() - n.min() <= 1
    assert (out.sort_values(["shard", "slot"]).groupby("shard").slot.apply(list).map(lambda x: x == list(range(len(x))))).all()
    per = out.groupby("t").shard.nunique()
    assert per["hot"] <= 4 and (per.drop("hot") > 1).mean() < 0.05


def test_op1_group_of_many_shards(spark):
    from lexloom.llm.sharding import shard

    df = spark.range(6_000).selectExpr("cast(id as int) AS i", "if(id % 3 = 0, 'hot', concat('t', id)) AS t")
    out = shard(df, ["t"], ["i"]).toPandas()
    n = out.groupby("shard").size()
    assert len(out) == 6_000 and len(n) == 40 and n.max() - n.min() <= 1
    # 2,000 rows in shards of 150.
    assert out[out.t == "hot"].shard.nunique() == 14


def test_op1_all_linked(spark):
    from lexloom.llm.sharding import shard

    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(1_003)], "i int, t string")
    n = shard(df, ["t"], ["i"], shards=8).groupBy("shard").count().toPandas()["count"]
    assert n.sum() == 1_003 and n.max() - n.min() <= 1


def test_op2(spark, data):
    got, docs = result(spark, data, "op2_toxicity"), table(data, "documents")
    assert set(got) == {r["doc_id"] for r in docs}
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op2_swaps_leave_scores(spark):
    from lexloom.llm.common import Scratch
    from lexloom.llm.toxicity import Settings, score, train

    rng = random.Random(1)
    rows = []
    for i in range(1_500):
        toxic, group = rng.random() < 0.3, rng.choice(["muslim", "christian"])
        # In these labels one group's name goes with toxicity.
        if toxic:
            group = "muslim" if rng.random() < 0.9 else "christian"
        rows.append((i, " ".join([rng.choice(["idiot", "scum"]) if toxic and rng.random() < 0.8 else "fine", group, *(rng.choice("abcdefgh") * 3 for _ in range(8))]), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    gap = {}
    for penalty in (0.0, 100.0):
        model = train(docs, labels, Scratch(spark, "t"), Settings(swap_penalty=penalty))
        test = spark.createDataFrame([(0, "fine muslim aaa"), (1, "fine christian aaa"), (2, "idiot aaa")], "doc_id long, text string")
        s = {r.doc_id: r.toxicity for r in score(test, model).collect()}
        gap[penalty] = abs(s[0] - s[1])
        assert s[2] > 0.5
    assert gap[100.0] < 0.25 * gap[0.0]


def test_op3(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = result(spark, data, "op3_bpe")
    for r in table(data, "documents"):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_trees_agree():
    from lexloom.llm.bpe import Encoder, load_model

    enc = Encoder(load_model(queries.tokenizer_path()))
    words = [bytes(random.Random(i).choices(b"theandro ing", k=1 + i % 64)) for i in range(400)]
    for w in words:
        width = max(1, 1 << (len(w) - 1).bit_length())
        assert enc._batch([w], width) == [enc.encode_long(w)]


def test_op4(spark, data):
    got = result(spark, data, "op4_urls", "page_id")
    pages = table(data, "pages")
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        h = re.split("[/?#]", rest, maxsplit=1)[0]
        return lower(h), re.split("[?#]", rest[len(h) :], maxsplit=1)[0]

    def canon(u):
        if u is None or "://" not in u:
            return u or ""
        h, p = split(u)
        m = re.search(r"://[^?#]*\?([^#]*)", u)
        q = sorted(x for x in (m[1] if m else "").split("&") if x and not re.match("(utm_[a-z]+|ref|gclid|fbclid)(=|$)", x))
        return re.sub(r"^(www|m)\.", "", h) + p.rstrip("/") + ("?" + "&".join(q) if q else "")

    listed = {canon(r["url"]) for r in pages if r["html"] and re.search(r"\b(scum|moron|idiot)\b", r["html"], re.I)} - {""}
    assert listed
    for r in pages:
        h, p = split(r["url"])
        fit = [(len(rule), rule, v) for v, rule in queries.URL_RULES if (h == rule.split("/")[0] or h.endswith("." + rule.split("/")[0])) and p.startswith("/" + rule.split("/", 1)[1])]
        _, rule, verdict = max(fit, default=(0, None, "block" if canon(r["url"]) in listed else "allow"))
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == (h, p, rule, verdict), r["url"]


def exact_classes(texts: list[str], common: dict) -> list[int]:
    """Classes by brute force over weighted shingles."""
    import math

    def bag(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
        return {g: n * sum(1 + math.log(len(texts) / common[x]) / math.log(len(texts)) for x in g) / len(g) for g, n in Counter(grams).items()}

    bags = [bag(t) if WORD.search(t) else None for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i, x in enumerate(bags):
        for g in x or ():
            index[g].append(i)
    pairs = {(i, j) for v in index.values() for i in v for j in v if i < j}
    for i, j in pairs:
        x, y = bags[i], bags[j]
        both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
        if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) * (1 + 1e-6):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_op5(spark, data):
    got, docs = result(spark, data, "op5_minhash"), table(data, "documents")
    texts = [r["text"] or "" for r in docs]
    common = Counter(w for t in texts for w in set(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))))
    want = exact_classes(texts, common)
    ids = [r["doc_id"] for r in docs]
    assert [got[i]["class_id"] for i in ids] == [ids[c] for c in want]
    assert all(got[i]["kept"] == (ids[c] == i) for i, c in zip(ids, want, strict=True))
    assert len(set(want)) < len(ids)


def test_op5_repeated_and_null_ids(spark):
    from lexloom.llm.minhash import near_duplicates

    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (1, t), (None, t + " more"), (None, t + " more"), (2, None), (2, None), (3, "short"), (4, "short"), (5, "short other")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as i")).toPandas()
    assert len(out) == 9 and out.kept.sum() == 1 + 2 + 1 + 1
    assert out[out.text.notna() & out.text.str.startswith("w0")].kept.sum() == 1


def test_op5_words_of_one_document_in_few(spark):
    from lexloom.llm.minhash import near_duplicates

    w = [f"w{i}" for i in range(100)]
    near = [*w[:30], "new1", *w[31:60], "new2", *w[61:]]
    rows = [(0, " ".join(w)), (1, " ".join(near)), *((i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(2, 200))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(out[out.class_size == 2].doc_id) == [0, 1]


def test_op5_sampling_probability():
    from lexloom.llm.minhash import Sampler, Settings

    rng = np.random.default_rng(0)
    s = Settings(bands=3_000, rows=1)
    shared, only = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 200, dtype=np.uint64)
    w = rng.uniform(1, 8, 500).astype(np.float32)
    a, b = np.r_[shared, only[:100]], np.r_[shared, only[100:]]
    wa, wb = np.r_[w[:300], w[300:400]], np.r_[w[:300] * 1.3, w[400:]].astype(np.float32)
    got, _ = Sampler(s)(np.r_[a, b], np.r_[wa, wb], np.array([0, 400, 800]))
    j = np.minimum(wa[:300], wb[:300]).sum() / (np.maximum(wa[:300], wb[:300]).sum() + wa[300:].sum() + wb[300:].sum())
    assert abs((got[0] == got[1]).mean() - j) < 0.04


def test_op6(spark, data):
    got, docs = result(spark, data, "op6_mixing"), table(data, "documents")
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    src = {r["doc_id"]: r["source"] for r in docs}
    total = Counter()
    for i, n in size.items():
        total[src[i]] += n
    taken, target = Counter(), {}
    for i, g in got.items():
        assert g["size"] == size[i] and g["source_size"] == total[src[i]]
        assert g["taken"] in {k * size[i] for k in range(4)}
        taken[src[i]] += g["taken"]
        target[src[i]] = g["target"]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, left = set(order), sum(total.values())
    while True:
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * total[s]
            assert target[s] == pytest.approx(goal[s])
            left -= goal[s]
            free.discard(s)
    for s in free:
        assert target[s] == pytest.approx(goal[s])
    for s in order:
        sums = {0}
        for i, n in size.items():
            if src[i] == s:
                sums |= {x + n for x in sums}
        rest = target[s] % total[s]
        assert abs(taken[s] - target[s]) <= min(abs(rest - x) for x in sums) + 1
    assert {i: g["taken"] for i, g in result(spark, data, "op6_mixing").items()} == {i: g["taken"] for i, g in got.items()}


def test_op6_fit():
    from lexloom.llm.mixing import fit

    rng = random.Random(3)
    for _ in range(60):
        have = {rng.randrange(1, 400): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))}
        total = sum(k * n for k, n in have.items())
        budget = rng.randrange(total + 1)
        take = fit(list(have.items()), budget)
        assert all(0 <= take[k] <= have[k] for k in take)
        got = sum(k * n for k, n in take.items())
        assert abs(budget - got) <= max(have)
    assert sum(k * n for k, n in fit([(7, 3), (5, 2), (3, 1)], 19).items()) == 19


def test_op6_fit_is_nearest():
    from lexloom.llm.mixing import fit

    assert fit([(100_000, 3), (90_000, 2)], 250_000) == {100_000: 1, 90_000: 2}
    rng = random.Random(5)
    for i in range(400):
        have = {rng.randrange(1, 60_000) * (1, 7)[i % 2]: rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        budget = rng.randrange(sum(k * n for k, n in have.items()) + 1)
        sums = {0}
        for k, n in have.items():
            sums = {x + k * j for x in sums for j in range(n + 1)}
        take = fit(list(have.items()), budget)
        assert all(0 <= n <= have[k] for k, n in take.items())
        assert abs(budget - sum(k * n for k, n in take.items())) == min(abs(budget - x) for x in sums)


def test_op6_repeated_rows(spark):
    from lexloom.llm.mixing import mix_documents

    rows = [(1, "a b c", "x")] * 7 + [(None, "d e", "y")] * 5 + [(3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_documents(df, lambda i, s: 1.0)
    assert out.columns == df.columns
    words = Counter(r.source for r in out.collect() for _ in (r.text or "").split())
    assert sum(words.values()) == pytest.approx(31, abs=4)


def test_op7(spark, data):
    got = result(spark, data, "op7_quality")
    for r in table(data, "documents"):
        t = r["text"] or ""
        w, g = WORD.findall(t), got[r["doc_id"]]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (g["kept"] and g["base_failed"])


def test_op8(spark, data):
    got = result(spark, data, "op8_embeddings", "vec_id")
    rows = table(data, "embeddings")
    ok = [r for r in rows if r["label"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    links, root = Counter(), {r["vec_id"]: r["vec_id"] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a["vec_id"]] += 1
                    links[b["vec_id"]] += 1
                    p, q = sorted((find(a["vec_id"]), find(b["vec_id"])))
                    root[q] = p
    assert sum(links.values()) > 100
    for r in rows:
        g = got[r["vec_id"]]
        assert (g["n_links"], g["component_id"]) == (links[r["vec_id"]], find(r["vec_id"])), (r["vec_id"], g, links[r["vec_id"]], find(r["vec_id"]))
        assert g["kept"] == (g["component_id"] == r["vec_id"])


def test_op9(spark, data):
    got, docs = result(spark, data, "op9_suffixes"), table(data, "documents")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    seen = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    removed = 0
    for d, t in raw.items():
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i] += 1
                cover[min(i + 200, len(t))] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        g = got[d]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"]) == (len(t), int(gone.sum()), spans), d
        assert g["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        removed += int(gone.sum())
    assert removed


def test_op10(spark, data):
    got, docs = result(spark, data, "op10_lines"), table(data, "documents")
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in docs:
        for x in (r["text"] or "").split("\n"):
            held[key(x)].add(r["doc_id"])
    dropped = 0
    for r in docs:
        lines = (r["text"] or "").split("\n")
        stay = [x for x in lines if not (len(k := key(x)) >= 20 and len(held[k]) >= 3 and max(held[k]) != r["doc_id"])]
        g = got[r["doc_id"]]
        assert (g["n_lines"], g["n_dropped"]) == (len(lines), len(lines) - len(stay))
        assert g["kept_sha256"] == hashlib.sha256("\n".join(stay).encode()).hexdigest()
        dropped += g["n_dropped"]
    assert dropped


def test_op10_runs_are_merged(spark):
    from lexloom.llm.common import Scratch
    from lexloom.llm.lines import LineRuns

    log = LineRuns(Scratch(spark, "t"), fanout=2)
    for b in range(5):
        rows = [(k, 0, 1, 100 - b) for k in range(b, b + 4)]
        log.add(spark.createDataFrame(rows, "h1 long, h2 long, n long, top long"))
        assert all(len(level) < 2 for level in log.levels)
    want = {k: (sum(b <= k < b + 4 for b in range(5)), max(100 - b for b in range(5) if b <= k < b + 4)) for k in range(8)}
    assert {r.h1: (r.n, r.top) for r in log.totals().collect()} == want


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data).toPandas()
    assert len(out) and set(out.doc_id) <= {r["doc_id"] for r in table(data, "documents")}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_unknown_columns_pass(spark):
    from lexloom.llm.lines import dedup_lines
    from lexloom.llm.quality import judge
    from lexloom.llm.suffixes import dedup_substrings

    df = spark.createDataFrame([(1, "a b\nc", 5, "x"), (1, None, None, "y")], "doc_id long, text string, n_words int, kept string")
    for f in (dedup_lines, judge, dedup_substrings):
        assert f(df).count() == 2




def test_op1_cut_edges_near_the_optimum(spark):
    """Groups that fit the shards without a cut: of all pairs of linked rows nearly all stay together."""
    from lexloom.llm.sharding import shard

    # 250 groups of 4 fill 10 shards of 100; 5 of 60, 10 of 30 and 400 single rows fill 10 shards of 100.
    even = [(i, f"g{i // 4}") for i in range(1_000)]
    mixed = [(i, f"a{i // 60}" if i < 300 else f"b{(i - 300) // 30}" if i < 600 else f"s{i}") for i in range(1_000)]
    for rows, most in ((even, 0.05), (mixed, 0.05)):
        out = shard(spark.createDataFrame(rows, "i int, t string"), ["t"], ["i"], shards=10).toPandas()
        assert (out.groupby("shard").size() == 100).all()
        sizes = out.groupby("t").size()
        pairs = (sizes * (sizes - 1) // 2).sum()
        held = out.groupby(["t", "shard"]).size()
        together = (held * (held - 1) // 2).sum()
        assert together >= (1 - most) * pairs, (together, pairs)
