"""Retrieval, fusion, rankers and metrics against small known results."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.errors import MissingDocument
from lexloom.operators import evaluate, fuse, rank, retrieve


def ranked(spark, rows, cols="id string, score double", q=0):
    df = spark.createDataFrame([(q, i, *r) for i, r in enumerate(rows)], f"query_id long, rank long, {cols}")
    return df


def order(df):
    return [r.id for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("1", "There are over 7,000 languages spoken around the world today."), ("2", "Elephants have been observed to behave in a way that indicates"), ("3", "In certain places, you can witness the phenomenon of bioluminescent waves"), ("4", None)], "id string, content string")
    return retrieve.Bm25Index(docs)


def bm25(spark, index, text, **kw):
    q = spark.createDataFrame([(0, text)], "query_id long, query string")
    return {r.id: r.score for r in retrieve.bm25_topk(index, q, **kw).collect()}


def plain_bm25l(docs, query, k=1.5, b=0.75, d=0.5):
    import re

    toks = {i: re.findall(r"\w\w+", (t or "").lower()) for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / (len(docs) + 1)
    out = {}
    for i, t in docs.items():
        if t is None:
            continue
        s = 0.0
        for w in set(re.findall(r"\w\w+", query.lower())):
            df = sum(w in x for x in toks.values())
            idf = math.log((n + 1) / (df + 0.5)) if df else 0
            ctd = toks[i].count(w) / (1 - b + b * len(toks[i]) / avg)
            s += idf * (1 + k) * (ctd + d) / (k + ctd + d)
        out[i] = s
    return out


def test_bm25l_keeps_documents_without_the_token(spark, index):
    got = bm25(spark, index, "languages", k=3)
    docs = {r.id: r.content for r in index.docs.collect()}
    assert set(got) == {"1", "2", "3"}
    assert got == pytest.approx(plain_bm25l(docs, "languages"))
    assert got["1"] == max(got.values())


def test_bm25_variants(spark, index):
    assert len(bm25(spark, index, "languages elephants", k=3, variant="plus")) == 3
    scaled = bm25(spark, index, "languages", k=2, scale=True)
    assert all(0 < s < 1 for s in scaled.values()) and len(scaled) == 2
    assert bm25(spark, index, "nowhere", k=3) == {}


def test_okapi_negative(spark):
    docs = spark.createDataFrame([(str(i), f"this is a document {x}") for i, x in enumerate(["one", "two", "three"])], "id string, content string")
    got = bm25(spark, retrieve.Bm25Index(docs), "this is", k=3, variant="okapi")
    assert len(got) == 3 and all(s < 0 for s in got.values())


def test_bm25_filter_keeps_global_statistics(spark, index):
    got = bm25(spark, index, "languages", k=3, where={"field": "id", "operator": "==", "value": "1"})
    assert set(got) == {"1"} and got["1"] == pytest.approx(bm25(spark, index, "languages", k=3)["1"])


def test_vectors(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None), ("d", [0.0, 2.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, embedding array<double>")
    assert order(retrieve.vector_topk(docs, q, 2)) == ["d", "b"]
    got = {r.id: r.score for r in retrieve.vector_topk(docs, q, 3, "cosine", True).collect()}
    assert got == pytest.approx({"d": 1.0, "b": 0.9, "a": 0.5})
    with pytest.raises(Exception, match="components"):
        retrieve.vector_topk(docs, spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<double>"), 2).collect()


def test_fusion(spark):
    a = ranked(spark, [("a", 1.0), ("b", 2.0), ("c", None)])
    b = ranked(spark, [("b", 3.0), ("a", 0.5), ("f", 4.0)])
    both = fuse.as_lists(a, b)
    got = lambda mode, w=None: {r.id: r.score for r in fuse.join_documents(both, 2, mode, w).collect()}
    assert got("merge", [1.5, 0.5]) == pytest.approx({"a": 0.875, "b": 2.25, "c": 0.0, "f": 1.0})
    assert got("concatenate") == {"a": 1.0, "b": 3.0, "c": None, "f": 4.0}
    assert got("reciprocal_rank_fusion")["b"] == pytest.approx(61 * (0.5 / 62 + 0.5 / 61))
    same = fuse.as_lists(ranked(spark, [("x", 0.5), ("y", 0.5)]))
    assert {r.score for r in fuse.join_documents(same, 1, "distribution_based_rank_fusion").collect()} == {0.0}
    assert len(fuse.join_documents(both, 2, top_k=2).collect()) == 2
    with pytest.raises(ValueError):
        fuse.join_branches(None, None)


def test_meta_field(spark):
    df = ranked(spark, [("1", 0.3, 1.3), ("2", 0.4, 0.7), ("3", 0.6, 2.1)], "id string, score double, rating double")
    top = lambda mode: max(r.score for r in rank.meta_field(df, "rating", 0.5, mode).collect())
    assert top("linear_score") == pytest.approx(0.8) and top("reciprocal_rank_fusion") == pytest.approx(0.016261, abs=1e-6)
    gap = ranked(spark, [("1", 0.3, None), ("2", 0.4, "7"), ("3", 0.6, "10")], "id string, score double, rating string")
    assert order(rank.meta_field(gap, "rating", value_type="int")) == ["3", "2", "1"]
    assert order(rank.meta_field(gap, "rating", value_type="int", missing="drop")) == ["3", "2"]
    assert order(rank.meta_field(gap, "rating", value_type="int", missing="top")) == ["1", "3", "2"]
    assert order(rank.meta_field(df, "rating", 0)) == ["1", "2", "3"]


def test_groups_and_middle_and_nucleus(spark):
    df = ranked(spark, [("a", "g1", "s2"), ("b", "g2", None), ("c", None, None), ("d", "g1", "s1"), ("e", "g1", "s2")], "id string, g string, s string")
    assert order(rank.meta_grouping(df, "g", "s")) == ["a", "e", "d", "b", "c"]
    ten = ranked(spark, [(str(i), float(i)) for i in range(1, 10)])
    assert order(rank.lost_in_the_middle(ten)) == list("135798642")
    p = ranked(spark, [("x", 0.7), ("y", 0.01), ("z", 0.001), ("n", None)])
    assert order(rank.top_p(p, 0.3)) == ["x"] and order(rank.top_p(p, 1.0)) == ["x", "y", "z"] and order(rank.top_p(p, 0.1, 2)) == ["x", "y"]


def test_diversity(spark):
    vec = {"a": [1.0, 0.0], "b": [0.99, 0.1], "c": [0.5, 0.8]}
    df = ranked(spark, [(k, v, [1.0, 0.0]) for k, v in vec.items()], "id string, embedding array<double>, query_embedding array<double>")
    assert order(rank.diversity(df)) == ["a", "c", "b"]
    assert order(rank.diversity(df, "maximum_margin_relevance", lambda_threshold=1.0)) == ["a", "b", "c"]


def test_windows_and_parents(spark):
    text = "This is one. Two follows it. And three ends."
    spans = [(0, 20), (13, 34), (29, 44)]
    chunks = spark.createDataFrame([("s", i, text[a:b], a) for i, (a, b) in enumerate(spans)], "source_id string, split_id int, content string, split_idx_start int")
    hit = spark.createDataFrame([(0, "s", 1)], "query_id long, source_id string, split_id int")
    assert retrieve.sentence_window(hit, chunks, 1).first().context == text
    nodes = spark.createDataFrame([("r", None, 2), ("p", "r", 3), ("q", "r", 2), *[(f"p{i}", "p", 0) for i in range(3)], *[(f"q{i}", "q", 0) for i in range(2)]], "id string, parent_id string, n_children long")
    hits = lambda xs: spark.createDataFrame([(0, x) for x in xs], "query_id long, id string")
    got = lambda xs: sorted(r.id for r in retrieve.auto_merge(hits(xs), nodes).collect())
    assert got(["p0", "p1", "q0"]) == ["p", "q0"] and got(["p0", "q0"]) == ["p0", "q0"] and got(["p0", "p1", "q0", "q1"]) == ["r"]
    with pytest.raises(MissingDocument):
        retrieve.auto_merge(hits(["p0"]), nodes.where("id <> 'p'")).collect()


def test_cache(spark):
    docs = spark.createDataFrame([("1", "u1"), ("2", "u1"), ("3", None)], "id string, url string")
    items = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "item string")
    hits, misses = retrieve.cache_check(docs, items, "url")
    assert sorted(r.id for r in hits.collect()) == ["1", "1", "2", "2"] and [r.item for r in misses.collect()] == ["u9"]


def lists(spark, per_query, scores=None):
    rows = [(q, i, f"{x}", x, (scores or {}).get(x)) for q, xs in enumerate(per_query) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "query_id long, rank long, id string, content string, score double")


def test_metrics(spark):
    truth = lists(spark, [["France"], ["9th century", "9th"], ["classical"], ["11th"], ["x"], ["a", "b", "c"]])
    got = lists(spark, [["France"], ["9th century", "10th", "9th"], ["classical", "rock"], ["10th", "11th", "the 11th"], ["y"], ["a", "z", "b", "c"]])
    value = lambda df: [round(r.score, 4) for r in df.orderBy("query_id").collect()]
    assert value(evaluate.average_precision(truth, got)) == [1, 0.8333, 1, 0.5, 0, 0.8056]
    assert value(evaluate.reciprocal_rank(truth, got)) == [1, 1, 1, 0.5, 0, 1]
    assert value(evaluate.recall(truth, got)) == [1, 1, 1, 1, 0, 1]
    assert value(evaluate.recall(truth, got, "multi_hit")) == [1, 1, 1, 1, 0, 1]
    names = [f"doc{i}" for i in (1, 2, 3, 6, 7, 8)]
    graded = lists(spark, [names], dict(zip(names, [3.0, 2.0, 3.0, 2.0, 3.0, 2.0], strict=True)))
    assert value(evaluate.ndcg(graded, lists(spark, [[f"doc{i}" for i in range(1, 6)]]))) == [0.6592]
    assert value(evaluate.ndcg(lists(spark, [["France", "Paris"]]), lists(spark, [["France", "Germany", "Paris"]]))) == [0.9197]
    report = evaluate.detailed_report(truth.select("query_id").distinct(), {"mrr": evaluate.reciprocal_rank(truth, got)})
    both = evaluate.compare_reports(report, report, ["a", "b"], ["mrr"])
    assert both.columns == ["query_id", "a_mrr", "b_mrr"]
    assert evaluate.aggregated_report({"mrr": evaluate.reciprocal_rank(truth, got)}).first().score == pytest.approx(0.75)


def test_judged(spark):
    rows = [(0, '{"statements": ["a", "b"], "statement_scores": [1, 0]}'), (1, '{"statements": [], "statement_scores": []}'), (2, "nonsense")]
    df = spark.createDataFrame(rows, "query_id long, prompt string")
    got = [r.score for r in evaluate.judged(df, lambda c: c, "prompt").orderBy("query_id").collect()]
    assert got[:2] == [0.5, 0.0] and math.isnan(got[2])
    pairs = spark.createDataFrame([(0, "x", "x"), (1, "x", "y")], "query_id long, answer string, predicted_answer string")
    assert evaluate.mean(evaluate.exact_match(pairs)).first().score == 0.5


def test_routes(spark):
    from lexloom.operators import route

    df = spark.createDataFrame([(1, "2023-02-01", "a.md"), (2, "2023-05-01", "b.pdf"), (3, "2023-08-01", "c")], "id int, created_at string, path string")
    rule = lambda a, b: {"operator": "AND", "conditions": [{"field": "created_at", "operator": ">=", "value": a}, {"field": "created_at", "operator": "<", "value": b}]}
    got = route.metadata_routes(df, {"e1": rule("2023-01-01", "2023-04-01"), "e2": rule("2023-04-01", "2023-07-01")})
    assert {r.id: r.route for r in got.collect()} == {1: "e1", 2: "e2", 3: "unmatched"}
    assert [r.route for r in route.file_type_route(df, ["text/.*", "application/pdf"]).collect()] == ["text/.*", "application/pdf", "unclassified"]
    with pytest.raises(Exception, match="no route"):
        route.conditional_route(df, [("id > 5", "'x'", "n")]).collect()
    z = route.zero_shot(df, lambda _: F.array(F.lit(0.1), F.lit(2.0)), ["u", "v"], "path")
    assert z.first().classification.label == "v"


@pytest.mark.parametrize("variant", ["bm25l", "plus", "okapi"])
def test_best_are_those_of_all_pairs(spark, variant):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(rng.randrange(12))) if i % 9 else None) for i in range(120)]
    index = retrieve.Bm25Index(spark.createDataFrame(rows, "id long, content string"))
    qs = spark.createDataFrame([(0, "ab cd"), (1, "nowhere"), (2, "kl zz"), (3, "")], "query_id long, query string")
    for where in (None, {"field": "id", "operator": "<", "value": 7}):
        want = retrieve.top_k(retrieve.bm25_scores(index, qs, variant, where).withColumn("score", F.round("score", 9)), 6)
        want = want if variant == "okapi" else want.where("score > 0")
        key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
        assert key(retrieve.bm25_topk(index, qs, 6, variant, where=where)) == key(want)


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([("1", "one two"), ("2", "two three three")], "id string, content string")
    index = retrieve.Bm25Index(docs)
    index.save(f"{tmp_path}/i")
    q = spark.createDataFrame([(0, "three two")], "query_id long, query string")
    assert retrieve.bm25_topk(retrieve.Bm25Index.load(docs, f"{tmp_path}/i"), q).collect() == retrieve.bm25_topk(index, q).collect()


def test_vector_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 3)).astype(float)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieve, "PRODUCTS", 80)
    got = retrieve.vector_topk(docs, docs.select(F.col("id").alias("query_id"), "embedding").where("id < 11"), 5).collect()
    for q in range(11):
        want = sorted(range(60), key=lambda i: (-(v[q] @ v[i]), i))[:5]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
