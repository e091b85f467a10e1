"""Each stage of the pipeline against brute force, and every operator on rows with nulls, ties, clashing names and long texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import WORD, data, exact_classes, table  # noqa: F401

import corpus_pipeline
from lexloom.llm import queries

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, data):  # noqa: F811
    return spark.read.parquet(f"{data}/documents.parquet")


def test_toxicity_stage(spark, data, docs):  # noqa: F811
    said = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, data).collect()}
    kept = {r.doc_id for r in STAGES["toxicity"](spark, docs, data).collect()}
    assert kept == {d for d, p in said.items() if not p}


def test_line_stage(spark, data, docs):  # noqa: F811
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held, rows = defaultdict(set), table(data, "documents")
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            held[key(x)].add(r["doc_id"])
    gone = lambda x, d: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != d
    got = {r.doc_id: r for r in STAGES["line_dedup"](spark, docs, data).collect()}
    for r in rows:
        left = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not gone(x, r["doc_id"]))
        g = got[r["doc_id"]]
        assert g.text == left and g.n_chars == (r["n_chars"] if left == r["text"] else len(left))


def test_near_duplicate_stage(spark, data, docs):  # noqa: F811
    rows = table(data, "documents")
    texts = [r["text"] or "" for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    common = Counter(w for t in texts for w in set(WORD.findall(t.translate(low))))
    groups = defaultdict(list)
    for r, c in zip(rows, exact_classes(texts, common), strict=True):
        groups[c].append(r["doc_id"])
    assert {r.doc_id for r in STAGES["minhash_near_dedup"](spark, docs, data).collect()} == {min(g) for g in groups.values()}


def test_mixing_stage(spark, data, docs):  # noqa: F811
    taken = {r.doc_id: r.taken for r in queries.op6_mixing(spark, data).collect()}
    got = STAGES["mixing"](spark, docs, data).collect()
    copies = Counter(r.doc_id for r in got)
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in table(data, "documents")}
    assert all(copies[d] <= 3 and copies[d] * size[d] == n for d, n in taken.items() if size[d])


def test_token_stage(spark, data, docs):  # noqa: F811
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in STAGES["bpe"](spark, docs, data).collect()}
    for r in table(data, "documents"):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]].bpe_ids == ids and got[r["doc_id"]].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_columns_of_any_name_pass(spark, data, docs):  # noqa: F811
    names = "toxicity n_lines n_dropped class_id class_size kept size copies i j h z t1 __t1 __key __copies other_column_5".split()
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, data)
        assert out.columns == more.columns, name
        assert out.where(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0, name
    tokens = STAGES["bpe"](spark, more, data)
    assert tokens.count() == docs.count() and not set(tokens.columns) & set(names)


def odd(spark):
    """Rows with nulls in all columns, an empty and a very long text, repeats and ties, and columns of every name that operators use."""
    words = " ".join(f"w{i % 997}" for i in range(120_000))
    texts = [None, "", " \n", words, words, "one short text", "one short text", "line of more than twenty\n" * 3]
    rows = [(i // 2 if i != 5 else None, t, None if i % 3 else "s", None) for i, t in enumerate(texts)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    names = "class_id class_size kept n_lines n_dropped n_bytes n_removed n_spans kept_bytes shard slot toxicity bpe_ids n_tokens ids_sha256 decoded_sha256 n_words base_failed failed_rules i h j n t root a b z size k pos".split()
    return df.select("*", *[F.lit("x").alias(n) for n in names]), len(rows)


def test_operators_take_odd_rows(spark):
    from lexloom.llm import bpe, lines, minhash, mixing, quality, sharding, suffixes, toxicity

    df, n = odd(spark)
    assert bpe.encode_documents(df, queries.tokenizer_path()).count() == n
    assert toxicity.score(df, toxicity.Model(0.1, {"one": 1.0, "shor*": 0.5})).where("toxicity is null").count() == 0
    assert lines.dedup_lines(df).count() == n and quality.judge(df).count() == n
    got = minhash.near_duplicates(df)
    assert got.count() == n and got.where("size <> 'x' or root <> 'x'").count() == 0
    assert suffixes.dedup_substrings(df).count() == n
    placed = sharding.shard(df, ["text"], ["doc_id"], shards=3).groupBy("shard").agg(F.count("*").alias("c"), F.max("slot").alias("m")).collect()
    assert sum(r.c for r in placed) == n and max(r.c for r in placed) - min(r.c for r in placed) <= 1 and all(r.m == r.c - 1 for r in placed)
    assert mixing.mix_documents(df, lambda i, s: 1.0).columns == df.columns


def test_vectors_and_urls_take_odd_rows(spark):
    from lexloom.llm import embeddings, urls

    v = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, None, 1), (4, [1.0, 0.0], None), (5, [], 1)], "vec_id long, embedding array<double>, label int").withColumn("g", F.lit("x"))
    got = embeddings.near_duplicates(v).collect()
    assert sorted(r.n_links for r in got) == [0, 0, 0, 1, 1]
    p = spark.createDataFrame([(1, None), (2, "http://a.b/c"), (2, "http://a.b/c"), (None, "")], "page_id long, url string").selectExpr("*", "'x' as host", "1 as verdict", "2 as block", "3 as w0")
    out = urls.filter_urls(p, spark.createDataFrame([("a.b/c",), (None,)], "u string")).collect()
    assert len(out) == 4 and sum(r.verdict == "block" for r in out) == 2 and all(r.block == 2 and r.w0 == 3 for r in out)
    assert urls.filter_urls(p, spark.createDataFrame([], "u string")).where("verdict = 'allow'").count() == 4
