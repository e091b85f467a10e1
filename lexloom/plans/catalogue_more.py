"""Further queries: hierarchies, messages, models, files, graphs, and the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import agents, build, chunk, models, retrieve
from lexloom.plans.catalogue import TOK, query, r6, t
from lexloom.sources import files
from lexloom.streaming import index as streams

# ---- chunkers and models ---------------------------------------------------------------------------------------------------------


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query()
def recursive_split(s, d):
    return chunk.explode_chunks(_docs(s, d), lambda x: chunk.recursive_chunks(x, 40))


@query()
def sentence_split(s, d):
    return chunk.explode_chunks(_docs(s, d), lambda x: chunk.sentences(x))


@query()
def sentence_pack(s, d):
    return chunk.explode_chunks(_docs(s, d), lambda x: chunk.pack_sentences(x, 50, 10))


@query()
def hierarchical_split(s, d):
    return chunk.hierarchical(_docs(s, d), [100, 25])


@query()
def hierarchy_merge(s, d):
    """Nodes are cut once and written without their texts: every round of the merge reads them."""
    made = chunk.hierarchical(_docs(s, d), [100, 25]).select("id", "parent_id", "n_children", F.expr("n_children = 0 and content rlike '[aeiou] '").alias("hit"))
    made.write.parquet(path := f"{retrieve.shared_folder(s)}/{uuid.uuid4().hex}")
    nodes = s.read.schema(made.schema).parquet(path)
    hits = nodes.where("hit").select(F.lit(0).cast("long").alias("query_id"), "id")
    return retrieve.auto_merge(hits, nodes.drop("hit"))


@query()
def html_to_text(s, d):
    return t(s, d, "pages").select("page_id", files.html_to_text(F.col("html")).alias("content"))


@query()
def ner_regex(s, d):
    return models.named_entities(_docs(s, d)).select("id", F.inline("named_entities"))


@query()
def embed_hashing(s, d):
    return models.embed_documents(_docs(s, d)).select("id", "embedding")


@query()
def extractive_reader(s, d):
    """The best documents of each item's second word, read for that word."""
    q = t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.split("text", " "), 2).alias("query"))
    best = retrieve.bm25_topk(retrieve.Bm25Index(_docs(s, d)), q, 10).select("query_id", "id")
    # k rows for each item are sent to the texts, which stay where they are.
    pairs = _docs(s, d).join(F.broadcast(best.join(q, "query_id")), "id")

    def factory():
        return lambda qs: [[(c.find(w), c.find(w) + len(w), 0.5 + 1 / (3 + c.find(w)))] if w in c else [] for w, c in qs]

    return models.read_answers(pairs, factory, 5)


@query("SELECT conv_id, turn, 'words: ' || len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS reply, CAST(2 AS BIGINT) AS steps FROM conversations WHERE role = 'user'")
def agent_replies(s, d):
    rows = t(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")

    def model():
        return lambda messages, tools: {"tool_calls": [{"tool_name": "count", "arguments": {"text": messages[-1]["content"]}}]} if messages[-1]["role"] == "user" else "words: " + messages[-1]["content"]

    def tools():
        return agents.Toolset([agents.Tool("count", "Counts words", {"type": "object"}, lambda text: len((text or "").split()))])

    return agents.run_agents(rows, model, tools).select("conv_id", "turn", "reply", "steps")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) <= 50, false) AS valid FROM events")
def json_validator(s, d):
    schema = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}}, "required": ["k"]}
    ok, bad = agents.validate_json(t(s, d, "events").select("event_id", "props"), schema, "props")
    return ok.select("event_id", F.lit(True).alias("valid")).union(bad.select("event_id", F.lit(False)))


@query(f"SELECT token, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS token FROM documents) GROUP BY ALL")
def term_count_deltas(s, d):
    docs = _docs(s, d)
    marked = docs.join(t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return streams.merge_statistics(streams.merge_statistics(streams.term_counts(marked), docs), marked, sign=-1)


# ---- prompts, answers, messages --------------------------------------------------------------------------------------------------


@query("SELECT conv_id, max_by(turn, turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def message_last_user(s, d):
    return t(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("turn", "turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("SELECT conv_id, turn, 'Role: ' || role || chr(10) || 'Text: ' || coalesce(text, '') || '.' AS prompt FROM conversations")
def prompt_builder(s, d):
    c = t(s, d, "conversations")
    return c.select("conv_id", "turn", build.prompt("Role: {{ role }}\nText: {{ text }}.", c.columns, required=["role"]).alias("prompt"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, '') || ';', '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_loop(s, d):
    c = t(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    return build.prompt_rows(c, "{% for m in ms %}{{ m.role }}: {{ m.text }};{% endfor %}").select("conv_id", "prompt")


@query("SELECT doc_id, regexp_extract(text, '^(\\S+)', 1) AS answer, CASE WHEN doc_id % 7 < 3 THEN CAST(doc_id % 7 + 1 AS BIGINT) END AS first FROM documents")
def answer_builder(s, d):
    docs = t(s, d, "documents").select("doc_id", F.concat_ws(" ", F.element_at(F.split("text", r"\s"), 1), F.concat(F.lit("["), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("] [9]"))).alias("reply"), F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]).alias("docs"))
    out = build.answers(docs, documents="docs", pattern=r"^(\S+)", reference_pattern=r"\[(\d+)\]")
    return out.select("doc_id", "answer", F.get("references", F.lit(0)).alias("first"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS output FROM events")
def output_adapter(s, d):
    return build.adapt(t(s, d, "events"), "cast(get_json_object(props, '$.k') as bigint) * 2").select("event_id", "output")


@query("SELECT event_id, json_valid(props) AS valid, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(s, d):
    return t(s, d, "events").select("event_id", X.valid_json(F.col("props")).alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, (url LIKE 'http://%' OR url LIKE 'https://%') AS valid FROM pages")
def url_valid(s, d):
    return t(s, d, "pages").select("page_id", X.valid_url(F.col("url")).alias("valid"))


@query("SELECT doc_id, sha256(coalesce(nullif(text, ''), 'None') || 'NoneNoneNone{}None') AS id FROM documents")
def document_id(s, d):
    from lexloom.schema import document_id as ident

    return t(s, d, "documents").select("doc_id", ident(F.col("text")).alias("id"))


@query("SELECT doc_id, 'p: ' || lang || chr(10) || source || chr(10) || text || ' :s' AS content FROM documents")
def embedding_text(s, d):
    return t(s, d, "documents").select("doc_id", build.embedding_text(F.col("text"), [F.col("lang"), F.col("source")], "p: ", " :s").alias("content"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_dot_product(a.v, b.v), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_functions(s, d):
    e = t(s, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", r6(X.cosine(F.col("embedding"), F.col("b")), "cosine"), r6(X.dot(F.col("embedding"), F.col("b")), "dot"))


# ---- graphs ----------------------------------------------------------------------------------------------------------------------


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE n_chars > 500 GROUP BY lang")
def pipeline_graph(s, d):
    from lexloom.plans.pipeline import Component, Pipeline

    p = Pipeline()
    p.add("long", Component(lambda docs: {"docs": docs.where("n_chars > 500")}, {"docs": DataFrame}))
    p.add("count", Component(lambda docs: {"counts": docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))}, {"counts": DataFrame}))
    p.connect("long.docs", "count.docs")
    return p.run({"long": {"docs": t(s, d, "documents")}})["count"]["counts"]


# ---- star schema -----------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def star_hash_join(s, d):
    j = t(s, d, "orders").join(t(s, d, "customer").hint("shuffle_hash"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def star_merge_join(s, d):
    return t(s, d, "orders").join(t(s, d, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def star_semi_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def star_anti_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.event_id, CAST(count(*) AS BIGINT) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR GROUP BY a.event_id")
def star_band_join(s, d):
    """A self join within an hour: rows meet in buckets of an hour and its neighbours, not all pairs of a user."""
    e = t(s, d, "events").select("event_id", "user_id", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("h"))
    b = e.select(F.col("user_id").alias("u2"), F.col("ts").alias("ts2"), F.explode(F.array(F.col("h") - 1, F.col("h"), F.col("h") + 1)).alias("h2"))
    j = e.join(b, (F.col("user_id") == F.col("u2")) & (F.col("h") == F.col("h2")) & F.col("ts2").between(F.col("ts") - F.expr("INTERVAL 1 HOUR"), F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return j.groupBy("event_id").agg(F.count(F.lit(1)).alias("near"))


@query("SELECT event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'purchase' AND (c.ts, c.event_id) > (b.ts, b.event_id) AND (c.ts, c.event_id) < (a.ts, a.event_id))) AS last FROM events a")
def star_asof_join(s, d):
    """The last purchase before each event: one window over the union, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def star_rollup(s, d):
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def star_grouping_sets(s, d):
    return t(s, d, "lineitem").groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nt, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
def star_windows(s, d):
    w, x = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(x).cast("long").alias("nt"), F.lag("o_orderkey").over(x).alias("prev"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def star_frames(s, d):
    return t(s, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 4).alias("moving"))


def _keys(s, d):
    return t(s, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("k")), t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


KEYS = "(SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000) {} (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"


@query(KEYS.format("UNION"))
def star_union(s, d):
    a, b = _keys(s, d)
    return a.union(b).distinct()


@query(KEYS.format("INTERSECT"))
def star_intersect(s, d):
    a, b = _keys(s, d)
    return a.intersect(b)


@query(KEYS.format("EXCEPT"))
def star_except(s, d):
    a, b = _keys(s, d)
    return a.subtract(b)


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS supps FROM lineitem GROUP BY l_returnflag")
def star_distinct(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name")
def star_revenue(s, d):
    j = t(s, d, "nation").join(t(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(t(s, d, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01'"), F.col("c_custkey") == F.col("o_custkey")).join(t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(s, d):
    return streams.windowed(t(s, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
  SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g""")
def session_windows(s, d):
    return streams.sessions(t(s, d, "events")).select("user_id", "start", "n")


