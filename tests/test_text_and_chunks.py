import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import build, chunk, models


def one(spark, col, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", col.alias("x")).orderBy("i").collect()]


def test_cleaning(spark):
    t = F.col("t")
    assert one(spark, X.squeeze_spaces(t), "a  b\n\n c \f  d ", None) == ["a b c\fd", None]
    assert one(spark, X.drop_empty_lines(t), "a\n \n\nb") == ["a\nb"]
    assert one(spark, X.clean(t, substrings=["x."], regex=r"\d+"), "ax.b 12") == ["ab"]
    assert one(spark, X.clean_answers(t, ["foo"], True, True, True), "Foo Bar, 9!") == [" bar "]
    assert one(spark, X.normalize_unicode("NFKC", True)(t), "ﬁ é", None) == ["fi e", None]
    pages = "\f".join(f"{i} head of each page text{i} and the foot of all" for i in range(5))
    assert "the foot of all" not in one(spark, X.drop_repeated_edges(t), pages)[0]


def test_small_functions(spark):
    assert X.expand_ranges(["1-3", 5]) == [1, 2, 3, 5]
    assert [X.excel_column(i) for i in (0, 25, 26, 701)] == ["A", "Z", "AA", "ZZ"]
    assert one(spark, X.mime_type(F.col("t")), "x/a.MD", "b.pdf", "c") == ["text/markdown", "application/pdf", None]
    assert one(spark, X.valid_url(F.col("t")), "http://a.b", "ftp://a", "x", None) == [True, False, False, False]
    assert one(spark, X.json_keys_present(F.col("t"), ["a"]), '{"a": 1}', "{}", "no") == [True, False, False]
    assert len(one(spark, X.now_formatted("UTC", "yyyy", days=1), "x")[0]) == 4


@pytest.mark.parametrize("n,length,overlap,want", [(18, 10, 0, [(0, 10), (10, 18)]), (5, 2, 1, [(0, 2), (1, 3), (2, 4), (3, 5)]), (3, 5, 0, [(0, 3)]), (0, 3, 0, [])])
def test_windows(n, length, overlap, want):
    assert X.window_bounds(n, length, overlap) == want


def test_split(spark):
    text = "This is a text with some words. There is a second sentence. And there is a third sentence."
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "id string, content string")
    got = X.split_documents(df, "word", 10).orderBy("split_id").collect()
    assert len(got) == 2 and got[1].content.startswith("second sentence.") and text[got[1].split_idx_start :] == got[1].content
    over = X.split_documents(df, "word", 10, 2).orderBy("split_id").collect()
    assert over[1].overlap_prev > 0 and "".join([over[0].content, *[c.content[c.overlap_prev :] for c in over[1:]]]) == text
    ranges = [[(x.split_id, x.start, x.end) for x in r.split_overlap] for r in over]
    assert ranges == [[(1, 0, 5)], [(0, 38, 43)]] and over[0].content[38:43] == over[1].content[:5] == "is a "
    assert [r.page_number for r in X.split_documents(spark.createDataFrame([("d", "a\fb\fc")], "id string, content string"), "page", 1).orderBy("split_id").collect()] == [1, 2, 3]
    assert X.split_documents(df, "word", 10, threshold=9).count() == 1
    assert X.split_documents(df, "own", 1, function=lambda t: t.split(".")).count() == 4
    with pytest.raises(ValueError):
        X.split_documents(df, "word", 2, 2)


def test_sentences():
    t = 'Dr. Smith came. He said "No. Never!" and left. It was 3.5 km. 1. First point here.'
    parts = chunk.sentences(t)
    assert "".join(parts) == t and parts[0].startswith("Dr. Smith came.") and any("No. Never!" in p for p in parts)
    assert all(len(c.split()) <= 8 for c in chunk.pack_sentences("One two three. Four five six. Seven eight nine ten.", 8))


def test_recursive():
    t = "para one is here.\n\n" + "word " * 30 + "\n\nend"
    got = chunk.recursive_chunks(t, 10)
    assert "".join(got) == t and all(len(x.split()) <= 10 for x in got)
    assert "".join(chunk.recursive_chunks("x" * 25, 10, unit="char")) == "x" * 25
    over = chunk.recursive_chunks(" ".join(f"w{i}" for i in range(50)), 10, overlap=4)
    assert [len(x.split()) for x in over] == [10] * 7 + [8] and over[1].startswith("w6 w7 w8 w9 w10")


def test_recursive_overlap():
    t = "A simple sentence1. A bright sentence2. A clever sentence3"
    got = chunk.recursive_chunks(t, 3, ["."], overlap=2)
    assert got == ["A simple sentence1.", "simple sentence1. A", "sentence1. A bright", "A bright sentence2.", "bright sentence2. A", "sentence2. A clever", "A clever sentence3"]
    got = chunk.recursive_chunks(t, 20, ["."], "char", 15)
    assert got[:3] == ["A simple sentence1.", "mple sentence1. A br", "sentence1. A bright "] and len(got) == 9 and got[-1] == " A clever sentence3"
    spans = chunk.recursive_spans(t, 20, ["."], "char", 15)
    assert X.overlap_ranges(spans)[1] == [{"split_id": 0, "start": 4, "end": 19}, {"split_id": 2, "start": 0, "end": 15}]
    assert chunk.recursive_chunks("This is a test.\n\n\nAnother test.\n\n\n\nFinal test.", 18, ["\n\n", "\n"], "char") == ["This is a test.\n\n", "\nAnother test.\n\n\n\n", "Final test."]
    for length, overlap in ((0, 0), (-1, 0), (10, -1), (10, 10), (10, 15)):
        with pytest.raises(ValueError):
            chunk.recursive_chunks(t, length, overlap=overlap)
    with pytest.raises(ValueError):
        chunk.recursive_chunks(t, 5, [".", 2])
    with pytest.raises(ValueError):
        chunk.recursive_chunks(t, 5, unit="token")


def test_recursive_tokens():
    coded = {"encode": lambda t: [b for b in t.encode()], "decode": lambda ids: bytes(ids).decode("utf-8", "replace")}
    got = chunk.recursive_chunks("ab cdé fg", 4, [" "], "token", **coded)
    assert "".join(got) == "ab cdé fg" and all(len(x.encode()) <= 4 for x in got)
    over = chunk.recursive_chunks("abcdefghij", 4, [], "token", 2, **coded)
    assert over == ["abcd", "cdef", "efgh", "ghij"]


def test_recursive_documents(spark):
    t = "This is some text. \f This text is on another page. \f This is the last pag3."
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id long, content string")
    rows = chunk.split_recursively(df, 19, separators=[" "], unit="char").orderBy("split_id").collect()
    assert [r.page_number for r in rows] == [1, 2, 3, 3, 3] and all(t[r.split_idx_start :].startswith(r.content) for r in rows)


def test_headers_and_footers():
    inner = "This is a header.\n        Page  of\n        {}\n        4\n        {}\n        This is a footer number 1\n        This is footer number 2"
    text = "\f".join(["First Page", "", inner.format(2, "Lorem ipsum dolor sit amet"), inner.format(3, "Sid ut perspiciatis unde"), inner.format(4, "Sed do eiusmod tempor.")])
    left = " {}\n        4\n        {}"
    assert X.without_edges(text) == "\f".join(["First Page", "", left.format(2, "Lorem ipsum dolor sit amet"), left.format(3, "Sid ut perspiciatis unde"), left.format(4, "Sed do eiusmod tempor.")])
    assert X.without_edges("no pages here at all") == "no pages here at all"
    assert X.without_edges("a\fb\fc") == "a\fb\fc"


def test_hierarchy(spark):
    df = spark.createDataFrame([("d", "The sun rose early in the morning. It cast a warm glow over the trees. Birds began to sing.")], "id string, content string")
    rows = chunk.hierarchical(df, [10, 3]).collect()
    assert len({r.id for r in rows}) == len(rows) and sum(r.parent_id is None for r in rows) == 1
    by = {r.id: r for r in rows}
    for r in rows:
        kids = [x for x in rows if x.parent_id == r.id]
        assert len(kids) == r.n_children and (not kids or "".join(k.content for k in kids) == r.content)
    assert all(r.parent_id in by for r in rows if r.parent_id)


def test_csv():
    t = "a,b\n,\n,\nc,d\n"
    assert [c for _, _, c in chunk.split_csv(t)] == ["a,b\n", "c,d\n"]
    assert [(a, x) for a, x, _ in chunk.split_csv("a,,,b\n1,,,2\n")] == [(0, 0), (0, 3)]
    assert len(chunk.split_csv(t, by_row=True)) == 4
    assert chunk.clean_csv("h,,i\n,,\n1,,2\n") == "h,i\n1,2\n"
    assert chunk.clean_csv("h,,i\n,,\n1,,2\n", ignore_rows=1) == "h,i\n1,2\n"


def test_prompts_and_answers(spark):
    assert build.render("{% for d in ds %}[{{ d.t }}]{% endfor %}{% if q %} {{ q }}{% else %} none{% endif %}", {"ds": [{"t": 1}, {"t": 2}], "q": ""}) == "[1][2] none"
    assert build.template_variables("{% for d in ds %}{{ d.t }}{% endfor %}{{ q }}") == ["ds", "q"]
    df = spark.createDataFrame([("Answer: 42 [2][9]", ["a", "b"])], "reply string, docs array<string>")
    r = build.answers(df, documents="docs", pattern=r"Answer: (\S+)", reference_pattern=r"\[(\d+)\]").first()
    assert r.answer == "42" and r.references == ["b"]
    with pytest.raises(ValueError):
        build.answers(df, pattern="(a)(b)")
    msgs = spark.sql("select array(named_struct('role','user','text','Hi {{ name }}'), named_struct('role','assistant','text','{{ name }}')) m, 'Bo$1' name")
    out = msgs.select(build.chat_prompt(F.col("m"), {"name": F.col("name")}).alias("m")).first().m
    assert [x.text for x in out] == ["Hi Bo$1", "{{ name }}"]


def test_models(spark):
    df = spark.createDataFrame([(1, "Ann Lee wrote to a@b.org on 2024-01-02"), (2, None)], "id int, content string")
    got = {r.id: [e.entity for e in r.named_entities] for r in models.named_entities(df).collect()}
    assert got == {1: ["NAME", "EMAIL", "DATE"], 2: []}
    e = [r.embedding for r in models.embed_documents(df).orderBy("id").collect()]
    assert len(e[0]) == 64 and sum(x * x for x in e[0]) == pytest.approx(1)
    with pytest.raises(Exception, match="no model"):
        models.embed_documents(df, "missing").collect()
    ok, bad = models.extract_metadata(df, lambda: lambda ts: ['{"a": 1}' if t else "x" for t in ts], F.col("content"), ["a"])
    assert ok.count() == 1 and bad.first().error == "the reply is no JSON"
    assert models.dedup_spans([("d", 0, 10, 0.9), ("d", 5, 15, 0.8), ("e", 0, 10, 0.7)]) == [0, 2]
    got = models.stream_text(iter([{"content": "He"}, {"content": "llo"}, {"tool_calls": [{"index": 0, "id": "1", "function": {"name": "f", "arguments": '{"a"'}}]}, {"tool_calls": [{"index": 0, "function": {"arguments": ": 1}"}}]}]))
    assert got == {"text": "Hello", "tool_calls": [{"id": "1", "tool_name": "f", "arguments": '{"a": 1}'}]}
