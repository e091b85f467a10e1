"""Stores, files, web, graphs, agents and streams."""

import asyncio
import io
import json
import sys
import zipfile
from typing import Any

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexloom.errors import DuplicateDocument, MaxRunsError, PipelineError
from lexloom.operators import agents, build, models
from lexloom.operators.store import DocumentTable
from lexloom.plans.pipeline import Component, Greedy, Pipeline, SuperComponent, Variadic, branch, fits
from lexloom.sources import files, web
from lexloom.streaming import index as streams


# Workers can't import this module: what it passes to them goes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_store(spark, tmp_path):
    t = DocumentTable(spark, f"file://{tmp_path}/docs", "id string, content string")
    df = lambda *rows: spark.createDataFrame(rows, "id string, content string")
    assert t.count() == 0 and t.write(df(("a", "1"), ("b", "2"))) == 2
    with pytest.raises(DuplicateDocument):
        t.write(df(("c", "3"), ("a", "9")), "fail")
    assert t.count() == 2
    assert t.write(df(("a", "9"), ("c", "3")), "skip") == 1 and t.write(df(("a", "9")), "overwrite") == 1
    assert {r.id: r.content for r in t.read().collect()} == {"a": "9", "b": "2", "c": "3"}
    t.delete(df(("a", ""), ("zz", "")))
    assert t.filter({"field": "id", "operator": "==", "value": "b"}).count() == 1 and t.count() == 2


def test_stream_into_store(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "one two"), ("b", "two")], "id string, content string").write.parquet(src)
    t = DocumentTable(spark, f"file://{tmp_path}/docs", "id string, content string")
    q = streams.index_stream(streams.read_files(spark, src, "id string, content string"), t, str(tmp_path / "check"))
    q.awaitTermination(120)
    assert t.count() == 2
    df = streams.merge_statistics(streams.term_counts(t.read()), t.read().where("id = 'a'"), sign=-1)
    assert {r.token: r.df for r in df.collect()} == {"two": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"laureates": [{"name": "A", "year": 1}, {"name": None}]}))
    assert files.read_text(spark, str(tmp_path / "a.txt")).first().content == "hello"
    got = files.convert(files.read_binary(spark, str(tmp_path), "b.json"), files.json_reader(".laureates[]", "name", {"year"}))
    assert [(r.content, r.meta) for r in files.good(got).collect()] == [("A", '{"year": 1}')]
    broken = files.convert(files.read_binary(spark, str(tmp_path), "a.txt"), files.docx_reader())
    assert files.good(broken).count() == 0 and files.bad(broken).count() == 1


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml").replace("_rels_", "_rels/"), x)
    return out.getvalue()


def test_office_formats():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t><w:br w:type='page'/><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert files.docx_reader()(archive(word__document_xml=doc), "x")[0][0] == "Hi\fyou\na,b"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in (1, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<s {a}><a:p><a:r><a:t>S{i}</a:t></a:r></a:p></s>")
    assert files.pptx_reader(out.getvalue(), "x")[0][0] == "S1\fS2"
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {s}><sheetData><row><c r="A1"><v>5</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert files.xlsx_reader()(out.getvalue(), "x") == [(",A,B\n1,5,x", {"xlsx": {"sheet_name": "One"}})]


def test_markup_and_mail():
    assert files.html_text("<title>T</title><nav>menu</nav><p>One <b>two</b></p><script>x</script><p>three &amp; 4</p>") == ("One two\nthree & 4", "T")
    assert files.markdown_text("# Head\n\n* **bold** [link](http://x)\n\n| a | b |\n|--|--|\n| 1 | 2 |", True) == "Head\n\nbold link\n\na, b\n1, 2"
    mail = b"From: a@b\nSubject: s\nMIME-Version: 1.0\nContent-Type: text/plain\n\nbody\n"
    assert files.eml_reader(mail, "m")[0][0] == "From: a@b\nSubject: s\n\nbody"
    ocr = {"pages": [{"lines": [{"content": x} for x in ("before", "a", "b", "after")]}], "tables": [{"rowCount": 1, "columnCount": 2, "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "a"}, {"rowIndex": 0, "columnIndex": 1, "content": "b"}]}]}
    got = files.ocr_documents(ocr)
    assert got[0][0] == "a,b" and got[0][1]["preceding_context"] == "before" and got[1][0] == "before\nafter"
    assert files.single_column([(5, 1.0, "b"), (1, 1.01, "a"), (1, 2.0, "c")]) == ["a b", "c"]


SPEC = {"servers": [{"url": "http://s"}], "paths": {"/g/{name}": {"post": {"operationId": "greet", "description": "Greets", "parameters": [{"name": "name", "in": "path", "required": True, "schema": {"type": "string"}}], "requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"m": {"type": "string"}}, "required": ["m"]}}}}}}}}


def fake(url, method, headers, body, timeout):
    if "down" in url:
        return 500, "text/plain", b""
    if "search" in url:
        return 200, "application/json", json.dumps({"organic": [{"title": "t", "snippet": "s", "link": "l"}], "answerBox": {"answer": "42", "title": "b"}}).encode()
    return 200, "application/json", json.dumps({"url": url, "body": (body or b"").decode()}).encode()


def test_web(spark):
    rows = web.fetch(spark.createDataFrame([("http://ok",), ("http://down",)], "url string"), transport=fake, retries=0, pause=0).collect()
    assert rows[0].status == 200 and rows[0].text and rows[1].error
    q = spark.createDataFrame([(0, "x")], "query_id long, query string")
    assert [r.content for r in web.web_search(q, "serper", "k", transport=fake).collect()] == ["42", "s"]
    assert web.call_operation(SPEC, "greet", {"name": "a b", "m": "hi"}, fake) == {"url": "http://s/g/a%20b", "body": '{"m": "hi"}'}
    f = files.openapi_functions(SPEC)[0]
    assert f["name"] == "greet" and sorted(f["parameters"]["required"]) == ["m", "name"]


def add(n):
    return Component(lambda value: {"value": value + n}, {"value": int})


def test_linear_graph():
    p = Pipeline().add("a", add(2)).add("b", Component(lambda value: {"value": value * 2}, {"value": int})).add("c", add(1))
    p.connect("a", "b").connect("b.value", "c.value")
    assert p.run({"a": {"value": 1}}) == {"c": {"value": 7}}
    assert p.run({"a": {"value": 1}}, {"a"})["a"] == {"value": 3}
    assert asyncio.run(p.run_async({"a": {"value": 1}})) == {"c": {"value": 7}}
    assert "n0 -- value to value --> n1" in p.draw()


def joined(values: Variadic[int]) -> dict:
    return {"sum": sum(values)}


def first(value: Greedy[int]) -> dict:
    return {"value": value[0]}


def test_branches_and_joins():
    p = Pipeline().add("split", branch(odd=lambda v: v % 2 == 1, even=lambda v: v % 2 == 0)).add("x", add(10)).add("y", add(20)).add("first", first)
    p.connect("split.odd", "x.value").connect("split.even", "y.value").connect("x.value", "first.value").connect("y.value", "first.value")
    assert p.run({"split": {"value": 3}})["first"] == {"value": 13} and p.run({"split": {"value": 4}})["first"] == {"value": 24}
    q = Pipeline().add("a", add(1)).add("b", add(2)).add("sum", Component(joined, {"sum": int}))
    q.connect("a.value", "sum.values").connect("b.value", "sum.values")
    assert q.run({"a": {"value": 1}, "b": {"value": 1}})["sum"] == {"sum": 5}


def test_loop():
    def merge(value: Greedy[int]) -> dict:
        return {"value": value[0]}

    def graph(most):
        p = Pipeline(max_runs=most).add("in", merge).add("add", add(3)).add("test", branch(again=lambda v: v < 10, done=lambda v: v >= 10))
        return p.connect("in.value", "add.value").connect("add.value", "test.value").connect("test.again", "in.value")

    assert graph(10).run({"in": {"value": 1}})["test"] == {"done": 10}
    with pytest.raises(MaxRunsError):
        graph(1).run({"in": {"value": 1}})


def typed(value: int) -> dict:
    return {"out": value}


def test_errors_and_types():
    p = Pipeline().add("a", Component(lambda: {"s": "x"}, {"s": str})).add("b", Component(typed, {"out": int}))
    with pytest.raises(PipelineError):
        p.connect("a", "b")
    with pytest.raises(PipelineError):
        p.add("a", add(1))
    with pytest.raises(PipelineError):
        p.run({})
    assert fits(bool, int) and fits(int, int | None) and not fits(int | None, int) and fits(list[int], list) and not fits(list[int], list[str]) and fits(Any, int)


def test_super_and_yaml():
    inner = Pipeline().add("a", Component(typed, {"out": int})).add("b", add(5))
    inner.connect("a.out", "b.value")
    outer = Pipeline().add("s", SuperComponent(inner, {"n": ["a.value"]}, {"b.value": "result"}))
    assert outer.run({"s": {"n": 1}}) == {"s": {"result": 6}}
    p = Pipeline().add("t", typed)
    again = Pipeline.loads(p.dumps())
    assert again.run({"t": {"value": 4}}) == {"t": {"value": {"out": 4}}} or again.run({"t": {"value": 4}}) == {"t": {"out": 4}}


def test_agent():
    @agents.tool
    def double(n: int) -> int:
        """Doubles"""
        return 2 * n

    box = agents.Toolset([double])
    assert double.spec()["parameters"] == {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}

    def model(messages, tools):
        last = messages[-1]
        return {"text": None, "tool_calls": [{"tool_name": "double", "arguments": {"n": 4}, "id": "1"}]} if last["role"] == "user" else f"it is {last['content']}"

    got = agents.run_agent(model, [{"role": "user", "content": "q"}], box, system="s")
    assert [m["role"] for m in got["messages"]] == ["system", "user", "assistant", "tool", "assistant"] and got["messages"][-1]["content"] == "it is 8"
    assert agents.run_agent(model, [{"role": "user", "content": "q"}], box, exit_conditions=["double"])["messages"][-1]["role"] == "tool"
    with pytest.raises(agents.ToolError):
        agents.invoke([{"tool_name": "none", "arguments": {}}], box, agents.State())
    s = agents.State({"n": {"type": int}, "l": {"type": list[int]}})
    s.set("n", 1), s.set("n", 2), s.set("l", 1), s.set("l", [2])
    assert s.data == {"n": 2, "l": [1, 2]}


def test_json_schema(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": -1}',), ("x",), ('{"b": 1}',)], "reply string")
    ok, bad = agents.validate_json(df, schema)
    assert ok.count() == 1 and bad.count() == 3 and "corrected JSON" in bad.first().recovery_prompt


def test_event_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,i*20) as ts, 'x' as event_type, 1 as user_id, 1.0D as value from (select explode(sequence(0,5)) i)")
    assert streams.windowed(df).agg(F.sum("n")).first()[0] == 6 and streams.sessions(df, gap="30 minutes").count() == 1 and streams.sessions(df, gap="10 minutes").count() == 6


def test_messages(spark):
    from lexloom import schema

    df = spark.createDataFrame([("hi",)], "t string").select(schema.text_message("user", F.col("t")).alias("m"))
    assert json.loads(df.select(schema.wire_message(F.col("m")).alias("j")).first().j) == {"role": "user", "content": "hi"}
    assert df.schema["m"].dataType["content"].dataType.elementType["kind"] is not None


def test_store_merges_segments(spark, tmp_path):
    import random

    rng, want = random.Random(3), {}
    t = DocumentTable(spark, f"file://{tmp_path}/docs", "id string, content string", fanout=2)
    df = lambda rows: spark.createDataFrame(rows, "id string, content string")
    for i in range(9):
        rows = {str(rng.randrange(12)): str(i) for _ in range(4)}
        if i % 4 == 3:
            t.delete(df(list(rows.items())))
            want = {k: v for k, v in want.items() if k not in rows}
        elif i % 4 == 1:
            assert t.write(df(list(rows.items())), "skip") == len(rows.keys() - want.keys())
            want = rows | want
        else:
            t.write(df(list(rows.items())), "overwrite")
            want |= rows
        assert {r.id: r.content for r in t.read().collect()} == want and t.count() == len(want)
    t.compact(whole=True)
    assert len(t._segments()[0]) == 1 and {r.id: r.content for r in t.read().collect()} == want


def test_secrets(monkeypatch):
    from lexloom.secrets import Secret, value_of

    monkeypatch.setenv("LEXLOOM_TEST_KEY", "k")
    s = Secret.from_env(["NOT_SET_ANYWHERE", "LEXLOOM_TEST_KEY"])
    assert s.resolve() == "k" and Secret.from_dict(s.to_dict()) == s and value_of("x") == "x" and value_of(s) == "k"
    assert "k" not in repr(Secret.from_token("k")).replace("token", "")
    with pytest.raises(ValueError):
        Secret.from_token("k").to_dict()
    with pytest.raises(ValueError):
        Secret.from_env("NOT_SET_ANYWHERE").resolve()
    assert Secret.from_env("NOT_SET_ANYWHERE", strict=False).resolve() is None


def test_tracing(spark, caplog):
    import logging

    from lexloom import tracing

    p = Pipeline().add("a", Component(typed, {"out": int}))
    tracing.enable(tracing.LoggingTracer())
    try:
        with caplog.at_level(logging.INFO, "lexloom.tracing"):
            p.run({"a": {"value": 1}})
    finally:
        tracing.enable(None)
    assert [r.getMessage().split()[0] for r in caplog.records] == ["pipeline.run/component.run", "pipeline.run"]
    df, seen = tracing.observed(spark.range(5), "rows", n=F.count(F.lit(1)))
    assert df.count() == 5 and seen.get == {"n": 5}


def test_samples_and_types():
    import typing

    from lexloom.plans import samples as x
    from lexloom.plans.pipeline import type_name, type_of

    p = Pipeline().add("add", x.AddFixedValue(2)).add("double", x.double()).add("parity", x.Parity()).add("sum", x.Sum())
    p.connect("add", "double").connect("double.value", "parity").connect("parity.even", "sum.values").connect("parity.odd", "sum.values")
    assert p.run({"add": {"value": 3}})["sum"] == {"total": 10}
    assert x.fstring("{a}-{b}", ["a", "b"])(a=1, b=2) == {"text": "1-2"} and x.remainder(3)(value=5) == {"remainder_is_2": 5}
    assert x.repeat(["p", "q"])(value=1) == {"p": 1, "q": 1} and x.concatenate()(first="a", second="b") == {"value": "ab"}
    for k in (int, list[int], dict[str, list[int]], int | None, Any, typing.Literal["a", 1], Component):
        assert type_of(type_name(k)) == k
    with pytest.raises(PipelineError):
        type_of("print(1)")


def test_component_as_tool():
    from lexloom.plans import samples

    t = agents.tool_from_component(samples.AddFixedValue(2), "add")
    assert t.parameters == {"type": "object", "properties": {"value": {"type": "integer"}, "add": {"type": "integer"}}, "required": ["value"]} and t(value=1) == {"value": 3}


def test_service_readers():
    def server(url, method, headers, body, timeout):
        if method == "PUT":
            return 200, "text/html", b'<html><body><div class="page"><p>auto-\nmatic</p></div><div class="page">two<div>in</div></div></body></html>'
        assert b"whisper-1" in body and b"RIFF" in body and headers["Authorization"] == "Bearer k"
        return 200, "application/json", b'{"text": "spoken"}'

    assert web.text_service(transport=server)(b"x", "f.pdf") == [("automatic\ftwoin", {})]
    assert web.transcriber("http://t", "k", transport=server)(b"RIFF", "a/b.wav") == [("spoken", {"audio_file": "b.wav"})]


def test_replies_end_at_stop_words():
    from lexloom.operators import models

    assert models.until(lambda: lambda batch: [x + " END more" for x in batch], ["END"])()(["a", "b"]) == ["a", "b"]


def test_streamed_replies():
    said = []
    events = [b'data: {"choices": [{"delta": {"content": "He"}}]}\n', b"\n", b": comment\n", b'data: {"choices": [{"delta": {"content": "llo"}}]}\n', b'data: {"choices": [], "usage": {"total_tokens": 3}}\n', b"data: [DONE]\n"]
    asked = []

    def lines(url, headers, body):
        asked.append(json.loads(body))
        yield from events

    chat = models.chat_service("http://x", "key", "m", on_chunk=said.append, lines=lines)()
    assert chat([[{"role": "user", "content": "hi"}]]) == ["Hello"] and said == ["He", "llo"] and asked[0]["stream"] is True
    events[:] = [b'data: {"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "1", "function": {"name": "f", "arguments": "{\\"a\\""}}]}}]}', b'data: {"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": ": 1}"}}]}}]}']
    assert chat([[{"role": "user", "content": "hi"}]])[0]["tool_calls"] == [{"id": "1", "tool_name": "f", "arguments": {"a": 1}}]


def test_token_usage(spark):
    df = spark.createDataFrame([("a", '{"prompt_tokens": 3, "total_tokens": 5}'), ("a", '{"prompt_tokens": 4, "total_tokens": 4}'), ("b", None)], "model string, usage string")
    assert {r.model: (r.prompt_tokens, r.total_tokens) for r in models.token_usage(df).collect()} == {"a": (7, 9), "b": (0, 0)}


def test_filters_in_templates(spark):
    assert build.render("{{ a | upper }} {{ b.c|trim|twice }}", {"a": "x", "b": {"c": " y "}}, {"twice": lambda v: v * 2}) == "X yy"
    assert build.template_variables("{{ a | upper }}{% for x in xs %}{{ x }}{% endfor %}") == ["a", "xs"]
    with pytest.raises(ValueError):
        build.render("{{ a | nothing }}", {"a": 1})
    df = spark.createDataFrame([("q",)], "a string")
    assert build.prompt_rows(df, "{{ a | loud }}", filters={"loud": lambda v: v + "!"}).first().prompt == "q!"


def test_route_output_types(spark):
    from lexloom.errors import PipelineError
    from lexloom.operators import route

    df = spark.createDataFrame([(1, "a")], "id int, s string")
    assert route.conditional_route(df, [("id = 1", "id", "one", "int"), ("true", "s", "other", "string")]).first().route == "one"
    with pytest.raises(PipelineError):
        route.conditional_route(df, [("id = 1", "s", "one", "int")])


def test_stand_ins(spark):
    from lexloom.testing import component_factory, store_class

    store = store_class("Fake", [("1", "a"), ("2", "b")], count=7)(spark)
    assert store.count() == 7 and store.filter({"field": "id", "operator": "==", "value": "2"}).first().content == "b" and type(store).__name__ == "Fake"
    p = Pipeline().add("a", component_factory({"x": int}, {"y": int}, lambda x: {"y": x + 1})()).add("b", component_factory({"y": int}, {"z": str}, {"z": "done"})()).connect("a.y", "b.y")
    assert p.run({"a": {"x": 1}})["b"] == {"z": "done"}
