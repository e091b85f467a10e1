"""Tools, conversation state and the bounded agent loop. A batch of conversations advances one step a round."""

from __future__ import annotations

import dataclasses
import inspect
import json
import types
import typing
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.errors import LexloomError

JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class ToolError(LexloomError):
    """A tool that is unknown, or failed."""


@dataclass
class Tool:
    """A named function with a JSON schema of its parameters. inputs and outputs map state keys to parameters and results to state keys."""

    name: str
    description: str
    parameters: dict
    function: Callable[..., Any]
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)

    def spec(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": self.parameters}

    def __call__(self, **arguments: Any) -> Any:
        try:
            return self.function(**arguments)
        except Exception as e:
            raise ToolError(f"{self.name} failed: {e}") from e


def tool_from_function(f: Callable, name: str | None = None, description: str | None = None) -> Tool:
    """A tool whose parameters come from the function's annotations."""
    hints = typing.get_type_hints(f)
    props, need = {}, []
    for p in inspect.signature(f).parameters.values():
        if p.name not in hints:
            raise ToolError(f"parameter {p.name!r} has no type")
        t = hints[p.name]
        args = [a for a in typing.get_args(t) if a is not type(None)]
        base = typing.get_origin(t) or t
        base = base if base in JSON_TYPES else (typing.get_origin(args[0]) or args[0] if args else str)
        props[p.name] = {"type": JSON_TYPES.get(base, "string")}
        if p.default is inspect.Parameter.empty:
            need.append(p.name)
        else:
            props[p.name]["default"] = p.default
    return Tool(name or f.__name__, description or inspect.getdoc(f) or "", {"type": "object", "properties": props, **({"required": need} if need else {})}, f)


def tool(f: Callable | None = None, **kw: Any):
    """Decorator form of tool_from_function."""
    return tool_from_function(f, **kw) if f is not None else lambda g: tool_from_function(g, **kw)


def tool_from_component(part: Any, name: str, description: str = "") -> Tool:
    """A tool that runs a graph's component; its parameters are the component's inputs with their types and docstring."""
    from lexloom.plans.pipeline import as_component

    c = as_component(part)
    props = {p: json_type(k) for p, (k, _) in c.inputs.items()}
    need = [p for p, (_, required) in c.inputs.items() if required]
    text = description or inspect.getdoc(c.function) or ""
    return Tool(name, text, {"type": "object", "properties": props, **({"required": need} if need else {})}, lambda **kw: c(**kw))


def json_type(kind: Any) -> dict:
    """The JSON schema of a type: plain types, lists and dictionaries by their arguments, dataclasses by their fields, unions by their first member."""
    args = [a for a in typing.get_args(kind) if a is not type(None)]
    base = typing.get_origin(kind) or kind
    if base in (typing.Union, types.UnionType):
        return json_type(args[0])
    if base is list:
        return {"type": "array", **({"items": json_type(args[0])} if args else {})}
    if dataclasses.is_dataclass(base):
        hints = typing.get_type_hints(base)
        return {"type": "object", "properties": {f.name: json_type(hints[f.name]) for f in dataclasses.fields(base)}}
    return {"type": JSON_TYPES.get(base, "string")}


class Toolset:
    """Tools with names of their own."""

    def __init__(self, tools: Sequence[Tool] = ()):
        self.tools: dict[str, Tool] = {}
        for t in tools:
            self.add(t)

    def add(self, t: Tool | Toolset) -> None:
        for x in t.tools.values() if isinstance(t, Toolset) else [t]:
            if x.name in self.tools:
                raise ToolError(f"two tools are called {x.name!r}")
            self.tools[x.name] = x

    def __add__(self, other: Tool | Toolset) -> Toolset:
        out = Toolset(list(self.tools.values()))
        out.add(other)
        return out

    def __iter__(self):
        return iter(self.tools.values())

    def __len__(self) -> int:
        return len(self.tools)


def append(old: Any, new: Any) -> list:
    return [*(old or []), *(new if isinstance(new, list) else [new])]


def replace(_: Any, new: Any) -> Any:
    return new


class State:
    """Keyed values, each merged by its handler: lists append, other types are replaced, unless the schema names another."""

    def __init__(self, schema: dict[str, dict] | None = None, data: dict | None = None):
        self.schema = {"messages": {"type": list}} | (schema or {})
        for k, s in self.schema.items():
            if "type" not in s:
                raise ValueError(f"the state key {k!r} has no type")
            s.setdefault("handler", append if (typing.get_origin(s["type"]) or s["type"]) is list else replace)
        self.data: dict[str, Any] = {}
        for k, v in (data or {}).items():
            self.set(k, v)

    def get(self, key: str, default: Any = None) -> Any:
        return self.data.get(key, default)

    def has(self, key: str) -> bool:
        return key in self.data

    def set(self, key: str, value: Any, handler: Callable | None = None) -> None:
        if key not in self.schema:
            raise ValueError(f"{key!r} is not in the state's schema")
        self.data[key] = (handler or self.schema[key]["handler"])(self.data.get(key), value)


def invoke(calls: Sequence[dict], tools: Toolset, state: State, raise_on_failure: bool = True) -> list[dict]:
    """Runs tool calls one after the other, merges their outputs into the state and gives the tool messages."""
    out = []
    for c in calls:
        error, result = False, None
        try:
            if c["tool_name"] not in tools.tools:
                raise ToolError(f"no tool is called {c['tool_name']!r}")
            t = tools.tools[c["tool_name"]]
            args = {p: state.get(k) for k, p in t.inputs.items() if state.has(k)} | c["arguments"]
            result = t(**args)
            for k, key in t.outputs.items():
                state.set(key, result[k] if isinstance(result, dict) else result)
        except ToolError as e:
            if raise_on_failure:
                raise
            error, result = True, str(e)
        text = result if isinstance(result, str) else json.dumps(result, default=str, sort_keys=True)
        out.append({"role": "tool", "content": text, "tool_call_id": c.get("id"), "tool_name": c["tool_name"], "error": error})
    return out


def run_agent(model: Callable, messages: list[dict], tools: Toolset, system: str | None = None, exit_conditions: Sequence[str] = ("text",), schema: dict | None = None, max_steps: int = 100, raise_on_failure: bool = False, **data: Any) -> dict:
    """Model, tools and state in turn until a text reply, an exit tool that did not fail, or the last step."""
    bad = [e for e in exit_conditions if e != "text" and e not in tools.tools]
    if bad:
        raise ValueError(f"exit conditions {bad} are no tools")
    state = State(schema, data)
    state.set("messages", ([{"role": "system", "content": system}] if system else []) + list(messages))
    for _ in range(max_steps):
        reply = model(state.get("messages"), [t.spec() for t in tools])
        if isinstance(reply, str):
            reply = {"text": reply, "tool_calls": []}
        calls = reply.get("tool_calls") or []
        state.set("messages", {"role": "assistant", "content": reply.get("text"), "tool_calls": calls})
        if not calls:
            break
        results = invoke(calls, tools, state, raise_on_failure)
        state.set("messages", results)
        if any(r["tool_name"] in exit_conditions and not r["error"] for r in results):
            break
    return dict(state.data)


def run_agents(conversations: DataFrame, factory: Callable[[], Callable], tools: Callable[[], Toolset], max_steps: int = 100, prompt: str = "text", exit_conditions: Sequence[str] = ("text",)) -> DataFrame:
    """Adds reply and steps to each row's prompt; agents run in Arrow batches, each row by itself."""
    def run(parts):
        model, box = factory(), tools()
        for p in parts:
            got = [run_agent(model, [{"role": "user", "content": t}], box, exit_conditions=exit_conditions, max_steps=max_steps)["messages"] for t in p[prompt]]
            yield pd.concat([p.reset_index(drop=True), pd.DataFrame({"reply": [m[-1]["content"] for m in got], "steps": [sum(x["role"] == "assistant" for x in m) for m in got]})], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.schema.fields)
    return conversations.mapInPandas(run, ddl + ", reply string, steps long")


def check_schema(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What in a value breaks a JSON schema: type, enum, required, properties, additionalProperties, items, bounds, pattern, anyOf."""
    import re

    errors: list[str] = []
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want is not None:
        names = want if isinstance(want, list) else [want]
        if not any(isinstance(value, kinds[n]) and not (isinstance(value, bool) and n in ("integer", "number")) for n in names):
            return [f"{path}: {json.dumps(value)} is no {' or '.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{path}: {json.dumps(value)} is none of {schema['enum']}")
    if isinstance(value, dict):
        errors += [f"{path}: {k!r} is missing" for k in schema.get("required", []) if k not in value]
        props = schema.get("properties", {})
        for k, v in value.items():
            if k in props:
                errors += check_schema(v, props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{path}: {k!r} is not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            errors += check_schema(v, schema["items"], f"{path}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        errors += [f"{path}: {value} is below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        errors += [f"{path}: {value} is above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        errors.append(f"{path}: {value!r} doesn't match {schema['pattern']!r}")
    if "anyOf" in schema and all(check_schema(value, s, path) for s in schema["anyOf"]):
        errors.append(f"{path}: fits none of the alternatives")
    return errors


def validate_json(df: DataFrame, schema: dict, column: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(rows whose JSON fits, rows that don't with error and a prompt to correct it)."""
    @F.pandas_udf("string")
    def problems(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                found = check_schema(json.loads(t or ""), schema)
            except json.JSONDecodeError as e:
                return f"no JSON: {e}"
            return "; ".join(found) or None

        return s.map(one)

    got = df.withColumn("error", problems(F.col(column)))
    text = F.concat(F.lit("The reply\n"), F.coalesce(F.col(column), F.lit("")), F.lit("\ndoes not fit the schema: "), F.col("error"), F.lit("\nGive only corrected JSON that fits\n" + json.dumps(schema, sort_keys=True)))
    return got.where("error is null").drop("error"), got.where("error is not null").withColumn("recovery_prompt", text)
