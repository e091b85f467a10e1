"""The filter language: dictionaries that compile to two-valued, pushable predicates."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.errors import FilterError

COMPARE = ("==", "!=", ">", ">=", "<", "<=", "in", "not in")
LOGIC = ("AND", "OR", "NOT")


def validate(spec: dict[str, Any]) -> None:
    """Raises FilterError unless spec is a comparison or a tree of them."""
    if not isinstance(spec, dict):
        raise FilterError("a filter is a dictionary")
    if "field" in spec:
        for k in ("operator", "value"):
            if k not in spec:
                raise FilterError(f"a comparison needs '{k}'")
        if spec["operator"] not in COMPARE:
            raise FilterError(f"unknown comparison {spec['operator']!r}")
        _check_value(spec["operator"], spec["value"])
        return
    for k in ("operator", "conditions"):
        if k not in spec:
            raise FilterError(f"a filter without a field needs '{k}'")
    if spec["operator"] not in LOGIC:
        raise FilterError(f"unknown operator {spec['operator']!r}")
    for c in spec["conditions"]:
        validate(c)


def _check_value(op: str, value: Any) -> None:
    if op in ("in", "not in") and not isinstance(value, list):
        raise FilterError(f"'{op}' takes a list")
    if op in (">", ">=", "<", "<="):
        if isinstance(value, (list, dict)):
            raise FilterError(f"'{op}' can't order lists or dictionaries")
        if isinstance(value, str) and parse_date(value) is None:
            raise FilterError(f"'{op}' orders numbers and dates; {value!r} is neither")


def parse_date(value: str) -> datetime | None:
    """An ISO date, or a looser one where dateutil is there."""
    try:
        return datetime.fromisoformat(value)
    except ValueError:
        pass
    try:
        from dateutil import parser

        return parser.parse(value)
    except (ImportError, ValueError, OverflowError):
        return None


def _type_of(value: Any) -> str:
    if isinstance(value, list):
        value = next((v for v in value if v is not None), "")
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def resolver(df: DataFrame) -> Callable[[str, Any], Column]:
    """Finds a field: a column by its name, with or without `meta.`, else a path into a meta column (struct, variant, map or JSON)."""
    names = {f.name: f.dataType for f in df.schema.fields}

    def find(field: str, value: Any) -> Column:
        if field in names:
            return F.col(f"`{field}`")
        path = field.removeprefix("meta.")
        head, _, rest = path.partition(".")
        if head in names and not rest:
            return F.col(f"`{head}`")
        if head in names and head != "meta" and isinstance(names[head], T.StructType):
            return F.col(path)
        kind = names.get("meta")
        if isinstance(kind, T.StructType):
            at: Column = F.col("meta")
            for part in path.split("."):
                if not isinstance(kind, T.StructType) or part not in kind.names:
                    return F.lit(None).cast(_type_of(value))
                kind = kind[part].dataType
                at = at[part]
            return at
        if isinstance(kind, T.VariantType):
            return F.try_variant_get("meta", "$." + path, _type_of(value))
        if isinstance(kind, T.MapType):
            return F.try_element_at("meta", F.lit(path))
        if isinstance(kind, T.StringType):
            return F.get_json_object("meta", "$." + path).try_cast(_type_of(value))
        return F.lit(None).cast(_type_of(value))

    find.kind = lambda field: names.get(field, names.get(field.removeprefix("meta.")))
    return find


def _order(col: Column, op: str, value: Any, kind: T.DataType | None = None) -> Column:
    """An ordering comparison. Columns of dates and times are compared as they are, so that the scan prunes by them; others are read as text."""
    if value is None:
        return F.lit(False)
    if isinstance(value, str):
        when = parse_date(value)
        at = F.lit(when).cast("timestamp") if when.tzinfo else F.lit(when.isoformat(sep=" ")).cast("timestamp")
        if isinstance(kind, T.TimestampNTZType):
            at = at.cast("timestamp_ntz") if when.tzinfo else F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
        elif isinstance(kind, T.DateType) and not when.tzinfo and when.time() == time():
            at = F.lit(when.date())
        elif not isinstance(kind, (T.TimestampType, T.DateType)):
            col = F.try_to_timestamp(col.cast("string"))
        value = at
    test = {">": lambda: col > value, ">=": lambda: col >= value, "<": lambda: col < value, "<=": lambda: col <= value}[op]()
    # Never null, and still pushed to the scan, which coalesce(test, false) isn't.
    return col.isNotNull() & test


def compile_filter(spec: dict[str, Any], find: Callable[[str, Any], Column]) -> Column:
    """A predicate that is true or false and never null: missing equals only null, and orders before nothing."""
    if "field" in spec:
        op, value, col = spec["operator"], spec["value"], find(spec["field"], spec["value"])
        if op in ("==", "!="):
            lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
            same = col.eqNullSafe(lit) if value is not None else col.isNull()
            return same if op == "==" else ~same
        if op in ("in", "not in"):
            some = [v for v in value if v is not None]
            hit = (col.isNotNull() & col.isin(*some)) if some else F.lit(False)
            if None in value:
                hit = hit | col.isNull()
            return hit if op == "in" else ~hit
        return _order(col, op, value, getattr(find, "kind", lambda _: None)(spec["field"]))
    parts = [compile_filter(c, find) for c in spec["conditions"]]
    both = reduce(lambda a, b: a & b, parts, F.lit(True))
    if spec["operator"] == "AND":
        return both
    if spec["operator"] == "NOT":
        return ~both
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def apply_filter(df: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    """Rows that match; no filter or an empty one matches all."""
    if not spec:
        return df
    validate(spec)
    return df.where(compile_filter(spec, resolver(df)))


def merge_filters(policy: str, init: dict | None, runtime: dict | None, default_logic: str = "AND") -> dict | None:
    """REPLACE: the filter given at run time, else the first. MERGE: both, joined under the logic of a logical side.

    Two comparisons of one field: the later holds. Two logical filters of one operator pool their conditions; of two
    operators, and for NOT, the later holds whole.
    """
    if policy not in ("replace", "merge"):
        raise FilterError(f"unknown filter policy {policy!r}")
    if policy == "replace" or not init or not runtime:
        return runtime or init
    leaf = lambda f: "field" in f
    if leaf(init) and leaf(runtime):
        if init["field"] == runtime["field"]:
            return runtime
        return {"operator": default_logic, "conditions": [init, runtime]}
    if leaf(init) != leaf(runtime):
        one, tree = (init, runtime) if leaf(init) else (runtime, init)
        if tree["operator"] != default_logic:
            return runtime
        newer = leaf(runtime)
        rest = [c for c in tree["conditions"] if not (leaf(c) and c["field"] == one["field"])]
        if newer:
            return {"operator": default_logic, "conditions": [*rest, one]}
        kept = len(rest) == len(tree["conditions"])
        return {"operator": default_logic, "conditions": [one, *tree["conditions"]] if kept else tree["conditions"]}
    if init["operator"] == runtime["operator"] != "NOT":
        return {"operator": init["operator"], "conditions": [*init["conditions"], *runtime["conditions"]]}
    return runtime
