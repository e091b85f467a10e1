"""Stand-ins for tests of graphs and pipelines: stores and components made from a name and what they hold or return."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexloom.functions.filters import apply_filter
from lexloom.plans.pipeline import Component


def store_class(name: str, documents: Sequence[tuple] | None = None, schema: str = "id string, content string", count: int | None = None, bases: tuple[type, ...] = (), fields: Mapping[str, Any] | None = None) -> type:
    """A store class that always holds the given documents: `filter`, `count`, `read`, and writes and deletes that change nothing."""

    def init(self, spark: SparkSession):
        self.spark = spark

    def read(self) -> DataFrame:
        return self.spark.createDataFrame(list(documents or ()), schema)

    members = {
        "__init__": init, "read": read, "filter": lambda self, spec=None: apply_filter(self.read(), spec), "count": lambda self: len(documents or ()) if count is None else count,
        "write": lambda self, batch, policy="none": 0, "delete": lambda self, ids: None, "__module__": __name__,
    }
    return type(name, bases, members | dict(fields or {}))


def component_factory(inputs: Mapping[str, Any] | None = None, outputs: Mapping[str, Any] | None = None, result: Mapping[str, Any] | Callable[..., dict] | None = None) -> Callable[[], Component]:
    """Makes components with these input and output types (by default `value`, of any type) that return a fixed result or what a function makes."""
    takes, gives = dict(inputs or {"value": Any}), dict(outputs or {"value": Any})

    def make() -> Component:
        def run(**values: Any) -> dict:
            if callable(result):
                return result(**values)
            return dict(result) if result is not None else dict.fromkeys(gives)

        part = Component(run, gives)
        for port, kind in takes.items():
            part.set_input(port, kind)
        return part

    return make
