"""Spans around runs of graphs and their components, and counters inside Spark jobs. Nothing is traced until a tracer is set."""

from __future__ import annotations

import contextlib
import logging
import os
import time
from collections.abc import Iterator
from contextvars import ContextVar
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Observation


class Span(Protocol):
    def set_tag(self, key: str, value: Any) -> None: ...


class Tracer(Protocol):
    def trace(self, name: str, tags: dict[str, Any]) -> contextlib.AbstractContextManager[Span]: ...


class LoggedSpan:
    def __init__(self, name: str, parent: LoggedSpan | None, tags: dict[str, Any]):
        self.name, self.parent, self.tags, self.seconds = name, parent, dict(tags), 0.0

    def set_tag(self, key: str, value: Any) -> None:
        self.tags[key] = value


class _Current:
    """The span that is open; code that travels to a task finds none there."""

    def __init__(self):
        self.var: ContextVar[LoggedSpan | None] = ContextVar("lexloom_span", default=None)
        self.get, self.set, self.reset = self.var.get, self.var.set, self.var.reset

    def __reduce__(self):
        return _Current, ()


_current = _Current()


class LoggingTracer:
    """Writes each span to a logger as it ends, with its path, seconds and tags."""

    def __init__(self, logger: logging.Logger | None = None):
        self.log = logger or logging.getLogger("lexloom.tracing")

    @contextlib.contextmanager
    def trace(self, name: str, tags: dict[str, Any]) -> Iterator[LoggedSpan]:
        span = LoggedSpan(name, _current.get(), tags)
        token, began = _current.set(span), time.monotonic()
        try:
            yield span
        finally:
            _current.reset(token)
            span.seconds = time.monotonic() - began
            path, up = name, span.parent
            while up is not None:
                path, up = f"{up.name}/{path}", up.parent
            self.log.info("%s %.3f s %s", path, span.seconds, span.tags)


class OpenTelemetryTracer:
    """Spans of an OpenTelemetry tracer; values that it can't carry become text."""

    def __init__(self, tracer: Any):
        self.tracer = tracer

    @contextlib.contextmanager
    def trace(self, name: str, tags: dict[str, Any]) -> Iterator[Span]:
        with self.tracer.start_as_current_span(name) as raw:

            class One:
                def set_tag(self, key: str, value: Any) -> None:
                    raw.set_attribute(key, value if isinstance(value, (str, bool, int, float)) else repr(value))

            span = One()
            for k, v in tags.items():
                span.set_tag(k, v)
            yield span


_tracer: Tracer | None = None


def enable(tracer: Tracer | None) -> None:
    """Sets the tracer of this process; None ends tracing."""
    global _tracer
    _tracer = tracer


def shows_content() -> bool:
    """Inputs and outputs are traced only where LEXLOOM_TRACE_CONTENT is true."""
    return os.environ.get("LEXLOOM_TRACE_CONTENT", "").lower() == "true"


@contextlib.contextmanager
def trace(name: str, **tags: Any) -> Iterator[Span]:
    if _tracer is None:
        yield LoggedSpan(name, None, tags)
    else:
        with _tracer.trace(name, tags) as span:
            yield span


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with aggregates that are computed on its way through the next action, and where to get them."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o
