"""Small components over plain values, for examples and tests of graphs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from lexloom.errors import PipelineError
from lexloom.plans.pipeline import Component, Greedy, Variadic, component


@component(value=int)
class AddFixedValue:
    def __init__(self, add: int = 1):
        self.add, self.params = add, {"add": add}

    def run(self, value: int, add: int | None = None) -> dict:
        return {"value": value + (self.add if add is None else add)}


@component(value=int)
class FirstValue:
    """Passes on the value of whichever sender delivers, as a loop's entry."""

    def run(self, value: Greedy[int]) -> dict:
        return {"value": value[0]}


@component(total=int)
class Sum:
    def run(self, values: Variadic[int]) -> dict:
        return {"total": sum(values)}


@component(value=int)
class Accumulate:
    """Folds the values of its runs by a function."""

    def __init__(self, function: Callable[[int, int], int] = int.__add__):
        self.state, self.function = 0, function

    def run(self, value: int) -> dict:
        self.state = self.function(self.state, value)
        return {"value": self.state}


@component(above=int, below=int)
class Threshold:
    def __init__(self, threshold: int = 10):
        self.threshold, self.params = threshold, {"threshold": threshold}

    def run(self, value: int, threshold: int | None = None) -> dict:
        return {"below" if value < (self.threshold if threshold is None else threshold) else "above": value}


@component(even=int, odd=int)
class Parity:
    def run(self, value: int) -> dict:
        return {"odd" if value % 2 else "even": value}


@component(value=str)
class StringJoiner:
    def run(self, texts: Variadic[str]) -> dict:
        return {"value": " ".join(texts)}


@component(value=list)
class ListJoiner:
    def run(self, lists: Variadic[list]) -> dict:
        return {"value": [x for part in lists for x in part]}


def double() -> Component:
    def run(value: int) -> int:
        return value * 2

    return Component(run, {"value": int})


def subtract() -> Component:
    def run(first: int, second: int) -> dict:
        return {"difference": first - second}

    return Component(run, {"difference": int})


def concatenate() -> Component:
    def run(first: Any, second: Any) -> dict:
        if isinstance(first, str) and isinstance(second, str):
            return {"value": first + second}
        return {"value": [*(first if isinstance(first, list) else [first]), *(second if isinstance(second, list) else [second])]}

    return Component(run, {"value": Any})


def remainder(divisor: int = 3) -> Component:
    """One output for each remainder."""
    if divisor < 1:
        raise PipelineError("the divisor must be at least 1")

    def run(value: int) -> dict:
        return {f"remainder_is_{value % divisor}": value}

    return Component(run, {f"remainder_is_{i}": int for i in range(divisor)})


def repeat(outputs: list[str]) -> Component:
    """Gives its value on each of some outputs."""

    def run(value: int) -> dict:
        return dict.fromkeys(outputs, value)

    return Component(run, dict.fromkeys(outputs, int))


def fstring(template: str, variables: list[str]) -> Component:
    """A format string whose variables are inputs."""

    def run(**values: Any) -> dict:
        return {"text": values.pop("template", template).format(**values)}

    c = Component(run, {"text": str})
    for v in variables:
        c.set_input(v, Any)
    return c.set_input("template", str, required=False)


def greet(message: str = "Greeting: {value}") -> Component:
    """Passes its value on and hands a message about it to whoever listens."""

    def run(value: int, listener: Callable[[str], None] = lambda _: None) -> int:
        listener(message.format(value=value))
        return value

    return Component(run, {"value": int})


def hello() -> Component:
    def run(word: str) -> str:
        return f"Hello, {word}!"

    return Component(run, {"output": str})


def text_splitter() -> Component:
    def run(sentence: str) -> list:
        return sentence.split()

    return Component(run, {"output": list})
