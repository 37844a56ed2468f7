"""Rules on stated cases: inputs and what must come of them stand side by side, typed by hand."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame


class Case(NamedTuple):
    inputs: str
    outputs: list[str]
    rows: list[tuple]
    build: Callable[[DataFrame], list[Column]]


CASES: dict[str, Case] = {}


def cases(name: str, inputs: str, outputs: str, rows: list[tuple], build: Callable[[DataFrame], list[Column]]) -> None:
    """inputs: the schema of what a case gives. outputs: "name type" of what comes, in the order of build. rows: (inputs, expected outputs)."""
    CASES[name] = Case(inputs, [o.strip().rsplit(" ", 1)[0] for o in outputs.split(", ")], rows, build)
