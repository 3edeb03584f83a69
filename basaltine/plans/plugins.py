"""Plugins: functions and table operators that callers add to requests by name, and SQL functions of a session.

A module that adds its own with the decorators is loaded, and loaded anew after a change, by `load`.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

Function = Callable[..., Column]
#: Takes a table and the request's own arguments.
Operator = Callable[..., DataFrame]
FUNCTIONS: dict[str, Function] = {}
OPERATORS: dict[str, Operator] = {}


def function(name: str) -> Callable[[Function], Function]:
    """Add a function of columns; requests call it by `name`, before any function of the library."""

    def add(fn: Function) -> Function:
        FUNCTIONS[name] = fn
        return fn

    return add


def operator(name: str) -> Callable[[Operator], Operator]:
    """Add an operator; requests use it as {"type": "plugin", "name": name, "arguments": {...}}."""

    def add(fn: Operator) -> Operator:
        OPERATORS[name] = fn
        return fn

    return add


def remove(name: str) -> None:
    if FUNCTIONS.pop(name, None) is None and OPERATORS.pop(name, None) is None:
        raise KeyError(name)


def load(module: str) -> None:
    """Import a module of plugins, or read it again if it is there."""
    if module in sys.modules:
        importlib.reload(sys.modules[module])
    else:
        importlib.import_module(module)


def call(table: DataFrame, name: str, arguments: dict | None = None) -> DataFrame:
    if name not in OPERATORS:
        raise ValueError(f"unknown plugin {name!r}")
    return OPERATORS[name](table, **(arguments or {}))


def define(spark: SparkSession, name: str, arguments: Sequence[tuple[str, str]], body: str, returns: str | None = None) -> None:
    """A SQL function of the session: its body is an expression over its (name, type) arguments, which the optimizer sees through."""
    typed = ", ".join(f"{n} {t}" for n, t in arguments)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) {f'RETURNS {returns} ' if returns else ''}RETURN {body}")
