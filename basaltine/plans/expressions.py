"""Expressions of requests: SQL text, or trees of columns, literals and calls of the function library.

    {"call": "date_format", "args": [{"column": "o_orderdate"}, {"value": "%Y-%m"}], "as": "month"}

A literal is passed as it is where the function takes plain values (layouts, patterns, digits), and as a column elsewhere.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import plugins
from ..functions import aggregates, casts, collations, hashing, jsons, maths, network, numeric, strings, temporal, vectors

#: Later modules win where names are the same; qualified names reach every function.
MODULES: tuple[ModuleType, ...] = (collations, casts, numeric, maths, hashing, network, vectors, temporal, strings)


def _public(module: ModuleType) -> dict[str, Callable]:
    return {n.rstrip("_"): f for n, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not n.startswith("_")}


def library() -> dict[str, Callable]:
    """Every function by its name and by module.name; JSON functions are json_name, aggregates agg.name, plugins come last."""
    out: dict[str, Callable] = {}
    for m in MODULES:
        own = _public(m)
        out |= own | {f"{m.__name__.rsplit('.', 1)[1]}.{n}": f for n, f in own.items()}
    out |= {f"json_{n}": f for n, f in _public(jsons).items() if n not in ("parse_path", "wild", "find", "dump", "type_of", "depth_of")}
    out |= {f"agg.{n}": f for n, f in _public(aggregates).items()}
    return out | plugins.FUNCTIONS


def build(tree: object) -> Column:
    """The Column of a text or tree."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, str):
        return F.expr(tree)
    if not isinstance(tree, dict):
        raise ValueError(f"not an expression: {tree!r}")
    if "column" in tree:
        out = F.col(tree["column"])
    elif "value" in tree:
        out = F.lit(tree["value"])
    elif "call" in tree:
        table = library()
        if tree["call"] not in table:
            raise ValueError(f"unknown function {tree['call']!r}")
        fn = table[tree["call"]]
        out = fn(*_arguments(fn, tree.get("args", [])))
    else:
        raise ValueError(f"not an expression: {tree!r}")
    return out.alias(tree["as"]) if "as" in tree else out


def _arguments(fn: Callable, args: list) -> list:
    kinds = [p for p in inspect.signature(fn).parameters.values()]
    out = []
    for i, a in enumerate(args):
        p = kinds[min(i, len(kinds) - 1)] if kinds else None
        plain = p is not None and "Column" not in str(p.annotation)
        out.append(a["value"] if plain and isinstance(a, dict) and "value" in a else build(a))
    return out
