"""Requests: a list of operators as plain data, checked and turned into one DataFrame plan.

    {"table": "lineitem", "executors": [
        {"type": "table_scan", "columns": [...], "key": "l_orderkey", "ranges": [[1, 100]]},
        {"type": "selection", "conditions": ["l_quantity > 10"]},
        {"type": "aggregation", "group_by": ["l_returnflag"], "aggregates": ["count(1) as n"]},
        {"type": "top_n", "order_by": [["n", true]], "limit": 3}],
     "output": ["n", "l_returnflag"]}

Expressions are Spark SQL text or trees (see `expressions`).  The first executor is a scan; joins, exchanges and sorts aren't part of a request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import relational as R
from . import plugins
from .expressions import build

SCANS = ("table_scan", "index_scan", "index_lookup")
REJECTED = ("join", "kill", "exchange_sender", "exchange_receiver", "partition_table_scan", "sort", "window", "expand")


def check(request: dict) -> None:
    """Raise ValueError unless the request can run."""
    executors = request.get("executors") or []
    if not executors:
        raise ValueError("a request needs executors")
    for i, e in enumerate(executors):
        kind = e.get("type")
        if kind in REJECTED:
            raise ValueError(f"executor {kind} isn't supported in a request")
        if kind not in _BUILD and kind not in SCANS:
            raise ValueError(f"unknown executor {kind!r}")
        if (kind in SCANS) != (i == 0):
            raise ValueError("a request has one scan, as its first executor")


def _ranges(e: dict) -> list[R.KeyRange] | None:
    return None if e.get("ranges") is None else [R.KeyRange(*r) for r in e["ranges"]]


def _scan(table: DataFrame, e: dict) -> DataFrame:
    if e["type"] == "table_scan":
        return R.table_scan(table, e["columns"], e.get("key"), _ranges(e), e.get("desc", False), e.get("ordered", False))
    index = R.index_scan(table, e["index"], e["handle"], _ranges(e), e.get("desc", False), e["type"] == "index_scan", e.get("unique", False))
    return index if e["type"] == "index_scan" else R.index_lookup(index, table, e["handle"], e["columns"])


def _aggregates(e: dict) -> list:
    return [build(a) for a in e.get("aggregates", [])]


_BUILD: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "selection": lambda df, e: R.selection(df, [build(c) for c in e["conditions"]]),
    "projection": lambda df, e: R.projection(df, [build(c) for c in e["expressions"]]),
    "aggregation": lambda df, e: R.hash_aggregation(df, [build(g) for g in e["group_by"]], _aggregates(e)) if e.get("group_by") else R.simple_aggregation(df, _aggregates(e)),
    "stream_aggregation": lambda df, e: R.stream_aggregation(df, e["group_by"], _aggregates(e)) if e.get("group_by") else R.simple_aggregation(df, _aggregates(e)),
    "limit": lambda df, e: R.partition_limit(df, e["partition_by"], e["limit"]) if e.get("partition_by") else R.limit(df, e["limit"]),
    "top_n": lambda df, e: R.top_n(df, [tuple(o) for o in e["order_by"]], e["limit"]),
    "plugin": lambda df, e: plugins.call(df, e["name"], e.get("arguments")),
    "partition_top_n": lambda df, e: R.partition_top_n(df, e["partition_by"], [tuple(o) for o in e["order_by"]], e["limit"]),
}


def run(spark: SparkSession, sf_dir: str, request: dict) -> DataFrame:
    """The request's result; nothing runs until it is used."""
    check(request)
    table = R.read(spark, sf_dir, request["table"])
    df = _scan(table, request["executors"][0])
    for e in request["executors"][1:]:
        df = _BUILD[e["type"]](df, e)
    return df.select(*request["output"]) if request.get("output") else df
