"""Tables between steps, joins that hot keys don't slow down, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers that are broadcast at most; beyond it tables are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Edges that one task solves at once (16 bytes each); beyond it components are found in rounds over all tasks.
EDGES_AT_ONCE = 2_000_000


def ready(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder is set on a local master; on a cluster that is an error,
    since executors couldn't read each other's tables there.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def folder(spark: SparkSession) -> str:
    """A fresh path under the shared folder."""
    return f"{ready(spark)}/table-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `df` written as Parquet in the shared folder, and read from there."""
    path = path or folder(df.sparkSession)
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables in the shared folder, deleted as soon as nothing needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write `df` under a name; a table of that name from before is deleted afterwards."""
        before, path = self.paths.get(name), folder(self.spark)
        out = checkpointed(df, path)
        self.paths[name] = path
        if before:
            self._delete(before)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def clear(self) -> None:
        self.drop(*list(self.paths))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def looked_up(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` joined to `groups`, a written table of one row for each key with its number `n` of rows.

    Few groups are broadcast.  Of many, those of the hottest keys are broadcast and the others are
    joined by shuffling, so that no task gets more rows of one key than a hundred-thousandth of all
    (10 000 at least); at most 100 000 keys can be that hot.
    """
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= most:
        return rows.join(F.broadcast(groups), on, how)
    limit = max(10_000, int(total) // 100_000)
    hot = groups.where(F.col("n") > limit)
    apart = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(apart.join(groups.where(F.col("n") <= limit), on, how))


def joined(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` joined to a written table whose keys no hot share of the rows has; broadcast if counted to be few."""
    return rows.join(F.broadcast(table) if table.count() <= most else table, on, how)


# ---------------------------------------------------------------- components

_EDGES = "u long, v long"


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) of every node of the edges that isn't the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[own]], nodes[own]


def _starred(most: int):
    """For mapInArrow: edges (u, v) to stars, `most` edges at a time; all of a task's if it has no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch.column("u").to_numpy()), v.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held > most:
                yield table(stars(np.concatenate(u), np.concatenate(v)))
                u, v, held = [], [], 0
        if held:
            yield table(stars(np.concatenate(u), np.concatenate(v)))

    def table(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["u", "v"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = EDGES_AT_ONCE, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the edges, as a written table (`known` of the scratch, if one
    is given); a component is named by its least node.

    Each task first turns its own edges into stars.  If `at_once` or fewer edges are left, one task
    solves them.  More are solved in rounds: each replaces the edges by as many or fewer that lead to
    lower nodes, until nothing changes; both steps are aggregations and joins on the node in which hot
    nodes are split off, and each round's table replaces the one before.  No edges: no rows.
    """
    own = Scratch(edges.sparkSession)
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v")
    now = own.keep("now", pairs.mapInArrow(_starred(at_once), _EDGES).distinct())
    n = now.count()
    if n <= at_once:
        now = now.coalesce(1).mapInArrow(_starred(max(1, n)), _EDGES)
    else:
        before = None
        while True:
            # large star: the higher neighbours of each node go to its lowest neighbour (or itself)
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = own.keep("low", both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
            large = own.keep("large", looked_up(both.where("v > u"), low, ["u"]).select(F.col("m").alias("u"), "v").where("u <> v").distinct())
            # small star: each node and its lower neighbours go to the lowest of these
            least = own.keep("least", large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
            small = looked_up(large, least, ["v"]).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
            now = own.keep("now", small)
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    named = now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    out = scratch.keep("known", named) if scratch else checkpointed(named)
    own.clear()
    return out
