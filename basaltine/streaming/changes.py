"""Change streams: a log of transaction events, its committed changes, a progress watermark, and replicas.

A log row is (region_id, key, op, start_ts, commit_ts, value) with op PREWRITE, COMMIT_PUT,
COMMIT_DELETE or ROLLBACK.  Delivery is at least once.  A region's resolved ts is a time below
which no further commit can come: the least start_ts of its open transactions, or the greatest
ts seen.  Batch and stream share the functions that take a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "region_id long, key long, op string, start_ts long, commit_ts long, value string"


def commits(log: DataFrame) -> DataFrame:
    """(region_id, key, op, start_ts, commit_ts, value) of committed changes; op is put or delete.

    A commit without a value takes it from its prewrite.
    """
    own = log.where("op in ('COMMIT_PUT', 'COMMIT_DELETE')")
    images = log.where("op = 'PREWRITE'").select("key", "start_ts", F.col("value").alias("__image")).dropDuplicates(["key", "start_ts"])
    out = own.join(images, ["key", "start_ts"], "left")
    return out.select("region_id", "key", F.when(F.col("op") == "COMMIT_PUT", "put").otherwise("delete").alias("op"), "start_ts", "commit_ts", F.coalesce("value", "__image").alias("value")).dropDuplicates(["key", "commit_ts"])


def resolved_ts(log: DataFrame) -> DataFrame:
    """(region_id, resolved_ts): open transactions hold it back.  One aggregation by transaction, one by region."""
    by_txn = log.groupBy("region_id", "key", "start_ts").agg(F.max(F.greatest("start_ts", F.coalesce("commit_ts", "start_ts"))).alias("seen"), F.bool_or(F.col("op") != "PREWRITE").alias("closed"))
    by_region = by_txn.groupBy("region_id").agg(F.max("seen").alias("seen"), F.min(F.when(~F.col("closed"), F.col("start_ts"))).alias("oldest"))
    return by_region.select("region_id", F.least("seen", F.coalesce(F.col("oldest") - 1, "seen")).alias("resolved_ts"))


def open_locks(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(region_id, key, start_ts, value) of prewrites that have neither a commit nor a rollback, begun at `upto` at the latest."""
    own = log if upto is None else log.where(F.col("start_ts") <= upto)
    ends = own.where("op <> 'PREWRITE'").select("key", "start_ts")
    return own.where("op = 'PREWRITE'").select("region_id", "key", "start_ts", "value").dropDuplicates(["key", "start_ts"]).join(ends, ["key", "start_ts"], "left_anti")


def frontier(resolved: DataFrame) -> DataFrame:
    """The least resolved ts of all regions."""
    return resolved.agg(F.min("resolved_ts").alias("resolved_ts"))


def replica(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, value): the last change of each key, without deleted keys."""
    own = changes if upto is None else changes.where(F.col("commit_ts") <= upto)
    last = own.groupBy("key").agg(F.max_by(F.struct("op", "value"), "commit_ts").alias("v"))
    return last.where("v.op = 'put'").select("key", "v.value")


def incremental(changes: DataFrame, checkpoint: int) -> DataFrame:
    return changes.where(F.col("commit_ts") > checkpoint)


def without_source(changes: DataFrame, mask: int, column: str = "txn_source") -> DataFrame:
    """Drop changes that came by replication themselves."""
    return changes.where(F.col(column).bitwiseAND(F.lit(mask)) == 0)


def overlaps(low: Column, high: Column, start: Column, end: Column) -> Column:
    """Whether [low, high) and [start, end) share keys; a null end is unbounded."""
    return (end.isNull() | (low < end)) & (high.isNull() | (start < high))


def topology_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(region_id, start_key, end_key, change) of regions that are added or removed."""
    keys = ["region_id", "start_key", "end_key"]
    return new.join(old, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, keys, "left_anti").withColumn("change", F.lit("removed")))


def read_log(spark: SparkSession, path: str, files: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """A stream of log files as they arrive under a path; a batch takes `files` files or about `most_bytes` bytes at most."""
    if files and most_bytes:
        raise ValueError("a batch is bounded by files or by bytes, not both")
    reader = spark.readStream.schema(LOG)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if most_bytes:
        reader = reader.option("maxBytesPerTrigger", most_bytes)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_STATE = LOG + ", sent boolean"
_PROGRESS = "region_id long, seen long, resolved_ts long"


def _transactions(every: DataFrame) -> DataFrame:
    """One row for each (key, start_ts): its prewrite's image, its end, and whether that was sent before."""
    ends = F.col("op") != "PREWRITE"
    return every.groupBy("key", "start_ts").agg(
        F.max("region_id").alias("region_id"), F.bool_or(~ends).alias("prewritten"), F.max(F.when(~ends, F.col("value"))).alias("image"),
        F.max(F.when(ends, F.struct("op", "commit_ts", "value"))).alias("end"), F.bool_or(F.coalesce("sent", F.lit(False))).alias("sent"),
    )


def replicate(log: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append each micro-batch's committed changes under `target`, once: batches are directories by their number.

    What a batch leaves unfinished goes on to the next as its state: prewrites without an end, and
    ends whose prewrite hasn't come (it may be in a later batch; a commit without a value waits for
    it).  A batch reads only the state of the one before it, so the work is that of the batch and of
    what is open, and a batch that is run again after a failure replaces its own directories.
    Beside it, `progress` has the resolved ts of each region, which never falls.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            path = f"{target}/{name}/batch={number - 1}"
            return spark.read.schema(schema).parquet(path) if number and _exists(spark, path) else spark.createDataFrame([], schema)

        own = _transactions(batch.withColumn("sent", F.lit(False)).unionByName(before("state", _STATE))).persist()
        value = F.coalesce("end.value", "image")
        ready = (F.col("end.op") == "COMMIT_DELETE") | (F.col("end.op") == "COMMIT_PUT") & (F.col("prewritten") | F.col("end.value").isNotNull())
        due = ~F.col("sent") & F.coalesce(ready, F.lit(False))
        sent = own.where(due).select("region_id", "key", F.when(F.col("end.op") == "COMMIT_PUT", "put").otherwise("delete").alias("op"), "start_ts", F.col("end.commit_ts").alias("commit_ts"), value.alias("value"))
        sent.write.mode("overwrite").parquet(f"{target}/changes/batch={number}")
        op = F.coalesce("end.op", F.lit("PREWRITE"))
        rest = own.where("end is null or not prewritten").select("region_id", "key", op.alias("op"), "start_ts", F.col("end.commit_ts").alias("commit_ts"), value.alias("value"), (F.col("sent") | due).alias("sent"))
        rest.write.mode("overwrite").parquet(f"{target}/state/batch={number}")
        seen = batch.groupBy("region_id").agg(F.max(F.greatest("start_ts", F.coalesce("commit_ts", "start_ts"))).alias("seen"))
        held = own.where("end is null").groupBy("region_id").agg(F.min("start_ts").alias("oldest"))
        past = before("progress", _PROGRESS)
        both = seen.select("region_id", "seen", F.lit(None).cast("long").alias("resolved_ts")).unionByName(past).groupBy("region_id").agg(F.max("seen").alias("seen"), F.max("resolved_ts").alias("past"))
        now = both.join(held, "region_id", "left").select("region_id", "seen", F.greatest("past", F.least("seen", F.coalesce(F.col("oldest") - 1, "seen"))).alias("resolved_ts"))
        now.write.mode("overwrite").parquet(f"{target}/progress/batch={number}")
        own.unpersist()
        for name in ("state", "progress"):  # the last two stay: the one before is read if this batch is run again
            _delete(spark, f"{target}/{name}/batch={number - 2}")
        if on_batch:
            on_batch(batch, number)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolved_so_far(spark: SparkSession, target: str) -> DataFrame:
    """(region_id, resolved_ts) after the newest batch under a replication's target."""
    own = spark.read.schema(_PROGRESS + ", batch long").parquet(f"{target}/progress")
    return own.groupBy("region_id").agg(F.max_by("resolved_ts", "batch").alias("resolved_ts"))


class Replication:
    """States of a replication task: idle, subscribing, paused, cutting_over, completed, activated."""

    MOVES = {"idle": {"start"}, "subscribing": {"pause", "complete"}, "paused": {"start"}, "cutting_over": {"complete"}, "completed": {"activate"}, "activated": set()}
    ACTIONS = ("start", "pause", "complete", "activate", "status")

    def __init__(self, spark: SparkSession, source: str, target: str, checkpoint: str):
        self.spark, self.source, self.target, self.checkpoint = spark, source, target, checkpoint
        self.state = "idle"

    def _move(self, name: str, to: str) -> None:
        if name not in self.MOVES[self.state]:
            raise ValueError(f"can't {name} while {self.state}")
        self.state = to

    def _take_in(self) -> None:
        replicate(read_log(self.spark, self.source), self.target, self.checkpoint).awaitTermination()

    def start(self) -> None:
        """Take in all that is there, from the checkpoint on."""
        self._move("start", "subscribing")
        self._take_in()

    def pause(self) -> None:
        self._move("pause", "paused")

    def complete(self, upto: int | None = None) -> bool:
        """Finish; with `upto`, take in what has come since and finish only if every region has resolved that far.

        Otherwise the task stays cutting over, and this is called again once more of the log is there.
        """
        self._move("complete", "cutting_over")
        if upto is not None:
            self._take_in()
            least = frontier(resolved_so_far(self.spark, self.target)).first()["resolved_ts"]
            if least is None or least < upto:
                return False
        self.state = "completed"
        return True

    def activate(self, upto: int | None = None) -> DataFrame:
        """The replica's table at the cut-over."""
        self._move("activate", "activated")
        return replica(self.spark.read.parquet(f"{self.target}/changes").drop("batch").dropDuplicates(["key", "commit_ts"]), upto)

    def control(self, action: str, **arguments) -> dict:
        """One call for each action of a control surface, answered by the status after it."""
        if action not in self.ACTIONS:
            raise ValueError(f"unknown action {action!r}; known are {', '.join(self.ACTIONS)}")
        getattr(self, action)(**arguments)
        return self.status()

    def status(self) -> dict:
        return {"state": self.state, "source": self.source, "target": self.target}
