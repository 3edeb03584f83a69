"""Two-phase commits over a change log: what a command finds in it, and the rows that it appends.

Logs have the columns of `changes.LOG`.  Commands change nothing in place: each returns rows for the
caller to append, so a command that is run again after a failure returns the same rows, and readers
drop what was delivered twice.  An edit with a null value deletes its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import commits, open_locks

_NAMES = ["region_id", "key", "op", "start_ts", "commit_ts", "value"]


def status(log: DataFrame) -> DataFrame:
    """(key, start_ts, region_id, status, commit_ts) of each transaction's keys: locked, committed or rolled_back."""
    end = F.when(F.col("op") != "PREWRITE", F.col("op"))
    by = log.groupBy("key", "start_ts").agg(F.max("region_id").alias("region_id"), F.max(end).alias("end"), F.max("commit_ts").alias("commit_ts"))
    return by.select("key", "start_ts", "region_id", F.when(F.col("end").isNull(), "locked").when(F.col("end") == "ROLLBACK", "rolled_back").otherwise("committed").alias("status"), "commit_ts")


def history(log: DataFrame, key: object = None, start_ts: int | None = None) -> DataFrame:
    """All rows of a key, or of a transaction, or of both."""
    own = log if key is None else log.where(F.col("key") == F.lit(key))
    return own if start_ts is None else own.where(F.col("start_ts") == start_ts)


def conflicts(log: DataFrame, edits: DataFrame, start_ts: int) -> DataFrame:
    """(key, reason, other_ts): edited keys that another transaction holds (locked), that were committed
    after `start_ts` (newer), or that this transaction has rolled back already (rolled_back)."""
    own = status(log.join(edits.select("key").distinct(), "key", "left_semi"))
    mine = F.col("start_ts") == start_ts
    reason = F.when((F.col("status") == "locked") & ~mine, "locked").when((F.col("status") == "committed") & (F.col("commit_ts") > start_ts), "newer").when((F.col("status") == "rolled_back") & mine, "rolled_back")
    return own.select("key", reason.alias("reason"), F.coalesce("commit_ts", "start_ts").alias("other_ts")).where("reason is not null")


def prewrite(log: DataFrame, edits: DataFrame, start_ts: int) -> DataFrame:
    """Locks for the edits (region_id, key, value), or no rows at all if any of them has a conflict."""
    refused = conflicts(log, edits, start_ts).limit(1).select(F.lit(1).alias("__refused"))
    free = edits.join(F.broadcast(refused), F.lit(True), "left_anti")  # one row at most
    return free.select("region_id", "key", F.lit("PREWRITE").alias("op"), F.lit(start_ts).cast("long").alias("start_ts"), F.lit(None).cast("long").alias("commit_ts"), "value")


def _ended(locks: DataFrame, commit_ts: Column) -> DataFrame:
    """Rows that commit the locks at `commit_ts`, or roll them back where that is null."""
    op = F.when(commit_ts.isNull(), "ROLLBACK").when(F.col("value").isNull(), "COMMIT_DELETE").otherwise("COMMIT_PUT")
    return locks.select("region_id", "key", op.alias("op"), "start_ts", commit_ts.cast("long").alias("commit_ts"), F.when(commit_ts.isNotNull(), F.col("value")).alias("value"))


def commit(log: DataFrame, start_ts: int, commit_ts: int) -> DataFrame:
    """Commits of all that the transaction has locked; what it has rolled back stays so."""
    if commit_ts <= start_ts:
        raise ValueError(f"commit_ts {commit_ts} must be after start_ts {start_ts}")
    return _ended(open_locks(history(log, start_ts=start_ts)), F.lit(commit_ts))


def rollback(log: DataFrame, start_ts: int, keys: DataFrame | None = None) -> DataFrame:
    """Rollbacks of what the transaction has locked (of `keys` only, if given)."""
    own = open_locks(history(log, start_ts=start_ts))
    return _ended(own if keys is None else own.join(keys.select("key"), "key", "left_semi"), F.lit(None).cast("long"))


def resolve(log: DataFrame, upto: int) -> DataFrame:
    """Ends of the locks begun at `upto` at the latest: a transaction with any committed key commits its
    others at the same time, any other is rolled back."""
    decided = log.where("op in ('COMMIT_PUT', 'COMMIT_DELETE')").groupBy("start_ts").agg(F.max("commit_ts").alias("__at"))
    return _ended(open_locks(log, upto).join(decided, "start_ts", "left"), F.col("__at"))


def flashback(log: DataFrame, to_ts: int, start_ts: int, commit_ts: int) -> DataFrame:
    """Rows of one transaction that brings every key back to what it was at `to_ts`; locks are to be resolved before.

    Keys whose value is the same then and now aren't written.
    """
    if not to_ts < start_ts < commit_ts:
        raise ValueError("to_ts, start_ts and commit_ts must ascend")
    entry = F.struct("op", "value")
    by = commits(log).groupBy("key").agg(F.max("region_id").alias("region_id"), F.max_by(entry, "commit_ts").alias("now"), F.max_by(entry, F.when(F.col("commit_ts") <= to_ts, F.col("commit_ts"))).alias("then"))
    seen = lambda c: F.when(F.col(f"{c}.op") == "put", F.struct(f"{c}.value"))
    changed = by.where(~seen("now").eqNullSafe(seen("then"))).select("region_id", "key", F.lit(start_ts).cast("long").alias("start_ts"), F.when(F.col("then.op") == "put", F.col("then.value")).alias("value"))
    locks = changed.select("region_id", "key", F.lit("PREWRITE").alias("op"), "start_ts", F.lit(None).cast("long").alias("commit_ts"), "value")
    return locks.unionByName(_ended(changed, F.lit(commit_ts))).select(*_NAMES)
