"""Two-phase commits over a log, responses as bytes, plugins, and a task's cut-over."""

import pytest

from basaltine.plans import encode, plugins, request
from basaltine.plans.expressions import library
from basaltine.streaming import changes, transactions as T


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, 1, "PREWRITE", 10, None, "a"), (1, 1, "COMMIT_PUT", 10, 12, None),
        (1, 2, "PREWRITE", 10, None, "b"),  # the second key of a committed transaction
        (1, 3, "PREWRITE", 20, None, "c"), (1, 3, "ROLLBACK", 20, None, None),
        (2, 4, "PREWRITE", 30, None, None), (2, 5, "PREWRITE", 30, None, "e"),
    ]
    return spark.createDataFrame(rows, changes.LOG)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edits(spark, *pairs):
    return spark.createDataFrame([(1, k, v) for k, v in pairs], "region_id long, key long, value string")


def test_status_and_conflicts(spark, log):
    got = {(r["key"], r["start_ts"]): (r["status"], r["commit_ts"]) for r in T.status(log).collect()}
    assert got == {(1, 10): ("committed", 12), (2, 10): ("locked", None), (3, 20): ("rolled_back", None), (4, 30): ("locked", None), (5, 30): ("locked", None)}
    every = edits(spark, (1, "x"), (2, "x"), (3, "x"), (6, "x"))
    assert rows(T.conflicts(log, every, 11)) == [(1, "newer", 12), (2, "locked", 10)]
    assert rows(T.conflicts(log, every, 20)) == [(2, "locked", 10), (3, "rolled_back", 20)]
    assert T.history(log, key=1).count() == 2 and T.history(log, start_ts=30).count() == 2


def test_prewrite_commits_all_or_nothing(spark, log):
    assert T.prewrite(log, edits(spark, (6, "x"), (2, "x")), 40).count() == 0
    locks = T.prewrite(log, edits(spark, (6, "x"), (1, None)), 40)
    assert rows(locks) == [(1, 1, "PREWRITE", 40, None, None), (1, 6, "PREWRITE", 40, None, "x")]
    after = log.unionByName(locks)
    done = T.commit(after, 40, 41)
    assert rows(done) == [(1, 1, "COMMIT_DELETE", 40, 41, None), (1, 6, "COMMIT_PUT", 40, 41, "x")]
    assert rows(changes.replica(changes.commits(after.unionByName(done)))) == [(6, "x")]
    assert T.commit(after.unionByName(done), 40, 41).count() == 0
    with pytest.raises(ValueError):
        T.commit(log, 40, 40)


def test_rollback_and_resolve(spark, log):
    assert rows(T.rollback(log, 30)) == [(2, 4, "ROLLBACK", 30, None, None), (2, 5, "ROLLBACK", 30, None, None)]
    assert rows(T.rollback(log, 30, edits(spark, (5, None)))) == [(2, 5, "ROLLBACK", 30, None, None)]
    assert rows(T.resolve(log, 29)) == [(1, 2, "COMMIT_PUT", 10, 12, "b")]
    ended = log.unionByName(T.resolve(log, 30))
    assert changes.open_locks(ended).count() == 0
    assert rows(changes.replica(changes.commits(ended))) == [(1, "a"), (2, "b")]


def test_flashback(spark, log):
    now = log.unionByName(T.resolve(log, 30))
    later = now.unionByName(locks := T.prewrite(now, edits(spark, (1, None), (7, "n"), (2, "b")), 50)).unionByName(T.commit(now.unionByName(locks), 50, 51))
    assert rows(changes.replica(changes.commits(later))) == [(2, "b"), (7, "n")]
    back = T.flashback(later, 12, 60, 61)
    assert {r["key"] for r in back.collect()} == {1, 7}
    assert rows(changes.replica(changes.commits(later.unionByName(back)))) == [(1, "a"), (2, "b")]
    assert rows(changes.replica(changes.commits(later.unionByName(T.flashback(later, 0, 60, 61))))) == []
    with pytest.raises(ValueError):
        T.flashback(log, 60, 50, 61)


def test_responses(spark, log):
    held = encode.chunks(log.coalesce(1), 3)
    assert [r["rows"] for r in held.collect()] == [3, 3, 1]
    assert rows(encode.unchunked(held, log.schema)) == rows(log)
    assert rows(encode.unlined(encode.lines(log), log.schema)) == rows(log)
    assert encode.chunks(log.limit(0)).count() == 0


def test_plugins(spark):
    plugins.function("thrice")(lambda c: c * 3)
    assert "thrice" in library()
    plugins.remove("thrice")
    assert "thrice" not in library()
    with pytest.raises(KeyError):
        plugins.remove("thrice")
    with pytest.raises(ValueError):
        plugins.call(spark.range(1), "none")
    with pytest.raises(ValueError):
        request.check({"executors": [{"type": "plugin", "name": "above"}]})
    plugins.load("json")


def test_cut_over_waits_for_the_log(spark, log, tmp_path):
    source = str(tmp_path / "log")
    log.coalesce(1).write.parquet(source)
    task = changes.Replication(spark, source, str(tmp_path / "target"), str(tmp_path / "checkpoint"))
    assert task.control("start")["state"] == "subscribing"
    assert not task.complete(30) and task.state == "cutting_over"
    T.resolve(log, 30).coalesce(1).write.mode("append").parquet(source)
    assert task.control("complete", upto=20)["state"] == "completed"
    assert rows(task.activate()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        task.control("stop")
    with pytest.raises(ValueError):
        changes.read_log(spark, source, 1, 1)
