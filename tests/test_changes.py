"""Requests, multi-version tables and the change stream."""

import pytest
from pyspark.sql import functions as F

from basaltine.operators import relational as R
from basaltine.operators import statistics as ST
from basaltine.plans import request
from basaltine.sources import versions
from basaltine.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def log(spark):
    data = [
        (1, 10, "PREWRITE", 1, None, "a"), (1, 10, "COMMIT_PUT", 1, 2, None), (1, 10, "COMMIT_PUT", 1, 2, None),
        (1, 10, "PREWRITE", 3, None, "b"), (1, 10, "ROLLBACK", 3, None, None), (1, 11, "PREWRITE", 4, None, "c"),
        (2, 20, "PREWRITE", 5, None, "d"), (2, 20, "COMMIT_PUT", 5, 6, None), (2, 20, "PREWRITE", 7, None, None), (2, 20, "COMMIT_DELETE", 7, 8, None),
    ]
    return spark.createDataFrame(data, changes.LOG)


def test_commits_and_watermark(log):
    assert rows(changes.commits(log).select("key", "op", "commit_ts", "value")) == [(10, "put", 2, "a"), (20, "delete", 8, None), (20, "put", 6, "d")]
    assert rows(changes.resolved_ts(log)) == [(1, 3), (2, 8)]  # the open transaction of key 11 holds region 1 back
    assert changes.frontier(changes.resolved_ts(log)).first()[0] == 3
    assert rows(changes.replica(changes.commits(log))) == [(10, "a")]


def test_stream_resumes(spark, log, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("log", "out", "cp"))
    log.where("region_id = 1").coalesce(1).write.parquet(source)
    task = changes.Replication(spark, source, target, checkpoint)
    with pytest.raises(ValueError):
        task.pause()
    task.start()
    task.pause()
    log.where("region_id = 2").coalesce(1).write.mode("append").parquet(source)
    task.start()
    task.complete()
    assert rows(task.activate()) == [(10, "a")]
    assert task.status()["state"] == "activated"


def test_versions(spark):
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 5, "delete", None), (1, 9, "put", "b"), (2, 2, "put", "c")], "key long, commit_ts long, op string, value string")
    assert rows(versions.as_of(log, 4)) == [(1, "a"), (2, "c")]
    assert rows(versions.as_of(log, 6)) == [(2, "c")]
    assert rows(versions.batch_get(log, [1], 9)) == [(1, "b")]
    assert rows(versions.garbage(log, 6).select("key", "commit_ts")) == [(1, 1)]
    assert [r["old_value"] for r in versions.with_old_value(log).where("key = 1").orderBy("commit_ts").collect()] == [None, "a", None]


def test_raw_table(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, value string")
    assert rows(versions.put(t, spark.createDataFrame([(2, "x")], t.schema))) == [(1, "a"), (2, "x"), (3, "c")]
    assert rows(versions.delete_range(t, 2, 3)) == [(1, "a"), (3, "c")]
    assert rows(versions.compare_and_swap(t, 1, "a", "z"))[0] == (1, "z")
    assert rows(versions.compare_and_swap(t, 1, "q", "z"))[0] == (1, "a")


def test_requests_are_checked(spark):
    for bad in ({"executors": []}, {"executors": [{"type": "join"}]}, {"executors": [{"type": "limit"}]}, {"executors": [{"type": "table_scan"}, {"type": "what"}]}):
        with pytest.raises(ValueError):
            request.check(bad)


def test_operators_on_nothing(spark):
    empty = spark.createDataFrame([], "k long, v long")
    assert R.top_n(empty, [("v", True)], 5).count() == 0
    assert R.table_scan(spark.range(3), ["id"], "id", []).count() == 0
    assert R.hash_aggregation(empty, ["k"], [F.count("*")]).count() == 0
    assert ST.checksum(empty, ["k"]).first()["total_rows"] == 0


def test_nulls_order_lowest(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v long")
    assert [r[0] for r in R.top_n(df, [("v", False)], 2).collect()] == [None, 1]
    assert [r[0] for r in R.top_n(df, [("v", True)], 3).collect()] == [2, 1, None]


def test_sketches_estimate(spark):
    df = spark.range(5000).selectExpr("id % 700 as v")
    assert ST.estimate(ST.frequency_sketch(df, "v"), F.lit(3).cast("long")).first()["n"] >= 7
    assert abs(ST.distinct_sketch(df, "v").first()["distinct"] - 700) < 200
    assert ST.histogram(df, "v", 10).agg({"rows": "sum"}).first()[0] == 5000


def test_crc64_and_order_independence(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    assert ST.checksum64(df, "k", "v").collect() == ST.checksum64(df.orderBy(F.desc("k")), "k", "v").collect()
    got = spark.range(1).select(ST.crc64(F.lit("123456789"))).first()[0]
    assert got % (1 << 64) == 0x995DC9BBDF1939FA  # the polynomial's published check value


def test_expression_trees(spark):
    from basaltine.plans.expressions import build, library

    assert len(library()) > 200
    row = spark.range(1).select(build({"call": "json_extract", "args": [{"value": '{"a": 5}'}, {"value": "$.a"}], "as": "x"}), build({"call": "lpad", "args": [{"value": "7"}, {"value": 3}, {"value": "0"}]}), build("id + 1")).first()
    assert tuple(row) == ("5", "007", 1)
    for bad in (3, {"call": "no_such"}, {}):
        with pytest.raises(ValueError):
            build(bad)


def test_stream_state_is_bounded_and_waits_for_late_prewrites(spark, tmp_path):
    """Commits before their prewrites, rollbacks, over many batches; the resolved ts never falls."""
    source, target = str(tmp_path / "log"), str(tmp_path / "replica")
    batches = [
        [(1, 10, "PREWRITE", 100, None, "a"), (1, 11, "COMMIT_PUT", 101, 105, None)],
        [(1, 10, "COMMIT_PUT", 100, 110, None), (1, 12, "PREWRITE", 50, None, "late")],
        [(1, 11, "PREWRITE", 101, None, "b"), (1, 12, "ROLLBACK", 50, None, None)],
        [(1, 13, "COMMIT_PUT", 120, 125, "own"), (1, 10, "PREWRITE", 130, None, "c")],
        [(1, 13, "PREWRITE", 120, None, "own"), (1, 10, "COMMIT_DELETE", 130, 140, None)],
    ]
    progress, open_ = [], []
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, changes.LOG).coalesce(1).write.mode("append").parquet(source)
        changes.replicate(changes.read_log(spark, source), target, str(tmp_path / "checkpoint")).awaitTermination()
        progress.append(changes.resolved_so_far(spark, target).first()["resolved_ts"])
        open_.append(spark.read.parquet(f"{target}/state/batch={i}").count())
    got = sorted(tuple(r) for r in spark.read.parquet(f"{target}/changes").select("key", "op", "commit_ts", "value").collect())
    assert got == [(10, "delete", 140, "c"), (10, "put", 110, "a"), (11, "put", 105, "b"), (13, "put", 125, "own")]
    assert progress == sorted(progress) and progress[0] == 99 and progress[-1] == 140
    assert open_ == [2, 2, 0, 2, 0] and not (tmp_path / "replica" / "state" / "batch=2").exists()


def test_joins_on_odd_input(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None), (3, 30.0), (4, 10.0)], "k long, v double")
    b = spark.createDataFrame([("x", 0.0, 10.0), ("y", 5.0, 31.0), ("none", 7.0, 7.0), ("null", None, 9.0)], "name string, low double, high double")
    got = sorted((r["k"], r["name"]) for r in R.range_join(a, b, "v", "low", "high", 10.0).collect())
    assert got == [(1, "x"), (1, "y"), (3, "y"), (4, "y")]
    assert R.range_join(a.limit(0), b, "v", "low", "high", 10.0).count() == 0
    e = spark.createDataFrame([(1, 5.0, "first"), (1, 5.5, "later"), (3, None, "never")], "ek long, at double, what string")
    found = R.as_of_join(a, e, "k", "ek", "v", "at", ["what"]).collect()
    assert sorted((r["k"], r["what"]) for r in found) == [(1, "first"), (2, None), (3, "never"), (4, None)]


def test_analyze_dispatches(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as v")
    assert ST.analyze(df, "index", ["v"], buckets=3).agg(F.sum("rows")).first()[0] == 100
    assert ST.analyze(df, "full_sampling", ["v"]).first()["distinct"] == 7
    assert ST.analyze(df, "sample", ["v"], n=4, key="id").first()["rows"] == 100
    with pytest.raises(ValueError):
        ST.analyze(df, "what", ["v"])
