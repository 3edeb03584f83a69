"""The corpus pipeline: every stage takes effect, clean documents stay, odd rows are handled."""

import random
from collections import Counter

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("w%d" % r.randrange(4000) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [words(r, 30) for _ in range(4)]
    rows = [(i, words(r, 80)) for i in range(120)]
    toxic = [(200 + i, words(r, 40) + " horridword nastyterm " + words(r, 30)) for i in range(60)]
    copies = [(300 + i, rows[i][1]) for i in range(10)]
    leaks = [(400 + i, words(r, 30) + " " + items[i] + " " + words(r, 30)) for i in range(4)]
    odd = [(500, None), (501, ""), (None, words(r, 40)), (502, words(r, 20) + " write to ann.lee@example.com now")]
    every = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows + toxic + copies + leaks + odd]
    spark.createDataFrame(every, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, tables)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        docs = docs.checkpoint()
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    clean = Counter(range(120)) + Counter([500, None, 502])
    assert kept["toxicity"] == clean + Counter([501]) + Counter(range(300, 310)) + Counter(range(400, 404))
    assert kept["near_dedup"] == clean + Counter(range(400, 404))  # 500 and 501 are equal: empty
    assert kept["decontamination"] == kept["pii"] == kept["pieces"] == clean
    assert all(r["round_trip"] for r in docs.collect())


def test_redaction_takes_effect(spark, tables):
    out = corpus_pipeline.pii_stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).where("doc_id = 502").first()
    assert out["text"].endswith("write to [EMAIL] now") and out["n_chars"] == len(out["text"])


def test_run_on_nothing(spark, tables, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
