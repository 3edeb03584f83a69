"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are folded (see `text.fold`) and read as code points; a feature is the presence of an
n-gram, hashed to one of 2**20 buckets.  Its value is the bucket's log-count ratio between toxic
and other documents of the sample, and an L2-regularised logistic regression weighs the values.
Buckets whose ratio is within the noise carry no weight, so scoring looks up each n-gram in one
array of fixed size (4 MB), which is what workers get.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import SAMPLE_ROWS, labelled_sample
from .text import bounded_batches, buffer_of, char_counts, distinct, fold, held_out, id_and_text, over_slices, slices, texts_of

BITS = 20
ORDERS = (3, 4, 5)
#: Entries (a text's chosen n-grams, 4 bytes each) that the regression sees at most.
MOST_ENTRIES = 24_000_000


def features(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, bucket) pairs of a slice, sorted; with `keep`, of the buckets that it marks."""
    raw, offsets = buffer_of(texts)
    folded = fold(raw)
    chars = np.frombuffer(folded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(char_counts(folded, offsets))
    if len(chars) != (ends[-1] if len(ends) else 0):  # bytes that aren't UTF-8: one text at a time
        each = [np.frombuffer(folded[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        chars, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
    found = []
    wide = chars.astype(np.uint64)
    own = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, np.diff(np.append(0, ends)))
    steps = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    for n in ORDERS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h, t = np.full(m, n, np.uint64), np.empty(m, np.uint64)
        for j in range(n):
            h += np.multiply(wide[j : j + m], steps[j], out=t)
        h ^= np.right_shift(h, np.uint64(29), out=t)
        h *= steps[0]
        h >>= np.uint64(64 - BITS)
        bucket = h.view(np.int64)
        whole = np.ones(m, bool) if keep is None else keep[bucket]
        for j in range(1, n):  # n-grams that run over the end of a text
            cut = ends - j
            whole[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(whole)
        found.append(own[at] | bucket[at])
    pairs = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray  # float32 for each bucket: log-count ratio times coefficient
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = features(texts, self.weight != 0)
        margin = np.bincount(doc, self.weight[bucket], minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def _counts(sample: DataFrame) -> DataFrame:
    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, bucket = features(texts_of(part))
        y = np.asarray(part.column("y"))[doc]
        n, pos = np.bincount(bucket, minlength=1 << BITS), np.bincount(bucket, y, minlength=1 << BITS)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at].astype(np.int64)), pa.array(n[at].astype(np.int64))], ["bucket", "pos", "n"])

    return sample.mapInArrow(over_slices(count), "bucket int, pos long, n long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", held_out_mod: int | None = 4, rows: int = SAMPLE_ROWS, most_features: int = 20_000, l2: float = 0.02, rounds: int = 150, most_entries: int = MOST_ENTRIES) -> Model:
    """Fit on a bounded sample of labelled rows.

    `rows` and `most_features` bound the sample and the buckets that the regression sees, and
    `most_entries` the entries that the driver holds: if the sample has more, the rows of least hashed
    id that have no more make the regression's sample.  With no labelled rows, or one class only, the
    model gives a constant score.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, target, held_out_mod, rows).persist()
    try:
        classes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        pos, neg = classes.get(1, 0), classes.get(0, 0)
        weight = np.zeros(1 << BITS, np.float32)
        if not pos or not neg:
            return Model(weight, float(np.log((pos + 0.5) / (neg + 0.5))))
        table = _counts(sample).where("n >= 4").toPandas()
        p, n = table["pos"].to_numpy(float), table["n"].to_numpy(float)
        q = n - p
        ratio = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
        sure = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))  # in standard errors
        top = np.argsort(-sure, kind="stable")[:most_features]
        top = top[sure[top] > 2.0]
        chosen, scale = table["bucket"].to_numpy(np.int64)[top], ratio[top]
        index = np.full(1 << BITS, -1, np.int32)
        index[chosen] = np.arange(len(chosen))
        shared = spark.sparkContext.broadcast(index)

        def sparse(part: pa.RecordBatch) -> pa.RecordBatch:
            doc, bucket = features(texts_of(part), shared.value >= 0)
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shared.value[bucket]))], ["doc_id", "y", "cols"])

        entries = sample.mapInArrow(over_slices(sparse), "doc_id long, y int, cols array<int>").withColumn("h", F.xxhash64("doc_id")).persist()
        if entries.agg(F.sum(F.size("cols"))).first()[0] > most_entries:
            size = entries.select("h", F.size("cols").alias("n")).orderBy("h").toArrow()  # a row for each of at most `rows`
            fits = np.cumsum(size["n"].to_numpy().astype(np.int64)) <= most_entries
            entries_kept = entries.where(F.col("h") <= int(size["h"].to_numpy()[fits][-1])) if fits.any() else entries.limit(0)
        else:
            entries_kept = entries
        got = entries_kept.select("y", "cols").toArrow()
        entries.unpersist()
    finally:
        sample.unpersist()
    y = got["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(weight, float(np.log((pos + 0.5) / (neg + 0.5))))
    beta, bias = _logistic(got["cols"].chunks, scale, y, len(chosen), l2, rounds)
    weight[chosen] = (beta * scale).astype(np.float32)
    weight[np.abs(weight) < 1e-3] = 0
    return Model(weight, bias)


def _logistic(chunks: list[pa.ListArray], scale: np.ndarray, y: np.ndarray, m: int, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean log loss plus an L2 term; `chunks` list each document's columns.

    The entries stay as the Arrow buffers they came in, and are widened one piece at a time.
    """
    pieces, at = [], 0
    for chunk in chunks:
        for lo in range(0, len(chunk), 512):
            part = chunk.slice(lo, 512)
            pieces.append((slice(at, at + len(part)), np.diff(part.offsets.to_numpy()), part.flatten().to_numpy()))
            at += len(part)
    beta, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        own, g = (beta * scale), np.zeros(m + 1)
        for docs, size, col in pieces:
            row = np.repeat(np.arange(len(size)), size)
            z = np.bincount(row, own[col], minlength=len(size)) + bias
            e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[docs]
            g[:m] += np.bincount(col, e[row], minlength=m)
            g[m] += e.sum()
        g[:m] = g[:m] * scale + 10 * l2 * beta
        g /= len(y)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.05 * (1 - t / (rounds + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        beta, bias = beta - step[:m], bias - step[m]
    return beta, float(bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row; a null or empty text gets the score of a text without features.

    Rows that repeat an id or a text are each scored; equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(texts_of(part))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, with the input's own columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(texts_of(part)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document scored; labels are learned outside the held-out quarter."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")
