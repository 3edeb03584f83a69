"""Quality: histogram gradient-boosted trees over statistics of the text alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .sampling import SAMPLE_ROWS, labelled_sample
from .text import bounded_batches, Words, buffer_of, char_counts, distinct_counts, held_out, id_and_text, over_slices, shingle_hashes, slices, span_hashes, texts_of

#: Classes of bytes that are counted; every other byte is in the first class.
CLASSES = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "|", "!?", ";:", "'\"`", "()", "[]{}", "<>", "#", "*", "%", "@", "&", "/\\", "=+", "-_", "$^~"]
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(CLASSES):
    for _b in _c.encode():
        _CLASS[_b] = _i
_CLASS[128:192] = len(CLASSES)  # continuation bytes
_CLASS[192:] = len(CLASSES) + 1
_K = len(CLASSES) + 2

FEATURES = (
    [f"share_{i}" for i in range(_K)]
    + ["log_chars", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_next"]
    + ["distinct_triples", "top_triple", "log_lines", "line_length", "distinct_lines", "top_line", "top_byte", "byte_entropy", "words_per_sentence"]
)


def _per_doc(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items of each document and how often its commonest occurs."""
    keys, count = distinct_counts(doc.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    own = (keys >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    if len(own):
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        top[own[first]] = np.maximum.reduceat(count, first)
    return np.bincount(own, minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text gives zeros."""
    raw, offsets = buffer_of(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    chars = np.maximum(char_counts(raw, offsets), 1)
    per_class = np.bincount(doc * _K + _CLASS[raw], minlength=n * _K).reshape(n, _K)
    col = _K
    out[:, :col] = per_class / np.maximum(size, 1)[:, None]

    def put(values: np.ndarray) -> None:
        nonlocal col
        out[:, col] = values
        col += 1

    words = Words(texts)
    count = words.counts()
    some = np.maximum(count, 1)
    lengths = words.end - words.start
    hashes = words.hashes()
    put(np.log1p(chars * (size > 0)))
    put(np.log1p(count))
    put(np.bincount(words.doc, lengths, n) / some)
    put(np.bincount(words.doc, lengths > 12, n) / some)
    put(np.bincount(words.doc, lengths < 3, n) / some)
    kinds, top = _per_doc(words.doc, hashes, n)
    put(kinds / some)
    put(top / some)
    same = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    put(np.bincount(words.doc[1:][same], minlength=n) / some)
    triple, own, _ = shingle_hashes(hashes, words.doc, 3)
    triples = np.maximum(np.bincount(own, minlength=n), 1)
    kinds, top = _per_doc(own, triple, n)
    put(kinds / triples)
    put(top / triples)
    ends = np.union1d(np.flatnonzero(raw == 10), offsets[1:][size > 0])
    starts = np.concatenate([[0], ends[:-1] + (raw[np.minimum(ends[:-1], len(raw) - 1)] == 10)])
    full = ends > starts
    starts, ends = starts[full], ends[full]
    own = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.maximum(np.bincount(own, minlength=n), 1)
    put(np.log1p(lines))
    put(np.log1p(size / lines))
    kinds, top = _per_doc(own, span_hashes(raw, starts, ends), n)
    put(kinds / lines)
    put(top / lines)
    byte = np.empty((n, 2))
    for lo in range(0, n, 2048):  # 256 counters for each text, for bounded numbers of texts
        hi = min(n, lo + 2048)
        part = slice(offsets[lo], offsets[hi])
        p = np.bincount((doc[part] - lo) * 256 + raw[part], minlength=(hi - lo) * 256).reshape(-1, 256) / np.maximum(size[lo:hi], 1)[:, None]
        byte[lo:hi, 0] = p.max(axis=1)
        byte[lo:hi, 1] = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1)
    put(byte[:, 0])
    put(byte[:, 1])
    put(count / (1 + per_class[:, 7] + per_class[:, 10]))
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", held_out_mod: int | None = 4, rows: int = SAMPLE_ROWS, trees: int = 80, depth: int = 4) -> boosting.Forest:
    """Fit on at most `rows` labelled documents (a documented bound); statistics are taken where the texts lie."""
    sample = labelled_sample(docs, labels, target, held_out_mod, rows)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(texts_of(part))
        return pa.RecordBatch.from_arrays([part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["y", "x"])

    got = sample.mapInArrow(over_slices(run), "y int, x array<double>").toArrow()
    y = got["y"].to_numpy().astype(float)
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES))
    return boosting.fit(x, y, trees, depth)


def score(docs: DataFrame, model: boosting.Forest, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row; null and empty texts have statistics of zero."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.probability(features(texts_of(part)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: boosting.Forest, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score at least the threshold, with the input's own columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.probability(features(texts_of(part))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document scored; labels are learned outside the held-out quarter."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")
