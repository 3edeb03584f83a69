"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Seeds are the runs of four folded words of the test items (all words of a shorter item).  Every
seed is looked up in every document, however common it is: of an edited copy that is itself common,
only common seeds are left.  Around the hits a window of the document is aligned with the item, word
by word (match 1, mismatch -0.5, gap -0.5), and the best local alignment over the item's length is
the score: 1 for a copy, less for an edited one.  A window that holds too few of the item's words
for any alignment to reach the threshold isn't aligned, which loses nothing.

Test items of equal words are one for the search and are named again at the end.  Items are handled
in blocks of bounded size; a block's seeds and words are what workers get, so a corpus is never
shuffled, and is read once for each 8 MB of different items (a test set is mostly one block).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import without
from .text import Words, distinct, id_and_text, mix, over_slices, shingle_hashes

SEED_WORDS = 4
THRESHOLD = 0.5
#: Bytes of test items in a block.
BLOCK_BYTES = 8 << 20
#: Hits, and words of windows, that are handled at once.
MOST_HITS, MOST_WORDS = 1_000_000, 2_000_000
MISMATCH, GAP = 0.5, 0.5
_BITS = 20


@dataclass
class Items:
    ids: list[list[int | None]]  # of each item: who has these words
    words: np.ndarray  # hashes of all items' words
    offsets: np.ndarray
    seeds: np.ndarray  # sorted distinct seed hashes
    seed: np.ndarray  # for each occurrence: which seed, sorted
    item: np.ndarray  # which item
    place: np.ndarray  # position in the item
    sizes: tuple[int, ...]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, index of the seed) of the hashes that are seeds."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = np.zeros(1 << _BITS, bool)
        marks[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        at = np.flatnonzero(marks[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        good = self.seeds[pos] == hashes[at]
        return at[good], pos[good]


def _runs(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, d, at = shingle_hashes(hashes, doc, n)
    return h ^ np.uint64(n), d, at


def items_of(ids: list[int | None], texts: list[str]) -> Items:
    every = Words(pa.array(texts, pa.string()))
    edge = np.searchsorted(every.doc, np.arange(len(texts) + 1))
    held: dict[bytes, list[int | None]] = {}
    first: list[str] = []
    for i, (x, t) in enumerate(zip(ids, texts, strict=True)):
        own = b" ".join(every.raw[s:e].tobytes() for s, e in zip(every.start[edge[i] : edge[i + 1]], every.end[edge[i] : edge[i + 1]], strict=True))
        if own not in held:
            first.append(t)
        held.setdefault(own, []).append(x)
    ids = [sorted(set(x), key=lambda i: (i is None, i)) for x in held.values()]
    words = Words(pa.array(first, pa.string()))
    hashes, count = words.hashes(), words.counts()
    offsets = np.append(0, np.cumsum(count))
    found = []
    sizes = sorted({min(SEED_WORDS, int(c)) for c in count if c})
    for n in sizes:
        h, d, at = _runs(hashes, words.doc, n)
        own = count[d] >= SEED_WORDS if n == SEED_WORDS else count[d] == n
        found.append((h[own], d[own], at[own] - offsets[d[own]]))
    h, item, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    seeds = distinct(h)
    seed = np.searchsorted(seeds, h)
    order = np.argsort(seed, kind="stable")
    return Items(ids, hashes, offsets, seeds, seed[order], item[order], place[order], tuple(sizes))


def align(items: Items, item: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and last word of the best local alignment of each item with its window words[start:end]."""
    score, last = np.zeros(len(item)), np.zeros(len(item), np.int64)
    length = items.offsets[item + 1] - items.offsets[item]
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1  # pairs of like lengths share one padded array of bounded size
        width = int((end - start)[order[lo]])
        while hi < len(order) and length[order[hi]] <= length[order[lo]] * 1.25 + 4:
            width = max(width, int((end - start)[order[hi]]))
            if (hi - lo + 1) * width > 400_000:
                break
            hi += 1
        own = order[lo:hi]
        width = int((end - start)[own].max())
        col = np.arange(width)
        there = col < (end - start)[own][:, None]
        window = words[np.minimum(start[own][:, None] + col, len(words) - 1)]
        h = np.zeros((len(own), width + 1), np.float32)
        best, at = np.zeros(len(own), np.float32), np.zeros(len(own), np.int64)
        slope = (GAP * np.arange(width + 1)).astype(np.float32)
        for i in range(int(length[own].max())):
            live = i < length[own]
            word = items.words[np.minimum(items.offsets[item[own]] + i, len(items.words) - 1)]
            match = (window == word[:, None]) & there & live[:, None]
            t = np.zeros_like(h)
            t[:, 1:] = h[:, :-1] + np.where(match, np.float32(1), np.float32(-MISMATCH))
            np.maximum(t, h - np.float32(GAP), out=t)
            np.maximum(t, 0, out=t)
            t = np.maximum.accumulate(t + slope, axis=1) - slope  # gaps in the window, as a running maximum
            h = np.where(live[:, None], t, h)
            top = h.argmax(axis=1)
            value = h[np.arange(len(own)), top]
            better = value > best
            best, at = np.where(better, value, best), np.where(better, top, at)
        score[own], last[own] = best / length[own], start[own] + at - 1
        lo = hi
    return score, last


def _share_held(items: Items, item: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Share of each item's words that its window words[start:end] holds anywhere: no alignment scores more."""
    out = np.zeros(len(item))
    length, size = (items.offsets[1:] - items.offsets[:-1])[item], end - start
    edge = np.append(0, np.cumsum(length + size))
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + MOST_WORDS, side="right")) - 1)

        def named(every: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(pair)) + np.repeat(first - np.append(0, np.cumsum(n))[:-1], n)
            return pair, mix(every[at] ^ mix(pair.astype(np.uint64) + np.uint64(1)))

        pair, wanted = named(items.words, items.offsets[item[lo:hi]], length[lo:hi])
        held = np.sort(named(words, start[lo:hi], size[lo:hi])[1])
        found = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
        out[lo:hi] = np.bincount(pair[found], minlength=hi - lo) / length[lo:hi]
        lo = hi
    return out


def _windows(items: Items, hits: list[tuple[np.ndarray, ...]], edge: np.ndarray, hashes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(doc, item, score, last word) of the windows around the hits (doc, position, seed) whose score can reach the threshold."""
    parts = []
    for doc, at, seed in hits:
        lo, hi = np.searchsorted(items.seed, seed), np.searchsorted(items.seed, seed, side="right")
        k = hi - lo
        occ = np.repeat(lo - np.append(0, np.cumsum(k))[:-1], k) + np.arange(k.sum())
        parts.append((np.repeat(doc, k), items.item[occ], np.repeat(at, k) - items.place[occ]))
    doc, item, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1]))
    doc, item, begin = doc[new], item[new], begin[new]
    length = (items.offsets[1:] - items.offsets[:-1])[item]
    # hits of an item that begin within its length share one window, which reaches as far as that of its last hit
    keep, held = np.zeros(len(doc), bool), None
    for x, (d, i, b, n) in enumerate(zip(doc.tolist(), item.tolist(), begin.tolist(), length.tolist(), strict=True)):
        if held is None or d != held[0] or i != held[1] or b > held[2] + n:
            keep[x], held = True, (d, i, b)
    first = np.flatnonzero(keep)
    latest = begin[np.append(first[1:], len(doc)) - 1]
    doc, item, begin, length = doc[first], item[first], begin[first], length[first]
    slack = length // 4 + 2
    start, end = np.maximum(begin - slack, edge[doc]), np.minimum(latest + 2 * length + slack, edge[doc + 1])
    good = np.flatnonzero(_share_held(items, item, hashes, start, end) >= threshold)
    doc, item, start, end = doc[good], item[good], start[good], end[good]
    score, last = align(items, item, hashes, start, end)
    return doc, item, score, last


def _hits(items: Items, words: Words, threshold: float) -> pa.RecordBatch | None:
    hashes = words.hashes()
    edge = np.append(0, np.cumsum(words.counts()))
    often = np.bincount(items.seed, minlength=len(items.seeds))
    hits, load = [], np.zeros(words.n_docs, np.int64)
    for n in items.sizes:
        h, doc, at = _runs(hashes, words.doc, n)
        i, seed = items.lookup(h)
        hits.append((doc[i], at[i], seed))
        load += np.bincount(doc[i], often[seed], words.n_docs).astype(np.int64)
    total = np.append(0, np.cumsum(load))
    parts, lo = [], 0
    while lo < words.n_docs and total[lo] < total[-1]:
        # documents with a bounded number of hits (or one document)
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + MOST_HITS, side="right")) - 1)
        if total[hi] > total[lo]:
            own = [slice(*np.searchsorted(doc, (lo, hi))) for doc, _, _ in hits]
            parts.append(_windows(items, [tuple(x[s] for x in hit) for hit, s in zip(hits, own, strict=True)], edge, hashes, threshold))
        lo = hi
    if not parts or not sum(len(p[0]) for p in parts):
        return None
    doc, item, score, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    good = score >= threshold
    doc, item, score, last = doc[good], item[good], score[good], last[good]
    named = np.repeat(np.arange(len(item)), [len(items.ids[i]) for i in item])
    ids = pa.array([x for i in item for x in items.ids[i]], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc[named]), ids, pa.array(score[named]), pa.array((last - edge[doc])[named])], ["row", "item_id", "score", "last_word"])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    own = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    return [own if n == 1 else own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, last_word) of the documents that hold an item with a score of `threshold` or more.

    One row for each document and item, of its best passage; last_word is the position of the
    passage's last word.  Null or empty texts and items without words match nothing; a null
    item_id or doc_id can match, as null.  Rows that repeat a doc_id are one document, rows that
    repeat an item_id one item; of equal scores the passage that ends last counts.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    out = None
    for block in _blocks(benchmark, "item_id", "text"):
        rows = block.orderBy("item_id", "text").collect()  # bounded: about BLOCK_BYTES
        items = items_of([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(items.seeds):
            continue
        shared = spark.sparkContext.broadcast(items)

        def scan(part: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            found = _hits(shared.value, Words(part.column("text")), threshold)
            if found is None:
                return None
            return pa.RecordBatch.from_arrays([part.column("doc_id").take(found.column("row")), found.column("item_id"), found.column("score"), found.column("last_word")], ["doc_id", "item_id", "score", "last_word"])

        got = texts.mapInArrow(over_slices(scan), "doc_id long, item_id long, score double, last_word long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, last_word long")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "last_word")).alias("m")).select("doc_id", "item_id", "m.score", "m.last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that hold no test item, with the input's own columns; rows with a null id stay."""
    return without(docs, matches(docs, benchmark, threshold).where("doc_id is not null").select("doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document that holds a test item, with the items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
