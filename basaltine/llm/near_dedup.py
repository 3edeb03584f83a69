"""Near duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification.

A document's elements are its distinct runs of five folded words (`text.fold`; a shorter text is
one element), each weighing 1 + ln(occurrences).  ProbMinHash draws for every element a Poisson
process whose rate is its weight; each arrival hits one of the registers, a register keeps the
element that came first, and an element stops once its next arrival is later than every register's
first.  Two signatures agree in a register with the probability Jaccard similarity of their
documents.  Documents whose signatures agree in a whole band are candidates, and a candidate pair
is a link if the exact similarity of its elements (Jaccard or probability Jaccard, which
are the same unless shingles repeat) reaches the threshold.

No pairs are emitted within a bucket: buckets with the same least member form a group, whose
members are compared to that centre, then what is still apart to centres of other components;
only what remains apart after that is compared exactly, block against block of bounded size, and a
pair of blocks reports a spanning forest of its links.  So linked groups of any size cost a few
comparisons for each member, and no link that banding finds is lost.

Elements are known by 44 bits of their hash, registers keep 32 bits of it.  Element sets are made
from the texts where they are needed and travel once, to the chunks of the groups that compare
them: a large group is dealt in chunks, each of which gets the centre's set too.  Joins by group
split off hot keys (`graph.looked_up`).  Tables between steps are deleted once they are used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import BROADCAST_ROWS, Scratch, checkpointed, components, joined, looked_up
from .text import Words, bounded_batches, distinct_counts, id_and_text, mix, over_slices, shingle_hashes, texts_of

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 4 registers find a pair of similarity 0.8 with probability 1 - 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Members of a block, and bytes of their element sets, when what remains of a group is compared exactly.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Members of a chunk, and bytes of their element sets, when members are compared to a centre.
CHUNK, CHUNK_BYTES = 1024, 16 << 20

U64 = np.uint64


def elements(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, weight) of each document's distinct shingles, by doc."""
    hashes = words.hashes()
    shingle, doc, _ = shingle_hashes(hashes, words.doc, n)
    count = words.counts()
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(words.doc, few)
        own = np.zeros(len(few), U64)
        for j in range(n - 1):
            there = j < count[few]
            own[there] = own[there] * U64(0xA0761D6478BD642F) + hashes[first[there] + j]
        shingle, doc = np.concatenate([shingle, mix(own + count[few].astype(U64))]), np.concatenate([doc, few])
    # distinct by (doc, upper 44 bits of the hash), in one sort
    keys, times = distinct_counts(doc.astype(U64) << U64(44) | shingle >> U64(20))
    return (keys >> U64(44)).astype(np.int64), mix(keys & U64((1 << 44) - 1)), 1.0 + np.log(times)


def signatures_of(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = REGISTERS) -> np.ndarray:
    """n_docs x k uint32: in each register the element that arrived first (0 where a document has none)."""
    best = np.full(n_docs * k, np.iinfo(U64).max, U64)  # arrival time (float32 bits) and element, packed
    name = (element >> U64(32)) & U64(0xFFFFFFFF)
    at = np.arange(len(doc))
    time = np.zeros(len(doc))
    step = 0
    while len(at):
        step += 1
        draw = mix(element[at] + U64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        uniform = ((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight[at]
        register = (mix(draw) % U64(k)).astype(np.int64)
        packed = time.astype(np.float32).view(np.uint32).astype(U64) << U64(32) | name[at]
        np.minimum.at(best, doc[at] * k + register, packed)
        latest = (best.reshape(n_docs, k).max(axis=1) >> U64(32)).astype(np.uint32).view(np.float32)
        latest = np.where(np.isnan(latest), np.inf, latest)
        going = time < latest[doc[at]]
        at, time = at[going], time[going]
    out = (best & U64(0xFFFFFFFF)).astype(np.uint32)
    out[best == np.iinfo(U64).max] = 0
    return out.reshape(n_docs, k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS int64 bucket keys."""
    part = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), part.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key + part[:, :, j])
    return key.view(np.int64)


def _sequence_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's sequence of words; without words both are 0."""
    hashes, count = words.hashes(), words.counts()
    out = []
    full = np.flatnonzero(count)
    first = np.searchsorted(words.doc, full)
    place = (np.arange(len(hashes)) - np.repeat(first, count[full])).astype(U64)
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        h = np.zeros(words.n_docs, U64)
        if len(full):
            h[full] = mix(np.add.reduceat(mix(hashes ^ mix(place * U64(seed) + U64(1))), first) + count[full].astype(U64))
        out.append(h.view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, same1, same2, size, signature) of every row: two hashes of its word sequence, and how
    many elements it has; no words: both hashes 0 and no signature."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(texts_of(part))
        doc, element, weight = elements(words)
        sig = signatures_of(doc, element, weight, part.num_rows)
        one, two = _sequence_keys(words)
        empty = words.counts() == 0
        binary = pa.array([None if e else s.tobytes() for s, e in zip(sig, empty, strict=True)], pa.binary())
        size = pa.array(np.bincount(doc, minlength=part.num_rows).astype(np.int32))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(one), pa.array(two), size, binary], ["doc_id", "same1", "same2", "size", "signature"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, same1 long, same2 long, size int, signature binary")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The greater of Jaccard and probability Jaccard of two sorted sets of elements with weights."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    shared = int(hit.sum())
    plain = shared / (len(a) + len(b) - shared)
    if plain >= THRESHOLD or shared == 0 or (wa.max() == 1 and wb.max() == 1):
        return plain
    x, y = np.append(wa, np.zeros(len(b) - shared)), np.zeros(len(a) + len(b) - shared)
    y[: len(a)][hit] = wb[at[hit]]
    rest = np.ones(len(b), bool)
    rest[at[hit]] = False
    y[len(a) :] = wb[rest]
    kinds, times = np.unique(np.stack([x, y], axis=1), axis=0, return_counts=True)  # few distinct pairs of weights
    both = (kinds[:, 0] > 0) & (kinds[:, 1] > 0)
    p = kinds[both]
    most = np.maximum(kinds[None, :, 0] / p[:, None, 0], kinds[None, :, 1] / p[:, None, 1]) @ times
    return max(plain, float((times[both] / most).sum()))


_SENT = "key long, i int, j int, own int, doc long, component long, hashes binary, weights binary"


def _sent(docs: DataFrame, routes: DataFrame, scratch: Scratch) -> DataFrame:
    """Element sets (key, i, j, own, doc, component, hashes, weights) at the places that `routes`
    (doc, component, key, i, j, own) names, sorted by (key, i, j, own, doc); each set is made once."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, element, weight = elements(Words(texts_of(part)))
        order = np.lexsort((element, doc))
        element, weight = element[order], weight[order].astype(np.float32)
        ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
        cut = list(zip(ends[:-1], ends[1:], strict=True))
        hashes = pa.array([element[s:e].tobytes() for s, e in cut], pa.binary())
        weights = pa.array([weight[s:e].tobytes() if (weight[s:e] != 1).any() else b"" for s, e in cut], pa.binary())
        places = part.column("places")
        row = pa.array(np.repeat(np.arange(part.num_rows), pc.list_value_length(places).to_numpy()))
        flat = places.flatten()
        named = {n: flat.field(n) for n in ("key", "i", "j", "own")}
        return pa.RecordBatch.from_pydict(named | {"doc": part.column("doc_id").take(row), "component": part.column("component").take(row), "hashes": hashes.take(row), "weights": weights.take(row)})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in over_slices(run)(batches):
            # a document may go to many places: its rows leave in batches of bounded bytes
            size = np.cumsum(np.fromiter((len(x) for x in found.column("hashes").to_pylist()), np.int64, found.num_rows))
            at = 0
            while at < found.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                yield found.slice(at, end - at)
                at = end

    at = routes.groupBy("doc").agg(F.min("component").alias("component"), F.collect_set(F.struct("key", "i", "j", "own")).alias("places"))
    at = scratch.keep("routes", at.withColumnRenamed("doc", "doc_id"))
    sent = joined(id_and_text(docs), at, "doc_id", most=BROADCAST_ROWS // 4).select("doc_id", "text", "component", "places").mapInArrow(sets, _SENT)
    # rows that repeat an id: the first text in order stands for the document
    return sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "doc", "hashes", "weights")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new place (key, i, j) starts, rows of one place) in order."""
    name = None
    for batch in batches:
        k = np.stack([batch.column(x).to_numpy() for x in ("key", "i", "j")], axis=1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), batch.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s < e:
                yield tuple(k[s]) != name, batch.slice(s, e - s)
                name = tuple(k[s])


_LINKS = "a long, b long, similarity double"


def _link_rows(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, s = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def _chunks(members: DataFrame, n: int, size: int) -> DataFrame:
    """(key, n, g) of each group: its members, and in how many parts of at most about `n` members and `size` bytes it is cut."""
    g = F.greatest(F.ceil(F.count("*") / n), F.ceil(F.sum(F.col("size").cast("long") * 12) / size)).cast("int")
    return members.groupBy("key").agg(F.count("*").alias("n"), g.alias("g"))


def verified(docs: DataFrame, members: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b, similarity) between documents and their centres: `members` (key, doc, size) names pairs of
    a centre and a document, of which those whose exact similarity reaches the threshold are returned."""
    chunks = scratch.keep("chunks", _chunks(members, CHUNK, CHUNK_BYTES))
    zero, no = F.lit(0).alias("i"), F.lit(None).cast("long").alias("component")
    others = looked_up(members, chunks, ["key"]).select("doc", no, "key", zero, F.pmod(F.xxhash64("doc"), F.col("g")).cast("int").alias("j"), F.lit(1).alias("own"))
    centres = chunks.select(F.col("key").alias("doc"), no, "key", zero, F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), F.lit(0).alias("own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new, part in _groups(batches):
            if new:
                centre = last = None
            found = []
            for own, doc, h, w in zip(*(part.column(c).to_pylist() for c in ("own", "doc", "hashes", "weights")), strict=True):
                if (own, doc) == last:
                    continue
                last = (own, doc)
                x = np.frombuffer(h, U64)
                if not own:
                    centre = (doc, x, np.frombuffer(w, np.float32) if w else None)
                    continue
                other, y, v = centre
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) and not w and v is None:
                    continue
                alike = similarity(x, np.frombuffer(w, np.float32) if w else np.ones(len(x), np.float32), y, v if v is not None else np.ones(len(y), np.float32))
                if alike >= threshold:
                    found.append((doc, other, alike))
            if found:
                yield _link_rows(found)

    return _sent(docs, others.unionByName(centres), scratch).mapInArrow(compare, _LINKS)


def _remaining(members: DataFrame, known: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members (key, doc, size, component) of groups that still hold more than one component, but for groups of two."""
    own = joined(members, known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2")
    mixed = scratch.keep("mixed", mixed.select("key", "n"))
    return scratch.keep(name, looked_up(own, mixed, ["key"]).select("key", "doc", "size", "component"))


def _other_centres(rest: DataFrame, scratch: Scratch, salt: int = 1) -> DataFrame:
    """Each member beside a centre of another component of its group, as members (key, doc, size) of that
    centre: the member of the least salted hash, or for those of its component the member of the least
    hash in any other component."""
    draw = F.struct(F.xxhash64("doc", F.lit(salt)).alias("h"), F.col("doc").alias("d"), F.col("component").alias("c"))
    first = scratch.keep("first", rest.groupBy("key").agg(F.min(draw).alias("one"), F.count("*").alias("n")))
    with_first = looked_up(rest, first, ["key"]).drop("n")
    second = with_first.where("component <> one.c").groupBy("key").agg(F.min(draw).alias("two"))
    both = scratch.keep("both", first.join(second, "key").select("key", "n", F.col("one.c").alias("c"), F.col("one.d").alias("one"), F.col("two.d").alias("two")))
    other = F.when(F.col("component") == F.col("c"), F.col("two")).otherwise(F.col("one"))
    return looked_up(rest, both, ["key"]).select(other.alias("key"), "doc", "size").distinct()


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of bounded matrices."""
    every = np.concatenate([*left, *right])
    kinds, column = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    often = np.bincount(column, minlength=len(kinds)) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), 1024):
        a, b = np.searchsorted(column, (lo, lo + 1024))
        part = np.zeros((len(left) + len(right), 1024), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _most_alike(shared: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray | None], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper bounds of the probability Jaccard similarities of all left with all right members.

    A shared element adds 1 / sum(max(x_j / x_i, y_j / y_i)) <= min(x_i / sum(x), y_i / sum(y)), so no
    pair is more alike than the share of either's total weight that as many of its heaviest elements hold.
    """

    def share(x: int, n: np.ndarray) -> np.ndarray:
        w = weights[x]
        if w is None:
            return n / max(len(sets[x]), 1)
        total = np.append(0, np.cumsum(np.sort(w.astype(np.float64))[::-1]))
        return total[n] / total[-1]

    n = shared.astype(np.int64)
    out = np.stack([share(x, n[i]) for i, x in enumerate(left)])
    return np.minimum(out, np.stack([share(y, n[:, j]) for j, y in enumerate(right)], axis=1), out=out)


def _forest(doc: np.ndarray, component: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray | None], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links between members at `left` and at `right` that join what isn't joined yet, each of another component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    size = np.array([len(x) for x in sets])
    shared = _shared_counts([sets[x] for x in left], [sets[x] for x in right])
    plain = shared / np.maximum(size[left][:, None] + size[right][None, :] - shared, 1)
    apart = component[left][:, None] != component[right][None, :]
    weighted = np.array([w is not None for w in weights])
    either = weighted[left][:, None] | weighted[right][None, :]
    out = []

    def join(x: int, y: int, s: float) -> None:
        a, b = find(int(component[x])), find(int(component[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((max(int(doc[x]), int(doc[y])), min(int(doc[x]), int(doc[y])), s))

    for x, y in zip(*np.nonzero(apart & (plain >= threshold)), strict=True):
        join(left[x], right[y], float(plain[x, y]))
    if not either.any():
        return out
    for x, y in zip(*np.nonzero(apart & either & (plain < threshold) & (_most_alike(shared, sets, weights, left, right) >= threshold - 1e-6)), strict=True):
        x, y = left[x], right[y]
        if find(int(component[x])) != find(int(component[y])):
            ones = [w if w is not None else np.ones(len(s), np.float32) for w, s in ((weights[x], sets[x]), (weights[y], sets[y]))]
            if (s := similarity(sets[x], ones[0], sets[y], ones[1])) >= threshold:
                join(x, y, s)
    return out


def _block_links(docs: DataFrame, rest: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between components of a group: exact, all blocks of its members against all."""
    chunks = scratch.keep("chunks", _chunks(rest, BLOCK, BLOCK_BYTES))
    cut = looked_up(rest, chunks, ["key"]).withColumn("c", F.pmod(F.xxhash64("doc"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    routes = cut.select("doc", "component", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.col("c").alias("own"))

    def compare(held: list[pa.RecordBatch]) -> list[tuple[int, int, float]]:
        t = pa.Table.from_batches(held)
        doc, component, c = (t[x].to_numpy() for x in ("doc", "component", "own"))
        once = np.append(True, (doc[1:] != doc[:-1]) | (c[1:] != c[:-1]))
        t, doc, component, c = t.filter(pa.array(once)), doc[once], component[once], c[once]
        sets = [np.frombuffer(x, U64) for x in t["hashes"].to_pylist()]
        weights = [np.frombuffer(x, np.float32) if x else None for x in t["weights"].to_pylist()]
        left, right = np.flatnonzero(c == t["i"][0].as_py()), np.flatnonzero(c == t["j"][0].as_py())
        return _forest(doc, component, sets, weights, left, right, threshold) if len(left) and len(right) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for new, part in _groups(batches):
            if new and held:
                if found := compare(held):
                    yield _link_rows(found)
                held = []
            held.append(part)
        if held and (found := compare(held)):
            yield _link_rows(found)

    return _sent(docs, routes, scratch).mapInArrow(run, _LINKS)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) of every row of `docs`, as a written table.

    class_id is the least doc_id of the documents that links join, through others if need be; a
    document without a link is a class of its own.  Equal sequences of words are one class, texts
    without words too (null and empty texts among them).  Rows that repeat a doc_id are one
    document.  A null doc_id has a null class and is kept.  kept marks the class's namesake.
    """
    scratch = Scratch(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    sigs = scratch.keep("sigs", signatures(docs))
    named = sigs.where("doc_id is not null").select("doc_id", "same1", "same2", "size", "signature")
    same = scratch.keep("same", named.groupBy("same1", "same2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("signature").alias("signature")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, REGISTERS)
                own = [np.repeat(part.column(c).to_numpy(), BANDS) for c in ("rep", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), *map(pa.array, own)], ["band", "doc", "size"])

    banded = same.where("signature is not null").select("rep", "size", "signature").mapInArrow(keys, "band long, doc long, size int")
    buckets = scratch.keep("buckets", banded.groupBy("band").agg(F.min("doc").alias("key"), F.max("doc").alias("most"), F.count("*").alias("n")).where("key <> most").select("band", "key", "n"))
    members = scratch.keep("members", looked_up(banded, buckets, ["band"]).select("key", "doc", "size").distinct())
    scratch.drop("buckets")
    links = scratch.keep("links", verified(docs, members.where("doc <> key"), scratch, threshold).select("a", "b"))
    known = components(links, scratch=scratch)
    rest = _remaining(members, known, scratch, "rest")
    if not rest.isEmpty():
        new = scratch.keep("new", verified(docs, _other_centres(rest, scratch), scratch, threshold).select("a", "b"))
        if not new.isEmpty():
            # components so far and the new links, not all links again
            known = components(_edges(known).unionByName(new), scratch=scratch)
            rest = _remaining(rest.drop("component"), known, scratch, "left")
        if not rest.isEmpty():
            new = scratch.keep("new", _block_links(docs, rest, scratch, threshold).select("a", "b"))
            if not new.isEmpty():
                known = components(_edges(known).unionByName(new), scratch=scratch)
    # documents of several texts: rows that repeat an id join their classes
    several = named.groupBy("doc_id").agg(*(f(c).alias(f"{c}{i}") for c in ("same1", "same2") for i, f in enumerate((F.min, F.max)))).where("same10 <> same11 or same20 <> same21")
    several = scratch.keep("several", several.select("doc_id"))
    if not several.isEmpty():
        texts = joined(named, several, "doc_id").select("doc_id", "same1", "same2").distinct()
        own = scratch.keep("new", texts.join(same.select("same1", "same2", "rep"), ["same1", "same2"]).select("doc_id", "rep"))
        extra = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
        known = components(_edges(known).unionByName(extra), scratch=scratch)
    # the class of each text, where it isn't the only row's id
    of_text = joined(same.select("same1", "same2", "rep", "n"), known.withColumnRenamed("node", "rep"), "rep", "left")
    of_text = scratch.keep("of_text", of_text.select("same1", "same2", "n", F.coalesce("component", "rep").alias("class_id")).where("n > 1 or class_id <> rep"))
    out = looked_up(named, of_text, ["same1", "same2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    out = checkpointed(out.unionByName(sigs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))))
    scratch.clear()
    return out


def _edges(known: DataFrame) -> DataFrame:
    return known.select(F.col("node").alias("a"), F.col("component").alias("b"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id isn't among `ids` (column doc_id); ids are broadcast only if counted to be few."""
    ids = checkpointed(ids.select(F.col("doc_id").alias("__gone")).distinct())
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["__gone"], "left_anti")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with the input's own columns; rows that repeat both an id and a text stay once."""
    found = classes(docs, threshold)
    left = without(docs, found.where("not kept"))
    again = checkpointed(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, again).unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the class of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
