"""Language-model scores by context-tree weighting, beside a word-frequency base.

The model reads a text's words (ASCII letters lowered) with one space between them and a line
break at the end, byte by byte; each byte is eight binary decisions, and each decision has a
tree of contexts, the up to five bytes before.  Every node estimates by Krichevsky-Trofimov from
its two counts; bottom up, a node's weighted probability is the mean of its own block probability
and the product of its children's.  After training the tree is frozen: a decision's probability
mixes the nodes on its path with the weights that training left, and stops where a context was
never seen.  The block probabilities depend on counts alone, so the tree can be built from
counts in any order, by parts: contexts that share their three nearest bytes form a subtree that
one task builds, the nodes of two bytes are summed up from the subtrees and go to those that need
them, and the nodes above (256 contexts and the root, of at most 255 decisions each) are summed up
from these and broadcast.

Nothing that grows with the corpus is broadcast.  Texts are grouped in blocks of bounded size; a
block asks for each of its distinct words and contexts once, the tasks that hold counts
answer, and the answers meet the block's texts again.  Words are dealt by their hash, contexts by
their two nearest bytes and, as some of these are in a large share of all contexts, in `SLICES`
slices by the third.  The blocks' counts of a slice are merged in levels of bounded fan-in.  The
task that answers reads a slice's counts first and then the questions one after the other, so its
memory holds the slice's distinct contexts and one batch of questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import input_bytes, pack, unpack, written
from .text import bounded_batches, buffer_of, distinct_counts, held_out, mix, slices, span_hashes

DEPTH = 5
#: Bytes of text of a block.
BLOCK_BYTES = 16 << 20
#: Bytes of input for each bucket of words or contexts, and buckets at most; contexts of a bucket are in several slices.
BUCKET_BYTES, MOST_BUCKETS, SLICES = 64 << 20, 4096, 8
#: Tables of one slice that are merged by one task, and blocks that one task answers.
FAN, ASKERS = 256, 1024
END = 10
U64 = np.uint64
DOCS, WORDS, CONTEXTS = 0, 1, 2

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


class Stream:
    """A slice of texts as the model reads them: bytes, where texts start and end, and the tokens in them."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffer_of(texts)
        n = len(texts)
        raw = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
        word = ~_GAP[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        before = np.append(False, word[:-1]) & ~cut[:-1] if len(raw) else word
        start = word & ~before
        doc = np.searchsorted(offsets, np.flatnonzero(start), side="right") - 1
        later = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
        # where each kept byte goes: its rank, plus a space for each later word so far, plus the ends of the texts before
        spaces = np.zeros(len(raw), bool)
        spaces[np.flatnonzero(start)[later]] = True
        kept = np.append(0, np.cumsum(word))
        gaps = np.append(0, np.cumsum(spaces))
        size = (kept[offsets[1:]] - kept[offsets[:-1]]) + (gaps[offsets[1:]] - gaps[offsets[:-1]]) + 1
        self.offsets = np.append(0, np.cumsum(size))
        at = np.flatnonzero(word)
        own = np.searchsorted(offsets, at, side="right") - 1
        place = kept[at] + gaps[at + 1] + own
        self.data = np.full(self.offsets[-1], 32, np.uint8)
        self.data[self.offsets[1:] - 1] = END
        self.data[place] = raw[at]
        # tokens: the words and each text's end
        inside = self.data > 32
        inside |= (self.data < 9) | (self.data > 13) & (self.data < 32)
        first = inside & ~np.append(False, inside[:-1])
        last = inside & ~np.append(inside[1:], False)
        ends = self.offsets[1:] - 1
        starts = np.concatenate([np.flatnonzero(first), ends])
        order = np.argsort(starts, kind="stable")
        self.start, self.stop = starts[order], np.concatenate([np.flatnonzero(last) + 1, ends + 1])[order]
        self.token_doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.n = n

    def tokens(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.stop)

    def contexts(self, depth: int = DEPTH) -> np.ndarray:
        """For each byte: the bytes before it, the nearest first (highest), and itself (lowest); before a text there are ends."""
        n = len(self.data)
        key = self.data.astype(U64)
        size = np.diff(self.offsets)
        for d in range(1, depth + 1):
            past = np.full(n, END, U64)
            past[d:] = self.data[:-d] if n > d else past[d:]
            for k in range(d):
                past[self.offsets[:-1][size > k] + k] = END
            key |= past << U64(8 * (depth + 1 - d))
        return key


class Table:
    """A hash table from uint64 keys to their positions, built and searched in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> U64(31))) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys that are all there."""
        out = self.slots[at := self._home(keys)]
        wrong = np.flatnonzero(self.keys[out] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            out[wrong] = self.slots[at]
            bad = self.keys[out[wrong]] != keys[wrong]
            wrong, at = wrong[bad], at[bad]
        return out


def _slice_of_words(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket times SLICES plus slice; all words of a bucket are in its first slice."""
    return (mix(keys) % U64(n)).astype(np.int64) * SLICES


def _slice_of_contexts(keys: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """The bucket is dealt by the two nearest bytes of the context, the slice by the third."""
    third = keys >> U64(8 * (depth - 2)) & U64(255)
    return (mix(keys >> U64(8 * (depth - 1))) % U64(n)).astype(np.int64) * SLICES + (mix(third + U64(1)) % U64(SLICES)).astype(np.int64)


# ---------------------------------------------------------------- blocks and their questions

_PARTS = "block long, slice int, data binary, more binary, kind int"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs where `learn` holds (0 if only elsewhere)."""
    known, n = distinct_counts(keys[learn])
    other = distinct_counts(keys[~learn])[0]
    return _merged([(known, n), (other, np.zeros(len(other), np.int64))])


def _block_rows(block: int, tables: list[pa.RecordBatch], buckets: int, depth: int) -> Iterator[pa.RecordBatch]:
    words, contexts = [], []
    for whole in tables:
        for part in slices(whole, "text"):
            s = Stream(part.column("text"))
            learn = ~part.column("held").to_numpy(zero_copy_only=False)
            words.append(_counted(s.tokens(), learn[s.token_doc]))
            contexts.append(_counted(s.contexts(depth), np.repeat(learn, np.diff(s.offsets))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for t in tables:
            out.write_batch(t)
    rows = [(block, -1, sink.getvalue().to_pybytes(), b"", DOCS)]
    for kind, found, slice_of in ((WORDS, words, _slice_of_words), (CONTEXTS, contexts, lambda k, n: _slice_of_contexts(k, n, depth))):
        keys, n = _merged(found)
        at = slice_of(keys, buckets)
        order = np.argsort(at, kind="stable")
        names, first = np.unique(at[order], return_index=True)
        for name, lo, hi in zip(names.tolist(), first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True):
            rows.append((block, name, pack(keys[order[lo:hi]]), pack(n[order[lo:hi]]), kind))
    for lo in range(0, len(rows), 64):
        cols = list(zip(*rows[lo : lo + 64], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int32())], ["block", "slice", "data", "more", "kind"])


def _blocks(docs: DataFrame, buckets: int, depth: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = n = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                _, o = buffer_of(part.column("text"))
                if held and size + o[-1] > block_bytes:
                    yield from _block_rows(task << 24 | n, held, buckets, depth)
                    held, size, n = [], 0, n + 1
                held.append(part)
                size += int(o[-1])
        if held:
            yield from _block_rows(task << 24 | n, held, buckets, depth)

    return docs.mapInArrow(run, _PARTS)


# ---------------------------------------------------------------- answers

def _cells(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpack(x) for x in table["data"].to_pylist()], [unpack(x) for x in table["more"].to_pylist()]


_CELL = "kind int, slice int, part int, data binary, more binary, seen long, total long"


def _merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over cells sorted by (kind, slice, part): one cell for each, merged as they come."""
    name, held, size, least = None, [], 0, 0

    def out() -> pa.RecordBatch:
        keys, n = _merged(held)
        row = {"kind": name[0], "slice": name[1], "part": name[2], "data": pack(keys), "more": pack(n), "seen": int((n > 0).sum()), "total": int(n.sum())}
        return pa.RecordBatch.from_pylist([row], _CELL_SCHEMA)

    for batch in batches:
        for i in range(batch.num_rows):
            kind, at, part, data, more = (batch.column(c)[i].as_py() for c in ("kind", "slice", "part", "data", "more"))
            if (kind, at, part) != name:
                if held:
                    yield out()
                name, held, size, least = (kind, at, part), [], 0, 0
            held.append((unpack(data), unpack(more)))
            size += len(held[-1][0])
            if size > 2 * least + 1_000_000:
                held = [_merged(held)]
                size = least = len(held[0][0])
    if held:
        yield out()


_CELL_SCHEMA = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("seen", pa.int64()), ("total", pa.int64())])


def _narrowed(cells: DataFrame, n_blocks: int, fan: int) -> DataFrame:
    """One cell for each (kind, slice), merged level by level from those of the blocks, `fan` or so at a time."""
    n, out = n_blocks, cells.select("kind", "slice", F.xxhash64("block").alias("part"), "data", "more")
    while True:
        n = -(-n // fan)
        out = out.withColumn("part", F.pmod("part", F.lit(n)).cast("int"))
        out = out.repartition("kind", "slice", "part").sortWithinPartitions("kind", "slice", "part").select("kind", "slice", "part", "data", "more").mapInArrow(_merge_cells, _CELL)
        if n == 1:
            return out.select("kind", "slice", "data", "more", "seen", "total")


def _log_gamma(n: np.ndarray) -> np.ndarray:
    """log gamma(n) for n >= 0.5, by Stirling's series after eight steps up."""
    x = n + 8.0
    low = np.ones_like(n)
    for i in range(8):
        low *= n + i
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - np.log(low)


def block_probability(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n - ones + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(n + 1.0) - np.log(np.pi)


class Nodes:
    """Nodes of one depth and one of the eight decisions: sorted keys (context, bits so far), counts, weights."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.n, self.ones = keys, n, ones
        own = block_probability(n, ones)
        if below is None:
            self.weighted, self.stay = own, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(own, below) - np.log(2.0)
            self.stay = 1.0 / (1.0 + np.exp(-np.clip(own - below, -60, 60)))

    def step(self, key: np.ndarray, bit: np.ndarray, p: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Mix this depth into the probability from the depths below it."""
        if not len(self.keys):
            return np.full(len(key), 0.5), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        n, ones = np.where(there, self.n[at], 0), np.where(there, self.ones[at], 0)
        own = (np.where(bit, ones, n - ones) + 0.5) / (n + 1.0)
        if p is None:
            return own, there
        stay = np.where(there, self.stay[at], 1.0)
        return np.where(seen, stay * own + (1 - stay) * p, own), there


def _node_keys(key: np.ndarray, j: int) -> np.ndarray:
    """(context, byte) keys to (context, decision j's path)."""
    return (key & ~U64(255)) | U64(1 << j) | ((key & U64(255)) >> U64(8 - j))


def _decisions(key: np.ndarray, count: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = _node_keys(key, j)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    bit = (key >> U64(7 - j)) & U64(1)
    return node[first], np.add.reduceat(count, first), np.add.reduceat(np.where(bit == 1, count, 0), first)


def _shorter(key: np.ndarray) -> np.ndarray:
    """Drop the farthest byte of the context from (context, byte) or (context, path) keys."""
    return (key >> U64(16)) << U64(8) | (key & U64(255))


class Tree:
    """Context trees of the eight decisions, for depths `top` to `depth`, from counts of (context, byte) keys."""

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        self.nodes: dict[tuple[int, int], Nodes] = {}
        for d in range(depth, top - 1, -1):
            for j in range(8) if len(key) else ():
                node, n, ones = _decisions(key, count.astype(float), j)
                below = None
                if d < depth:
                    child = self.nodes[d + 1, j]
                    below = np.bincount(np.searchsorted(node, _shorter(child.keys)), child.weighted, len(node))
                self.nodes[d, j] = Nodes(node, n, ones, below)
            key, count = _merged([(_shorter(key), count)]) if len(key) else (key, count)
        self.rest = (key, count)

    def log_probability(self, key: np.ndarray, root: Tree | None) -> np.ndarray:
        """log10 of each (context, byte) key's probability."""
        out = np.zeros(len(key))
        empty = Nodes(np.zeros(0, U64), np.zeros(0), np.zeros(0), None)
        for j in range(8):
            bit = ((key >> U64(7 - j)) & U64(1)) == 1
            p = seen = None
            own = key
            for d in range(self.depth, -1, -1):
                tree = self if d >= self.top else root
                if tree is not None:
                    p, seen = tree.nodes.get((d, j), empty).step(_node_keys(own, j), bit, p, seen)
                own = _shorter(own)
            out += np.log10(p)
        return out

    def add_top(self, rows: np.ndarray) -> None:
        """The nodes of one byte less, from sums (key, n, ones, below) over all subtrees."""
        self.top -= 1
        for j, own in _by_decision(rows[0].astype(U64)):
            self.nodes[self.top, j] = Nodes(rows[0][own].astype(U64), rows[1][own], rows[2][own], rows[3][own])

    def summary(self) -> tuple[np.ndarray, ...] | None:
        """(key, n, ones, below) that the top depth's nodes add to those of one byte less."""
        tops = [self.nodes[self.top, j] for j in range(8) if (self.top, j) in self.nodes]
        return _added(*(np.concatenate(x) for x in zip(*((t.keys, t.n, t.ones, t.weighted) for t in tops), strict=True))) if tops else None


def _added(key: np.ndarray, n: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, ...]:
    own, at = np.unique(_shorter(key), return_inverse=True)
    return (own, *(np.bincount(at, v, len(own)) for v in (n, ones, weighted)))


def _by_decision(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(decision, places of its nodes) of sorted keys of one depth."""
    path = key & U64(255)
    for j in range(8):
        if len(own := np.flatnonzero((path >= (1 << j)) & (path < (2 << j)))):
            yield j, own


_SUMS = "slice int, node long, n double, ones double, below double"


def _sums_batch(at: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    key, n, ones, below = found
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), at, np.int32)), pa.array(key.astype(np.int64)), pa.array(n), pa.array(ones), pa.array(below)], ["slice", "node", "n", "ones", "below"])


def _subtree(keys: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
    return Tree(keys[counts > 0], counts[counts > 0], depth, 3)


def _two_byte_sums(merged: DataFrame, depth: int) -> DataFrame:
    """(slice, node, n, ones, below) of the nodes of two bytes; slice is the first of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = (unpack(batch.column(c)[i].as_py()) for c in ("data", "more"))
                if (found := _subtree(keys, counts, depth).summary()) is not None:
                    yield _sums_batch(batch.column("slice")[i].as_py() // SLICES * SLICES, found)

    return merged.where(F.col("kind") == CONTEXTS).select("slice", "data", "more").mapInArrow(run, _SUMS).groupBy("slice", "node").agg(*(F.sum(c).alias(c) for c in ("n", "ones", "below")))


def _root(upper: DataFrame) -> Tree:
    """Depths 1 and 0 from the nodes of two bytes, of which the driver gets the sums for 256 x 255 nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ones, below = (batch.column(c).to_numpy() for c in ("n", "ones", "below"))
            key = batch.column("node").to_numpy().astype(U64)
            yield _sums_batch(0, _added(key, n, ones, Nodes(key, n, ones, below).weighted))

    sums = upper.select("slice", "node", "n", "ones", "below").mapInArrow(run, _SUMS).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n", "ones", "below")))
    rows = sums.toArrow().sort_by("node")
    tree = Tree(np.zeros(0, U64), np.zeros(0), 1, 2)
    for _ in range(2):
        tree.add_top(np.stack([rows[c].to_numpy().astype(float) for c in ("node", "n", "ones", "below")]))
        if not len(rows) or tree.top == 0:
            break
        rows = pa.table(dict(zip(("node", "n", "ones", "below"), tree.summary(), strict=True)))
    tree.top = 0
    return tree


def _packed_sums(table: pa.Table) -> pa.Table:
    t = table.sort_by("node")
    numbers = np.concatenate([t[c].to_numpy() for c in ("n", "ones", "below")])
    return pa.table({"slice": t["slice"].slice(0, 1), "data": pa.array([pack(t["node"].to_numpy())], pa.binary()), "more": pa.array([pack(numbers)], pa.binary())})


_ANSWER = "block long, kind int, data binary, more binary"


def _answers(asked: DataFrame, merged: DataFrame, upper: DataFrame, root, n_blocks: int, depth: int, askers: int) -> DataFrame:
    """(block, kind, data, more): the values of the keys that each block asks for, slice by slice.

    A task gets a slice's nodes of two bytes, then its merged counts, then the questions of up to
    `askers` or so blocks, which it answers as they come.
    """
    n_parts = -(-n_blocks // askers)
    parts = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part")
    none = F.lit(None).cast("long").alias("block")
    nodes = upper.groupBy("slice").applyInArrow(_packed_sums, "slice int, data binary, more binary")
    nodes = nodes.withColumn("slice", F.explode(F.expr(f"sequence(slice, slice + {SLICES - 1})"))).select(F.lit(CONTEXTS).alias("kind"), "slice", parts, F.lit(0).alias("step"), none, "data", "more")
    counts = merged.select("kind", "slice", parts, F.lit(1).alias("step"), none, "data", "more")
    questions = asked.select("kind", "slice", F.pmod(F.xxhash64("block"), F.lit(n_parts)).cast("int").alias("part"), F.lit(2).alias("step"), "block", "data", F.lit(None).cast("binary").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = above = keys = values = None
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                kind, at, part, step, block, data, more = (batch.column(c)[i].as_py() for c in ("kind", "slice", "part", "step", "block", "data", "more"))
                if (kind, at, part) != name:
                    name, above, keys, values = (kind, at, part), None, None, None
                if step == 0:
                    above = np.concatenate([unpack(data).astype(float), unpack(more)]).reshape(4, -1)
                elif step == 1:
                    keys, values = unpack(data), unpack(more)
                    if kind == CONTEXTS:
                        tree = _subtree(keys, values, depth)
                        tree.add_top(above if above is not None else np.zeros((4, 0)))
                        values = np.concatenate([tree.log_probability(keys[lo : lo + 500_000], root.value) for lo in range(0, len(keys), 500_000)]).astype(np.float32)
                else:
                    wanted = unpack(data)
                    found.append((block, kind, data, pack(values[np.searchsorted(keys, wanted)])))
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["block", "kind", "data", "more"])

    rows = nodes.unionByName(counts).unionByName(questions)
    return rows.repartition("kind", "slice", "part").sortWithinPartitions("kind", "slice", "part", "step").mapInArrow(run, _ANSWER)


# ---------------------------------------------------------------- scores

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held_out_mod: int = 7, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan: int = FAN, buckets: int | None = None, askers: int = ASKERS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row.

    Learns from rows whose crc32(doc_id as text) mod `held_out_mod` is not 2 (a null id is learned
    from).  base_score is the sum over tokens (words and one end) of log10((c + 1) / (N + V + 1));
    score is the tree's log10 probability of the words and the end.  A null or empty text is the
    end alone.  Rows that repeat an id are learned from and scored each for itself; equal texts have
    equal scores.  Without training rows counts are zero and every decision has probability one half;
    an empty table gives no rows.  `depth` (3 at least) is the longest context in bytes; `buckets`,
    `fan`, `askers` and `block_bytes` deal out the work and leave the results alone.
    """
    if depth < 3:
        raise ValueError("contexts need three bytes at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held", held_out("doc_id", held_out_mod))
    buckets = buckets or max(16, min(MOST_BUCKETS, input_bytes(own) // BUCKET_BYTES))
    parts = written(_blocks(own, buckets, depth, block_bytes), "kind")
    asked = parts.where(F.col("kind") != DOCS).select("kind", "slice", "block", "data", "more")
    n_blocks = max(1, parts.where(F.col("kind") == DOCS).count())
    merged = written(_narrowed(asked, n_blocks, fan))
    n, v = merged.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    upper = written(_two_byte_sums(merged, depth))
    root = spark.sparkContext.broadcast(_root(upper))
    answers = _answers(asked, merged, upper, root, n_blocks, depth, askers)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        kinds = np.array(right["kind"].to_pylist())
        keys, values = _cells(right)
        for kind in (WORDS, CONTEXTS):
            at = np.flatnonzero(kinds == kind)
            tables.append((Table(np.concatenate([keys[i] for i in at])), np.concatenate([values[i] for i in at])))
        (by_word, count), (by_context, log_p) = tables
        out = []
        for blob in left["data"].to_pylist():
            for part in pa.ipc.open_stream(blob):
                s = Stream(part.column("text"))
                c = count[by_word.find(s.tokens())]
                p = log_p[by_context.find(s.contexts(depth))].astype(float)
                base = np.log10((c + 1.0) / (n + v + 1.0))
                m = part.num_rows
                out.append(
                    pa.table(
                        {
                            "doc_id": part.column("doc_id"), "held_out": part.column("held"),
                            "n_tokens": pa.array(np.bincount(s.token_doc, minlength=m).astype(np.int64)), "n_known": pa.array(np.bincount(s.token_doc, c > 0, m).astype(np.int64)),
                            "train_tokens": pa.array(np.full(m, n, np.int64)), "base_score": pa.array(np.bincount(s.token_doc, base, m)),
                            "score": pa.array(np.add.reduceat(p, s.offsets[:-1])), "n_bytes": pa.array(np.diff(s.offsets)),
                        }
                    )
                )
        return pa.concat_tables(out)

    texts = parts.where(F.col("kind") == DOCS).select("block", "data")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES + ", n_bytes long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document scored by the base and by the tree."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
