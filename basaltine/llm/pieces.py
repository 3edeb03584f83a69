"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a .model file (its path is a parameter; the file is read where the
query is planned, and workers get the arrays).  Text is escaped as the file says: a space marker in
place of each space and, if asked for, before the text.  The best segmentation maximises the sum
of the pieces' log scores; a character that no piece covers becomes byte pieces, or the unknown
piece where the vocabulary has none.  Ties go to the segmentation whose last piece is longest.

A file of unigram type holds log probabilities, which are used as they are.  The scores of a
file of merge type are only ranks; there a piece's log score follows Zipf's law of its rank.

Where no piece has a space marker after another character, segmentation can't cross a space, so
texts are cut there and each distinct piece of text is segmented once for each slice, all of them together.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import buffer_of, id_and_text, over_slices, span_hashes

#: Where the vocabulary is looked for if no path is given.
DEFAULT_PATH = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Below the least score of a piece, as public implementations have it.
UNKNOWN_PENALTY = 10.0
#: Longer stretches without a space are segmented one at a time.
LONG = 192
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    unigram: bool
    prefix: bool = True  # a marker before the text
    squeeze: bool = False  # runs of spaces become one, outer spaces go


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, unigram, prefix, squeeze, mapped = [], [], [], True, True, True, False
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(value))
            pieces.append(own[1].decode()), scores.append(np.frombuffer(own[2], "<f4")[0]), kinds.append(own[3])
        elif number == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
        elif number == 3:
            own = dict(_fields(value))
            prefix, squeeze, mapped = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(2))
    if mapped:
        raise ValueError(f"{path}: vocabularies with a character map aren't supported")
    return Vocabulary(pieces, np.array(scores, np.float64), np.array(kinds), unigram, prefix, squeeze)


def log_scores(vocabulary: Vocabulary) -> np.ndarray:
    if vocabulary.unigram:
        return vocabulary.scores.copy()
    out = np.zeros(len(vocabulary.pieces))
    own = np.flatnonzero(np.isin(vocabulary.kinds, (NORMAL, USER)))
    rank = np.empty(len(own))
    rank[np.argsort(-vocabulary.scores[own], kind="stable")] = np.arange(1, len(own) + 1)
    out[own] = -np.log(rank) - np.log(np.sum(1.0 / np.arange(1, len(own) + 1)))
    return out


@dataclass
class Trie:
    """Double array: child = base[node] + byte, if check[child] == node; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, piece in keys.items():
        node = 0
        for b in key:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = children[node][b] = len(children)
                children.append({})
                values.append(-1)
            node = nxt
        values[node] = piece
    size = 3 * len(children) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    place = [0] * len(children)
    lone = crowd = 1  # where the search for one slot, and for several, starts
    value[0] = values[0]
    queue = [0]
    for node in queue:
        kids = children[node]
        if not kids:
            continue
        first, own = min(kids), place[node]
        if len(kids) == 1:
            lone = taken.find(0, lone)
            offset = taken.find(0, max(lone, first)) - first
        else:
            at, tries = taken.find(0, max(crowd, first)), 0
            while any(taken[at - first + b] for b in kids):
                at, tries = taken.find(0, at + 1), tries + 1
            if tries > 64:
                crowd = at
            offset = at - first
        if offset + 1024 > len(taken):
            taken += bytearray(size)
            base, check, value = (np.append(a, np.full(size, fill, np.int32)) for a, fill in ((base, 0), (check, -1), (value, -1)))
        base[own] = offset
        for b, kid in kids.items():
            taken[offset + b] = 1
            check[offset + b] = own
            value[offset + b] = values[kid]
            place[kid] = offset + b
            queue.append(kid)
    return Trie(np.append(base, np.zeros(256, np.int32)), np.append(check, np.full(256, -1, np.int32)), np.append(value, np.full(256, -1, np.int32)))


class Codec:
    """Encoder and decoder of one vocabulary; a bundle of arrays that workers get."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.prefix, self.squeeze = v.prefix, v.squeeze
        self.scores = log_scores(v)
        usable = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER)]
        self.trie = build_trie({v.pieces[i].replace(MARK, " ").encode(): i for i in usable})
        self.unknown = int(np.flatnonzero(v.kinds == UNKNOWN)[0]) if (v.kinds == UNKNOWN).any() else 0
        self.unknown_score = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(v.kinds == BYTE):
            self.byte_ids[int(v.pieces[i][3:5], 16)] = i
        self.fallback = bool((self.byte_ids >= 0).all())
        long = [v.pieces[i] for i in usable if len(v.pieces[i]) > 1]
        self.cut_at_space = not any(MARK in p.lstrip(MARK) for p in long)
        #: No piece holds a line break with anything else, so texts are cut there too.
        self.cut_at_line = not any("\n" in p for p in long)
        raw = []
        for i, p in enumerate(v.pieces):
            k = v.kinds[i]
            raw.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_ends = np.append(0, np.cumsum([len(x) for x in raw]))

    # ------------------------------------------------------------ encoding

    def escaped(self, texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(texts.cast(pa.string()), MARK, " ")
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " {2,}", " "), " ")
        if not self.prefix:
            return texts
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.zeros(len(raw) + 1, bool)
        begin[offsets] = True
        if self.cut_at_space and len(raw):
            space = raw == 32
            begin[1:-1] |= space[1:] & ~space[:-1]
        if self.cut_at_line and len(raw):
            line = raw == 10
            begin[:-1] |= line
            begin[1:] |= line
        at = np.flatnonzero(begin)
        return at[:-1], at[1:]

    def _one(self, data: bytes) -> np.ndarray:
        """Segmentation of a single long stretch."""
        base, check, value, scores = self._lists()
        n = len(data)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = min(1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, n - at)
            if best[at] > float("-inf"):
                node, single, own = 0, False, best[at]
                for k in range(at, n):
                    nxt = base[node] + data[k]
                    if check[nxt] != node:
                        break
                    node = nxt
                    if (p := value[node]) >= 0:
                        single |= k + 1 - at == width
                        if own + scores[p] > best[k + 1]:
                            best[k + 1], back[k + 1], piece[k + 1] = own + scores[p], at, p
                if not single and own + self.unknown_score > best[at + width]:
                    best[at + width], back[at + width], piece[at + width] = own + self.unknown_score, at, -1
            at += width
        out, at = [], n
        while at > 0:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [int(self.byte_ids[b]) for b in reversed(data[back[at] : at])] if self.fallback else [self.unknown]
            at = back[at]
        return np.array(out[::-1], np.int32)

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        return self._as_lists

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_as_lists"}

    def _many(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches one after the other, how many each has); all advance together."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(start)
        edge = np.append(0, np.cumsum(size + 1))  # cells of stretch i: edge[i] .. edge[i] + size[i]
        best = np.full(edge[-1], -np.inf)
        back, piece = np.zeros(edge[-1], np.int32), np.full(edge[-1], -1, np.int32)
        best[edge[:-1]] = 0.0
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        for p in range(int(sizes[0]) if n else 0):
            live = order[: np.searchsorted(-sizes, -p, side="left")]
            live = live[best[edge[live] + p] > -np.inf]
            if not len(live):
                continue
            lead = raw[start[live] + p]
            width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            width = np.minimum(width, size[live] - p)
            own = best[edge[live] + p]
            single = np.zeros(len(live), bool)
            node, who = np.zeros(len(live), np.int32), np.arange(len(live))
            k = 0
            while len(who):
                nxt = base[node] + raw[start[live[who]] + p + k]
                ok = check[nxt] == node
                node, who = nxt[ok], who[ok]
                k += 1
                got = value[node]
                hit = np.flatnonzero(got >= 0)
                if len(hit):
                    w = who[hit]
                    cell, score = edge[live[w]] + p + k, own[w] + self.scores[got[hit]]
                    single[w] |= k == width[w]
                    up = score > best[cell]
                    best[cell[up]], back[cell[up]], piece[cell[up]] = score[up], p, got[hit][up]
                more = p + k < size[live[who]]
                node, who = node[more], who[more]
            lone = np.flatnonzero(~single)
            if len(lone):
                cell, score = edge[live[lone]] + p + width[lone], own[lone] + self.unknown_score
                up = score > best[cell]
                best[cell[up]], back[cell[up]], piece[cell[up]] = score[up], p, -1
        steps_who, steps_id, steps_at = [], [], []
        who, at = np.arange(n), size.copy()
        while len(who):  # from the last piece to the first
            cell = edge[who] + at
            p, prev = piece[cell], back[cell]
            known = p >= 0
            steps_who.append(who[known]), steps_id.append(p[known]), steps_at.append(at[known])
            for x in np.flatnonzero(~known):
                lo, hi = start[who[x]] + prev[x], start[who[x]] + at[x]
                own = self.byte_ids[raw[lo:hi]] if self.fallback else np.array([self.unknown], np.int32)
                steps_who.append(np.full(len(own), who[x])), steps_id.append(own), steps_at.append(prev[x] + 1 + np.arange(len(own)))
            at = prev.astype(np.int64)
            left = at > 0
            who, at = who[left], at[left]
        who = np.concatenate(steps_who) if steps_who else np.zeros(0, np.int64)
        ids = np.concatenate(steps_id) if steps_id else np.zeros(0, np.int32)
        at = np.concatenate(steps_at) if steps_at else np.zeros(0, np.int64)
        return ids[np.argsort(edge[who] + at, kind="stable")], np.bincount(who, minlength=n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets)."""
        raw, offsets = buffer_of(self.escaped(texts))
        start, end = self._units(raw, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        full = end > start
        start, end = start[full], end[full]
        h = span_hashes(raw, start, end)
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]
        size = end[one] - start[one]
        short = np.flatnonzero(size <= LONG)
        ids, many = self._many(raw, start[one[short]], size[short])
        count = np.zeros(len(one), np.int64)
        count[short] = many
        at = np.zeros(len(one), np.int64)
        at[short] = np.append(0, np.cumsum(many))[:-1]
        parts, total = [ids], len(ids)
        for x in np.flatnonzero(size > LONG):
            own = self._one(raw[start[one[x]] : end[one[x]]].tobytes())
            parts.append(own)
            count[x], at[x] = len(own), total
            total += len(own)
        ids = np.concatenate(parts)
        k = count[kind]
        edge = np.append(0, np.cumsum(k))
        out = ids[np.repeat(at[kind] - edge[:-1], k) + np.arange(edge[-1])]
        doc = np.searchsorted(offsets, start, side="right") - 1
        per_doc = np.bincount(doc, k, len(texts)).astype(np.int64)
        out_offsets = np.append(0, np.cumsum(per_doc))
        if not self.fallback and len(out):  # neighbouring unknown characters are one piece
            first = np.zeros(len(out) + 1, bool)
            first[out_offsets] = True
            keep = (out != self.unknown) | np.append(True, out[:-1] != self.unknown) | first[:-1]
            out_offsets = np.append(0, np.cumsum(keep))[out_offsets]
            out = out[keep]
        return out, out_offsets

    # ------------------------------------------------------------ decoding

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets; the marker before the text is dropped."""
        lo, size = self.piece_ends[ids], self.piece_ends[ids + 1] - self.piece_ends[ids]
        edge = np.append(0, np.cumsum(size))
        raw = self.piece_bytes[np.repeat(lo - edge[:-1], size) + np.arange(edge[-1])]
        ends = edge[offsets]
        if self.prefix and len(raw):
            full = ends[1:] > ends[:-1]
            head = ends[:-1][full]
            drop = head[raw[head] == 32]
            keep = np.ones(len(raw) + 1, bool)
            keep[drop] = False
            raw = raw[keep[:-1]]
            ends = np.append(0, np.cumsum(keep[:-1]))[ends]
        return raw, ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        raw, ends = self.decode_bytes(ids, offsets)
        data = raw.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip) of every row.

    A null or empty text has no pieces.  round_trip: decoding gives the text back (as escaped: a
    marker character in the text reads as a space).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(path)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec, texts = shared.value, part.column("text")
        ids, offsets = codec.encode(texts)
        raw, ends = codec.decode_bytes(ids, offsets)
        want, edges = buffer_of(codec.escaped(texts))
        lead = int(codec.prefix)
        data, whole = raw.tobytes(), want.tobytes()
        same = [data[a:b] == whole[min(c + lead, d) : d] for a, b, c, d in zip(ends[:-1], ends[1:], edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), _lists(ids, offsets), pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "round_trip"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = DEFAULT_PATH, ids_col: str = "piece_ids") -> DataFrame:
    """(doc_id, text) of rows with a doc_id and a list of piece ids; a null list gives a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(path)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = pa.array(shared.value.decode(ids, np.append(0, np.cumsum(size))), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document encoded, with a check that decoding gives it back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
