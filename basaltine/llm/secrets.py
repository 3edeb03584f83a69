"""Secrets: fixed patterns, and weak parts of credentials that are linked within a scope.

Base kinds (assign, access, hex) are always reported.  Further parts (identifiers, random-looking
tokens, endpoints) are weak: each proves nothing alone.  An interval join links parts whose
intervals, widened by `reach` characters, meet inside one scope (a stretch without a blank line):
an identifier is reported if a secret is linked to it, a random-looking token if an identifier or
an endpoint is.  The join sorts the parts of a document by start and keeps a running maximum of
their ends, so the nearest part on either side is found exactly, nested and overlapping ones
included, and a document costs n log n in its parts, whatever their number.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import buffer_of, id_and_text, over_slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "secret")
REACH = 300
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_VALUE = re.compile(rb"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
IDENT_WORDS = (b"client_id", b"clientid", b"client-id", b"username", b"user_name", b"access_key", b"accesskeyid", b"key_id", b"account_id", b"account_name", b"login", b"tenant_id")
_IDENT = re.compile(rb"""["']? *[:=] *["']?([A-Za-z0-9@._+-]{3,})""")
_URL = re.compile(rb"[^\s\"'<>]{3,}")
HOST_WORDS = (b"endpoint", b"hostname", b"host", b"server", b"base_url", b"broker")
_HOST = re.compile(rb"""["']? *[:=] *["']?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?)""")

_UPPER_DIGIT = np.zeros(256, bool)
_UPPER_DIGIT[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = _UPPER_DIGIT.copy()
_TOKEN[list(b"abcdefghijklmnopqrstuvwxyz+/_=-")] = True
#: A weak token has 20 characters or more, upper and lower case letters and digits, and this entropy in bits a character.
LEAST_TOKEN, LEAST_ENTROPY = 20, 3.6

Span = tuple[int, int, str]


def _runs(marked: np.ndarray, cut: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least `least` marked bytes, not across the offsets in `cut`."""
    edge = np.zeros(len(marked) + 1, bool)
    edge[cut] = True
    before = np.append(False, marked[:-1]) & ~edge[:-1]
    after = np.append(marked[1:], False) & ~edge[1:]
    start, end = np.flatnonzero(marked & ~before), np.flatnonzero(marked & ~after) + 1
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def _finds(data: bytes, words: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """(start, end) of every occurrence of the words, by start and then the longer first."""
    found = []
    for w in words:
        at = data.find(w)
        while at >= 0:
            found.append((at, at + len(w)))
            at = data.find(w, at + 1)
    return sorted(found, key=lambda x: (x[0], -x[1]))


def _entropy(token: bytes) -> float:
    n = len(token)
    return -sum(c / n * log2(c / n) for c in Counter(token).values())


def _random_looking(token: bytes) -> bool:
    kinds = [any(65 <= b <= 90 for b in token), any(97 <= b <= 122 for b in token), sum(48 <= b <= 57 for b in token) >= 2]
    return all(kinds) and _entropy(token) >= LEAST_ENTROPY


class _Ends:
    """Sorted spans with, for each, which of those up to it reaches farthest."""

    def __init__(self, spans: list[Span]):
        self.spans = spans
        self.starts = np.array([s[0] for s in spans], np.int64)
        ends = np.array([s[1] for s in spans], np.int64)
        most = np.maximum.accumulate(ends) if spans else ends
        self.farthest = np.maximum.accumulate(np.where(ends == most, np.arange(len(spans)), 0)) if spans else ends

    def overlaps(self, s: Span) -> bool:
        i = int(np.searchsorted(self.starts, s[1])) - 1
        return i >= 0 and self.spans[self.farthest[i]][1] > s[0]

    def beside(self, s: Span) -> list[Span]:
        """Of the spans that start before `s` the one that ends last, and the first of the others."""
        i = int(np.searchsorted(self.starts, s[0]))
        return ([self.spans[self.farthest[i - 1]]] if i else []) + self.spans[i : i + 1]


class Slice:
    """Byte spans of all texts of a slice, in code points of their own text on demand."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = buffer_of(texts)
        self.data = self.raw.tobytes()
        self.lower = self.data.lower()  # ASCII letters only
        self.lead = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=self.lead[1:])

    def doc(self, at: int) -> int:
        return int(np.searchsorted(self.offsets, at, side="right")) - 1

    def base(self) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in range(len(self.offsets) - 1)]
        done = 0
        for start, end in _finds(self.lower, KEYWORDS):
            if start < done:
                continue
            d = self.doc(start)
            stop = int(self.offsets[d + 1])
            if end <= stop and (m := _VALUE.match(self.data, end, stop)):
                done = m.end()
                if m.end(1) - m.start(1) >= 8:
                    out[d].append((start, m.end(), "assign"))
        done, at = 0, self.data.find(b"AKIA")
        while at >= 0:
            if at >= done:
                d = self.doc(at)
                stop = int(self.offsets[d + 1])
                end = at
                while end < stop and _UPPER_DIGIT[self.raw[end]]:
                    end += 1
                if end - at > 4:
                    done = end
                    if end - at >= 16:
                        out[d].append((at, end, "access"))
            at = self.data.find(b"AKIA", at + 1)
        for a, b in _runs(_HEX[self.raw], self.offsets, 32):
            out[self.doc(a)].append((a, b, "hex"))
        return out

    def weak(self) -> dict[int, list[Span]]:
        """Weak parts by text: ident, secret, endpoint."""
        out: dict[int, list[Span]] = {}

        def add(start: int, end: int, kind: str) -> None:
            out.setdefault(self.doc(start), []).append((start, end, kind))

        for a, b in _runs(_TOKEN[self.raw], self.offsets, LEAST_TOKEN):
            if _random_looking(self.data[a:b]):
                add(a, b, "secret")
        for words, pattern, kind in ((IDENT_WORDS, _IDENT, "ident"), (HOST_WORDS, _HOST, "endpoint")):
            done = 0
            for start, end in _finds(self.lower, words):
                stop = int(self.offsets[self.doc(start) + 1])
                if start >= done and end <= stop and (m := pattern.match(self.data, end, stop)):
                    add(m.start(1), m.end(1), kind)
                    done = m.end()
        done, at = 0, self.data.find(b"://")
        while at >= 0:
            d = self.doc(at)
            lo, stop = int(self.offsets[d]), int(self.offsets[d + 1])
            start = at
            while start > lo and at - start < 12 and chr(self.raw[start - 1]).isascii() and chr(self.raw[start - 1]).isalnum():
                start -= 1
            first = at + 3
            if first >= done and (m := _URL.match(self.data, first, stop)):
                done = m.end()  # of all addresses in this run
            if start < at and done - first >= 3:
                add(start, done, "endpoint")
                slash = self.data.find(b"/", first, done)
                who, sep, _ = self.data[first : slash if slash >= 0 else done].rpartition(b"@")
                if sep and b":" in who and len(who.partition(b":")[2]) >= 4:  # all three parts in one
                    name = who.index(b":")
                    add(first, first + name, "ident")
                    add(first + name + 1, first + len(who), "secret")
            at = self.data.find(b"://", at + 1)
        return out

    def linked(self, base: list[Span], weak: list[Span], reach: int = REACH) -> list[tuple[Span, Span]]:
        """For each weak identifier or secret that has a complement in its scope: itself and the nearest complement."""
        covered = _Ends(sorted(base))
        weak = [s for s in weak if s[2] == "endpoint" or not covered.overlaps(s)]
        parts = {
            "ident": _Ends(sorted([s for s in weak if s[2] == "ident"] + [s for s in base if s[2] == "access"])),
            "secret": _Ends(sorted([s for s in weak if s[2] == "secret"] + [s for s in base if s[2] != "access"])),
            "endpoint": _Ends(sorted(s for s in weak if s[2] == "endpoint")),
        }
        out = []
        for own in weak:
            near = None
            for other in {"ident": ("secret",), "secret": ("ident", "endpoint"), "endpoint": ()}[own[2]]:
                # of the parts on one side, the nearest has the fewest blank lines before it
                for s in parts[other].beside(own):
                    gap = max(s[0] - own[1], own[0] - s[1], 0)
                    if gap <= reach and (near is None or gap < near[0]) and b"\n\n" not in self.data[min(own[1], s[1]) : max(own[0], s[0])]:
                        near = (gap, s)
            if near:
                out.append((own, near[1]))
        return out

    def chars(self, d: int, span: Span) -> Span:
        first = self.lead[self.offsets[d]]
        return int(self.lead[span[0]] - first), int(self.lead[span[1]] - first), span[2]


def spans_of(texts: pa.Array, reach: int = REACH) -> list[tuple[list[Span], list[Span], list[tuple[Span, Span]]]]:
    """(base spans, all spans, links) of each text, in code points; spans by start, then kind."""
    own = Slice(texts)
    base, weak = own.base(), own.weak()
    out = []
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    for d, found in enumerate(base):
        links = own.linked(found, weak[d], reach) if d in weak else []
        extra = {a for a, _ in links}
        conv = lambda s, d=d: own.chars(d, s)
        out.append((sorted(map(conv, found), key=order), sorted(map(conv, [*found, *extra]), key=order), [(conv(a), conv(b)) for a, b in links]))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, links) of every row.

    Counts and hash are of the base spans; `spans` has all, `links` pairs each weak part with
    the nearest part that it was reported for.  A null or empty text has none.  Rows that repeat an
    id or a text are each reported; of two parts equally near the earlier is the link.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        got = spans_of(part.column("text"), reach)
        counts = [pa.array([sum(s[2] == k for s in b) for b, _, _ in got], pa.int64()) for k in BASE]
        sha = [hashlib.sha256(written(b).encode()).hexdigest() for b, _, _ in got]
        links = [";".join(written([a]) + "~" + written([b]) for a, b in x) for _, _, x in got]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([written(s) for _, s, _ in got], pa.string()), pa.array(links, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "links"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: secrets in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
