"""Personal data: generators with high recall propose spans, boosted trees and thresholds choose.

Four base kinds (email, ip, card, phone) are found by fixed rules and always kept.  Generators
propose further, possibly overlapping candidates: written-out addresses, phone numbers without a
plus, card numbers in other groupings, IPv6 addresses, bank accounts, social security numbers.
Boosted trees score a candidate from its format and its context; each kind has a threshold,
calibrated on held-out examples to a target precision.  Candidates over the threshold are added
from the best down, unless they overlap a span that is already there.

No table of labelled spans exists, so the trees are fitted on generated examples: true items and
look-alikes (versions, prices, times, order numbers, hashes) set in filler text.  The
examples are a fixed number of rows drawn from a fixed seed.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .text import bounded_batches, id_and_text, over_slices, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, m.end(), "email"))
                done = m.end()
        at = text.find("@", at + 1)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The base kinds: leftmost non-overlapping matches of each kind; matches that fail the kind's test are dropped."""
    found = _emails(text)
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- candidates

_SPELLED = re.compile(r"[a-z0-9._%+-]{1,64}\s{0,2}(?:\(at\)|\[at\]|\{at\}|\bat\b|@)\s{0,2}[a-z0-9-]{1,63}(?:\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b|\.)\s{0,2}[a-z0-9-]{1,24}){1,4}", re.I | re.A)
#: Where a written-out address is looked for: a marked `at` or `dot`, a bare `dot`, an `@` apart, an `at` before a domain.
_MARKS = re.compile(r"[(\[{](?:at|dot)[)\]}]|\sdot\s|\s@\s|\bat\s{1,2}(?=[a-z0-9-]+\.[a-z])", re.I | re.A)
GENERATORS: tuple[tuple[str, re.Pattern], ...] = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])00[0-9][0-9 ().-]{7,20}[0-9](?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{10,11}(?![0-9A-Za-z.-])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2,3}(?:[ ._/-]{1,2}[0-9]{1,3})?(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:.])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![0-9A-Za-z])")),
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) proposals; generator -1 is the written-out address."""
    found = []
    done = 0
    for m in _MARKS.finditer(text):
        if m.start() < done:
            continue
        lo = max(0, m.start() - 100)
        if s := next((x for x in _SPELLED.finditer(text, lo, min(len(text), m.end() + 160)) if x.end() > m.start()), None):
            found.append((s.start(), s.end(), -1))
            done = s.end()
    for i, (_, pattern) in enumerate(GENERATORS):
        found += [(m.start(), m.end(), i) for m in pattern.finditer(text)]
    return found


#: Words that tell what a number is, by kind; the last group speaks against personal data.
CONTEXT = (
    ("mail", "e-mail", "contact", "write", "reach"),
    ("tel", "phone", "call", "mobile", "fax", "cell", "sms", "whatsapp", "dial"),
    ("card", "visa", "master", "amex", "credit", "debit", "payment", "cvv", "exp"),
    ("ssn", "social", "security", "tax"),
    ("ip", "host", "server", "address", "client", "login", "ipv6"),
    ("iban", "account", "bank", "swift", "bic", "konto", "compte", "cuenta"),
    ("version", "release", "build", "price", "order", "invoice", "serial", "isbn", "date", "time", "page", "code", "id", "ticket", "section", "hash", "sku"),
)
_WORDS = re.compile(r"[a-z0-9-]+")
N_FEATURES = 24 + len(CONTEXT)


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format and context features of a candidate."""
    own = text[start:end]
    d = digits_of(own)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = set(_WORDS.findall(before.lower()))
    groups = re.findall(r"[0-9]+", own)
    kind = "email" if generator < 0 else GENERATORS[generator][0]
    row = [
        float(generator), float(KINDS.index(kind)), float(len(own)), float(len(d)), float(sum(c.isalpha() for c in own)),
        float(own.count(" ")), float(own.count("-")), float(own.count(".")), float(own.count(":")), float(own.count("(")),
        float(len(groups)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0), float(max(map(len, groups), default=0)),
        float(luhn(d)) if d else 0.0, float(d[:1] or -1), float(len(set(d))), float(kind == "iban" and _iban(own)),
        float(own.lower().count("at)") + own.lower().count("at]") + own.lower().count("dot")), float("::" in own),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "#$€=/_"), float(after[:1] in "%$€/_"),
    ]
    return row + [float(any(w in near for w in words)) for words in CONTEXT]


# ---------------------------------------------------------------- the model

@dataclass
class Model:
    trees: boosting.Forest
    thresholds: tuple[float, ...]  # by kind


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans that are personal data in them."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban() -> str:
        land, body = r.choice(("DE", "FR", "ES", "GB")), num(18)
        rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{98 - rest:02d}{body}"
        return grouped(s, " ") if r.random() < 0.5 else s

    at, dot = (lambda: r.choice(("(at)", "[at]", " at ", " (at) ", " [at] "))), (lambda: r.choice(("(dot)", "[dot]", " dot ", " [dot] ")))
    true: list[Callable[[], tuple[str, str]]] = [
        lambda: (r.choice(("mail", "contact", "write to", "", "e-mail:")), f"{word()}{at()}{word()}{dot()}{r.choice(('com', 'org', 'net', 'de'))}"),
        lambda: (r.choice(("mail", "contact", "write to", "e-mail:", "reach")), f"{word()}{r.choice((' at ', ' AT ', ' @ ', ' (AT) '))}{word()}.{r.choice(('com', 'org', 'net', 'de'))}"),
        lambda: (r.choice(("tel", "phone", "call", "mobile:", "", "fax")), r.choice((lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0{num(2)} {num(3)} {num(4)}"))()),
        lambda: (r.choice(("tel", "phone", "call")), num(10)),
        lambda: (r.choice(("tel", "phone", "call", "")), f"00{r.choice('134')}{num(1)} {num(3)} {num(3)} {num(3)}"),
        lambda: (r.choice(("card", "visa", "payment", "", "credit card")), grouped(card(), r.choice((" ", "-", ".", "/", "  ")))),
        lambda: (r.choice(("ssn", "social security", "ssn:", "")), f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        lambda: (r.choice(("ip", "server", "host", "ipv6 address", "")), ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))),
        lambda: (r.choice(("ip", "host", "")), f"2001:db8:{r.choice('123456789')}{num(2)}::{r.choice('abcdef')}{num(2)}"),
        lambda: (r.choice(("iban", "account", "bank", "")), iban()),
    ]
    false: list[Callable[[], tuple[str, str]]] = [
        lambda: (r.choice(("version", "release", "build")), f"{num(1)}.{num(2)}.{num(3)}"),
        lambda: (r.choice(("order", "invoice", "serial", "id", "code", "ticket", "")), num(r.randint(10, 19))),
        lambda: (r.choice(("order", "isbn", "sku", "code", "serial")), f"{num(3)}-{num(3)}-{num(4)}"),
        lambda: (r.choice(("order", "serial", "id", "", "sku")), grouped(num(16), r.choice((" ", "-", ".")))),
        lambda: (r.choice(("time", "date", "", "at")), f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{num(2)}"),
        lambda: (r.choice(("date", "from", "")), f"20{num(2)} {num(4)} {num(4)}"),
        lambda: (r.choice(("price", "sum", "section", "page", "")), f"{num(3)} {num(3)} {num(3)}"),
        lambda: (r.choice(("code", "serial", "hash", "")), f"{r.choice('ABCDEF')}{r.choice('GHKLM')}{num(2)}{''.join(r.choice('ABCDEFGH0123456789') for _ in range(r.randint(8, 20)))}"),
        lambda: (r.choice(("meet", "look", "stay", "")), f"{word()} at {word()} dot {word()}"),
        lambda: (r.choice(("meet", "we", "shop", "")), f"{r.choice(('look', 'stay', 'more', word()))} at {word()}.{r.choice(('com', 'org', 'net', 'de'))}"),
        lambda: (r.choice(("order", "code", "sku")), f"{r.randint(100, 999)}-{num(2)}-{num(4)}"),
        lambda: ("", f"{num(10)}"),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(2, 12))) + " ", []
        for _ in range(r.randint(1, 3)):
            real = r.random() < 0.5
            lead, item = r.choice(true if real else false)()
            text += lead + " " * bool(lead)
            if real:
                spans.append((len(text), len(text) + len(item)))
            text += item + r.choice((" ", ". ", ", ", "\n")) + " ".join(word() for _ in range(r.randint(2, 8))) + " "
        out.append((text, spans))
    return out


#: Generated texts for fitting and for calibration.
FIT_TEXTS, CALIBRATION_TEXTS = 3000, 1500


@lru_cache(maxsize=4)
def fit(precision: float = 0.95, seed: int = 7) -> Model:
    """Fit on generated texts; a kind's threshold is the least score from which `precision` holds on other texts."""

    def table(n: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = [], []
        for text, spans in examples(n, s):
            for a, b, g in candidates(text):
                x.append(describe(text, a, b, g))
                y.append(any(min(b, e) - max(a, f) >= 0.8 * max(b - a, e - f) for f, e in spans))
        return np.array(x), np.array(y, float)

    x, y = table(FIT_TEXTS, seed)
    trees = boosting.fit(x, y, trees=60, depth=4, rate=0.2, least=2.0)
    x, y = table(CALIBRATION_TEXTS, seed + 1)
    p, kind = trees.probability(x), x[:, 1].astype(int)
    cuts = []
    for k in range(len(KINDS)):
        own, good = p[kind == k], y[kind == k]
        order = np.argsort(-own)
        share = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(share >= precision)
        cuts.append(float(own[order][ok[-1]]) if len(ok) else 1.1)
    return Model(trees, tuple(max(c, 0.5) for c in cuts))


class _Disjoint:
    """Intervals without overlaps, in order; those given at first are joined where they overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a), self.ends.insert(i, b)


def spans_of(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both ordered by start and kind."""
    base = [base_spans(t) for t in texts]
    proposed, rows = [], []
    for i, t in enumerate(texts):
        if found := candidates(t):
            taken = _Disjoint(sorted((a, b) for a, b, _ in base[i]))
            for a, b, g in found:
                if taken.free(a, b):
                    proposed.append((i, a, b, g))
                    rows.append(describe(t, a, b, g))
    extra: dict[int, list[Span]] = {}
    held: dict[int, _Disjoint] = {}
    if rows:
        p = model.trees.probability(np.array(rows))
        for x in np.argsort(-p, kind="stable"):  # of overlapping proposals the likeliest; of equals the first generator's
            i, a, b, g = proposed[x]
            kind = "email" if g < 0 else GENERATORS[g][0]
            if p[x] >= model.thresholds[KINDS.index(kind)] and held.setdefault(i, _Disjoint([])).free(a, b):
                held[i].add(a, b)
                extra.setdefault(i, []).append((a, b, kind))
    in_order = lambda x: sorted(x, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return [(in_order(own), in_order(own + extra.get(i, []))) for i, own in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and hash are of the base spans; `spans` has all of them, as kind:start:end in code
    points.  A null or empty text has none.  Rows that repeat an id or a text are each reported.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        got = spans_of(part.column("text").to_pylist(), shared.value)
        counts = [pa.array([sum(s[2] == k for s in b) for b, _ in got], pa.int64()) for k in BASE]
        sha = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([written(s) for _, s in got], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return id_and_text(docs).mapInArrow(over_slices(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with every span in the text replaced by its kind in brackets; n_chars, if there, is counted anew.

    A null text stays null; overlapping spans are replaced as one.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                got = spans_of([t or "" for t in texts], shared.value)
                fresh = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, got, strict=True)]
                out = part.set_column(at, part.schema.field(at), pa.array(fresh, part.schema.field(at).type))
                if (n := out.schema.get_field_index("n_chars")) >= 0:
                    field = out.schema.field(n)
                    old = out.column(n).to_pylist()
                    out = out.set_column(n, field, pa.array([o if t is None else len(t) for t, o in zip(fresh, old, strict=True)], field.type))
                yield out

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
