"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans the patterns miss.

The base finds e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers by fixed patterns;
these spans always stay. The field works on regions around digits and at-signs: a region is cut into atoms (words,
numbers, single marks), every run of at most MAX_ATOMS atoms is a candidate segment, and features of the whole span
(its digits, checksum, shape, neighbours, words before it) score it as each kind. Dynamic programming over the atoms
chooses boundaries and kinds together: the best way to cut the region into outside atoms and bounded entity segments.
Spans that do not touch a base span are added, such as phone numbers without a plus or spelled-out e-mail addresses.

Weights maximise the conditional likelihood (forward-backward over segments) by gradient steps in numpy, on windows made
from the base spans of a bounded sample of documents, with and without their plus signs, at-signs and the like, and on
generated windows of look-alikes (dates, versions, serial numbers) that hold no personal data.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive, and the added spans never
overlap base spans or each other. Equal texts get equal rows, repeated rows are repeated, and an empty table gives an empty
table. Of cuts that score the same, atoms stay outside, else the segment that begins first is taken; of kinds the first. Regions have no
bound, so very long texts lose nothing: the programme goes over the whole of one, with the features of the segments of
MAX_REGION atoms in memory at a time. What bounds a segment are its kinds: MAX_ATOMS atoms, one line, and, but for e-mail
addresses, MAX_DIGITS digits, which no card or phone number has. Training windows are those of under WINDOW characters, of
SAMPLE documents at most. Only id and text are read by `find`; `mask` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, sliced

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin only where a run of digits does: an earlier start in the run would match as well.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Tokens around which a region lies.
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
ATOM = re.compile(r"\s+|[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-zÀ-ɏ0-9]")
MAX_ATOMS, MAX_REGION, CONTEXT = 20, 400, 3
MAX_DIGITS = 24
#: Documents that training takes windows from, at most; characters of a window.
SAMPLE, WINDOW = 1000, 200
CUES = {"phone": re.compile(r"(?:phone|tel|call|mobile|fax|cell|telefon|téléphone|teléfono)\W*$", re.I), "card": re.compile(r"(?:card|visa|mastercard|amex|karte|carte|tarjeta)\W*$", re.I), "email": re.compile(r"(?:mail|contact|correo|write to)\W*$", re.I), "ip": re.compile(r"(?:ip|host|server|address)\W*$", re.I)}
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:[\[(]\s?at\s?[\])]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:[\[(]\s?dot\s?[\])]|\sdot\s|\.)\s?[A-Za-z0-9-]+)+", re.I)
PHONE_SHAPE = re.compile(r"\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)\s?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}")
NUMBERS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
N_FEATURES = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    at = text.find("@")
    free = 0  # where the next local part may begin
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of white-space tokens around triggers, with CONTEXT tokens on each side."""
    last = None
    for m in TRIGGER.finditer(text):
        if last is not None and m.start() < last[1]:
            continue
        a, b = m.start(), m.end()
        for _ in range(CONTEXT + 1):
            while a > 0 and text[a - 1].isspace():
                a -= 1
            while a > 0 and not text[a - 1].isspace():
                a -= 1
        for _ in range(CONTEXT + 1):
            while b < len(text) and not text[b].isspace():
                b += 1
            if _ < CONTEXT:
                while b < len(text) and text[b].isspace():
                    b += 1
        if last is not None and a <= last[1]:
            last = (last[0], max(last[1], b))
        else:
            if last is not None:
                yield last
            last = (a, b)
    if last is not None:
        yield last


def atoms(text: str, a: int, b: int) -> list[int]:
    """Where the atoms of a region begin, and its end."""
    return [a + m.start() for m in ATOM.finditer(text[a:b])] + [b]


def lattice(text: str, bounds: list[int]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """(candidate segments as atom numbers, their features) between atom bounds, by start: those of MAX_REGION starts at a time."""
    n = len(bounds) - 1
    for i in range(0, n, MAX_REGION):
        segments, rows = [], []
        for s in range(i, min(i + MAX_REGION, n)):
            first = text[bounds[s]]
            if first.isspace() or not (first.isalnum() or first in "+(_"):
                continue
            digits, at = 0, False
            for e in range(s + 1, min(s + MAX_ATOMS, n) + 1):
                piece = text[bounds[e - 1] : bounds[e]]
                if "\n" in piece or digits > MAX_DIGITS and not at:
                    break
                digits += len(piece) if "0" <= piece[0] <= "9" else 0
                at = at or piece == "@" or piece.lower() == "at"
                if not (at or digits >= 4) or not piece[-1].isalnum():
                    continue
                if (f := describe(text, bounds[s], bounds[e])) is not None:
                    segments.append((s, e))
                    rows.append(f)
        yield segments, np.array(rows, float).reshape(len(rows), N_FEATURES)


def describe(text: str, a: int, b: int) -> list[float] | None:
    """The features of a span as a whole; None if it has the form of nothing."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    email, spelled = bool(EMAIL_SHAPE.fullmatch(span)), bool(SPELLED.fullmatch(span))
    address = bool(IP.fullmatch(span))
    numbers, phone = bool(NUMBERS.fullmatch(span)), bool(PHONE_SHAPE.fullmatch(span))
    plus = span[0] == "+"
    if not (email or spelled or address or phone or (numbers and n >= 6) or (plus and n >= 6)):
        return None
    before = text[max(0, a - 24) : a]
    left, right = text[a - 1 : a], text[b : b + 1]
    return [
        1.0, n == 0, 1 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19, 12 <= n <= 19 and luhn(digits), plus, email, spelled and not email,
        address and all(int(p) <= 255 for p in span.split(".") if len(p) < 10), address, numbers, phone, any(c.isalpha() for c in span),
        left.isalnum() or left in ("+", "(", ".", "-", "_", "@", "/", ":", "#") and left != "", right.isalnum() or (right in (".", "-", "/", "@", "_", ":") and text[b + 1 : b + 2].isalnum()),
        bool(CUES["phone"].search(before)), bool(CUES["card"].search(before)), bool(CUES["email"].search(before)), bool(CUES["ip"].search(before)), left in ("\"", "'", "=") and left != "", len(span) / 20,
    ]


def best(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best cut of n atoms: (first atom, end, kind) of its entities. scores: by segment and kind; outside atoms score 0."""
    return best_of_parts(n, [(segments, scores)])


def best_of_parts(n: int, parts: Iterable[tuple[list[tuple[int, int]], np.ndarray]]) -> list[tuple[int, int, int]]:
    """As best; the segments come in parts, ordered by their first atoms."""
    value, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    done = 0  # up to here the values are final

    def finish(to: int) -> int:
        for e in range(done + 1, to + 1):
            if value[e - 1] >= value[e]:
                value[e], back[e] = value[e - 1], None
        return max(done, to)

    for segments, scores in parts:
        for (s, e), kind, score in zip(segments, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()) if segments else ():
            done = finish(s)
            if value[s] + score > value[e]:
                value[e], back[e] = value[s] + score, (s, e, kind)
    finish(n)
    out, e = [], n
    while e > 0:
        if back[e] is None:
            e -= 1
        else:
            out.append(back[e])
            e = back[e][0]
    return out[::-1]


def added_spans(text: str, weights: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that do not touch a base span."""
    out = []
    for a, b in regions(text):
        bounds = atoms(text, a, b)
        found = best_of_parts(len(bounds) - 1, ((segments, x @ weights) for segments, x in lattice(text, bounds)))
        out += [(bounds[s], k, bounds[e]) for s, e, k in found]
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    before = lambda b: bisect_left(starts, b)  # noqa: E731  base spans that begin before b
    return [(a, k, b) for a, k, b in out if not before(b) or reach[before(b) - 1] <= a]


def likelihood_gradient(n: int, segments: list[tuple[int, int]], x: np.ndarray, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Gradient of the log-likelihood of the gold cut: its features less the expected ones, by forward-backward."""
    scores = x @ weights
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for i, (s, e) in enumerate(segments):
        by_end.setdefault(e, []).append(i)
        by_start.setdefault(s, []).append(i)
    total = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for e in range(1, n + 1):
        forward[e] = np.logaddexp.reduce([forward[e - 1], *(forward[segments[i][0]] + total[i] for i in by_end.get(e, ()))])
    for s in range(n - 1, -1, -1):
        backward[s] = np.logaddexp.reduce([backward[s + 1], *(backward[segments[i][1]] + total[i] for i in by_start.get(s, ()))])
    starts, ends = np.array([s for s, _ in segments]), np.array([e for _, e in segments])
    p = np.exp(forward[starts][:, None] + scores + backward[ends][:, None] - forward[n])
    want = np.zeros_like(p)
    for i, seg in enumerate(segments):
        if seg in gold:
            want[i, gold[seg]] = 1
    return x.T @ (want - p)


def generated(rng: random.Random, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of personal data in several spellings, and of numbers that are none."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda k=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, k)))

    def card() -> str:
        digits = d(15)
        return digits + next(c for c in "0123456789" if luhn(digits + c))

    def made() -> tuple[str, int]:
        c = card()
        phone = (d(3), "555", d(4))
        byte = lambda: str(rng.randint(0, 255))
        return rng.choice([
            (f"{w()}.{d(2)}@{w()}.example.com", 0), (f"{w()}@{w()}.org", 0), (f"{w()} [at] {w()} [dot] com", 0), (f"{w()}(at){w()}.org", 0),
            (".".join(byte() for _ in range(4)), 1), (c, 2), (" ".join(c[i : i + 4] for i in range(0, 16, 4)), 2), ("-".join(c[i : i + 4] for i in range(0, 16, 4)), 2),
            ("+1 ({}) {}-{}".format(*phone), 3), ("({}) {}-{}".format(*phone), 3), ("{}-{}-{}".format(*phone), 3), ("+44 {} {} {}".format(*phone), 3), ("{}.{}.{}".format(*phone), 3),
            (f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", -1), (f"{rng.randint(0, 9)}.{rng.randint(300, 999)}.{d(3)}.{d(4)}", -1), (d(rng.randint(1, 11)), -1), (d(rng.randint(20, 30)), -1),
            ("".join(rng.choice("0123456789abcdef") for _ in range(40)), -1), (f"{d(1)}{w()}{d(3)}", -1), (f"${d(2)},{d(3)}.{d(2)}", -1), (f"{d(4)} {d(4)}", -1), (f"#{d(6)}", -1), (f"{d(2)}:{d(2)}:{d(2)}", -1),
            (c[:-1] + str((int(c[-1]) + rng.randint(1, 9)) % 10), -1), (f"@{w()}", -1), (f"{w()} at {w()}", -1),
        ])

    out = []
    for _ in range(n):
        text, spans = w() + " " + w() + " ", []
        for _ in range(rng.randint(1, 2)):
            value, kind = made()
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(value)))
            text += value + rng.choice([" ", ", ", ". "]) + w() + " " + w() + " "
        out.append((text, spans))
    return out


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights by feature and kind."""
    weights = np.zeros((N_FEATURES, len(KINDS)))
    weights[0] = -2.0
    ready = []
    for text, spans in windows:
        for bounds, segments, x in ((bounds, *part) for a, b in regions(text) for bounds in [atoms(text, a, b)] for part in lattice(text, bounds)):
            if segments:
                at = {(s, e): k for s, k, e in spans}
                gold = {seg: at[bounds[seg[0]], bounds[seg[1]]] for seg in segments if (bounds[seg[0]], bounds[seg[1]]) in at}
                ready.append((len(bounds) - 1, segments, x, gold))
    rng = random.Random(seed)
    mean = np.zeros_like(weights)
    steps = 0
    for epoch in range(epochs):
        rng.shuffle(ready)
        for n, segments, x, gold in ready:
            weights += rate / (1 + epoch) * (likelihood_gradient(n, segments, x, weights, gold) - decay * weights)
            if epoch >= epochs // 2:
                mean += weights
                steps += 1
    return mean / steps if steps else weights


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The field's weights: generated windows, and windows around base spans of a bounded sample of documents."""
    rows = bounded_batches(docs).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, windows, spans = [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(t)
                if base and (found := next(((a, b) for a, b in regions(t) if b - a < WINDOW and any(a <= s < b for s, _, _ in base)), None)):
                    a, b = found
                    hs.append(h)
                    windows.append(t[a:b])
                    spans.append([[s - a, k, e - a] for s, k, e in base if a <= s and e <= b])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(windows, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["h", "text", "spans"])

    got = rows.mapInArrow(run, "h long, text string, spans array<array<int>>").orderBy("h", "text").limit(sample).collect()
    windows = [(r.text, [tuple(s) for s in r.spans]) for r in got]
    return fit(generated(random.Random(17), 1500) + windows)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the field's."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, weights, base))


def find(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone: base spans, base_sha256, spans) of each row's whole text."""
    chosen = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    names = ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                rows = []
                for t in part.column(1).to_pylist():
                    base, spans = all_spans(t or "", weights)
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
                columns = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.int64())], names=names)

    return chosen.mapInArrow(run, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with personal data of the text masked; all columns stay, and a null text stays null."""
    i = bounded_batches(docs).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                texts = [t and masked(t, all_spans(t, weights)[1]) for t in part.column(i).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:i], pa.array(texts, pa.string()), *part.columns[i + 1 :]], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def findings(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
