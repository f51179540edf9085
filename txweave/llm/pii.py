"""Personal data: strict patterns, and boosted trees over what generous generators propose.

The strict spans of the four base kinds always stay. Generators with high recall propose overlapping candidates: what
stands around an @, runs of digits with separators, dotted numbers, long strings of mixed letters and digits, of any
length. Boosted trees score them by format and context. They learn from the candidates of SAMPLE_ROWS documents at most,
chosen by a hash of the text: candidates that a strict pattern confirms, or a mixed string assigned to a word for
secrets, are positive, the others negative. What confirms a candidate is no feature: neither the checks of the patterns
nor the word before a secret, so the trees must find format and surroundings that go with it. Numbers that look like a
base kind but fail its check are nobody's example. The threshold is set on all documents that were not learnt from, by
counts of (score, label) over the whole table: the lowest score from which on the share of confirmed candidates, by its
lower confidence bound, reaches the wanted precision. If they are too few for that, the method adds nothing. Selected
candidates that meet a base span are dropped, the better of two that overlap stays.

Edge cases: null and empty texts have no spans; long texts are scanned whole in time proportional to their length;
positions are code points, ends exclusive; of candidates that tie the first, then the longer stays; repeated rows get
equal spans and count once in training; an empty table gives an empty result; other columns are ignored by `find` and
kept by `redact`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import slices
from txweave.llm.trees import Boosted, boost

#: Base kinds in their order; the method's own kinds follow.
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
#: Documents to learn from, and their candidates, at most.
SAMPLE_ROWS = 20_000
SAMPLE_CANDIDATES = 20_000
N_FEATURES = 18
BINS = 1000
PRECISION = 0.95
CONFIDENCE = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where its run of digits does: a later start in the run can match only if the first does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_HEXA = frozenset("0123456789abcdefABCDEF")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    free, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # A failed name may not be read again by a later @: names never span one.
        free = m.end() if m else at + 1
        at = t.find("@", free)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, in order; kind is an index of KINDS."""
    if not _TRIGGER.search(t):
        return []
    out = [(i, 0, j) for i, j in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- candidates -------------------------------------------------------------------------------------------------------

_AROUND = re.compile(r"[^\s@<>\"',;]++")
_NUMBER = re.compile(r"[+(]?[0-9]++(?:[ ().\-]{1,3}[0-9]++)*+")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++)++")
_MIXED = re.compile(r"[A-Za-z0-9_+/=-]{12,}")
#: Words that announce a secret, and words that announce a way to reach somebody.
SECRET_WORDS = re.compile(r"(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|key)[\"']?\s*[:=]\s*[\"']?$", re.I)
ASSIGNED = re.compile(r"[A-Za-z_]\s*[:=]\s*[\"']?$")
CONTACT_WORDS = re.compile(r"(?:mail|phone|tel|call|fax|mobile|contact|card|ssn|iban|ip)\W{0,3}$", re.I)


class Candidate(NamedTuple):
    start: int
    end: int
    kind: int
    features: list[float]
    label: int  # 1 confirmed, 0 not, -1 unknown


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in "\"'`" else 2 if c in "=:" else 3 if c == "+" else 4 if c.isalnum() else 5


def _candidate(t: str, start: int, end: int, generator: int, strict: set[tuple[int, int]], by_kind: dict[tuple[int, int], int]) -> Candidate:
    s = t[start:end]
    counts = Counter(s)  # runs may be long: the rest goes by distinct characters
    digits = sum(counts[c] for c in "0123456789")
    letters = sum(n for c, n in counts.items() if c.isalpha())
    runs = [len(r) for r in re.findall(r"[0-9]+", s)]
    groups = re.findall(r"[0-9]{1,4}", s)[:16]
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    before = t[max(0, start - 24) : start]
    secret, contact = bool(SECRET_WORDS.search(before)), bool(CONTACT_WORDS.search(before))
    hexa = counts.keys() <= _HEXA
    features = [
        len(s), digits, letters, sum(n for c, n in counts.items() if c.isupper()), len(s) - digits - letters, s.count("."), s.count("@"), max(runs, default=0),
        len(runs), hexa, len(counts), _side(t[start - 1 : start]), _side(t[end : end + 1]), 2 * bool(ASSIGNED.search(before)) + contact, s[0] == "+", entropy,
        sum(int(g) <= 255 for g in groups) / max(1, len(groups)), generator,
    ]
    kind = by_kind.get((start, end))
    if kind is None:
        kind = (0 if "@" in s else 5) if generator in (0, 1, 2) else 4
    mixed = generator == 3 and digits >= 3 and letters >= 3
    confirmed = (start, end) in strict or (secret and mixed and len(s) >= 16)
    # The right shape for a base kind, though its check fails: no label.
    shaped = not confirmed and (generator == 1 and 9 <= digits <= 19 or generator == 2 and s.count(".") == 3)
    return Candidate(start, end, kind, [float(f) for f in features], 1 if confirmed else -1 if shaped else 0)


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    """What the generators propose, overlaps included."""
    if not _TRIGGER.search(t):
        return []
    strict = {(i, j) for i, _, j in base}
    by_kind = {(i, j): k for i, k, j in base}
    found: dict[tuple[int, int], int] = {}
    if "@" in t:
        last = -1, -1
        for m in _AROUND.finditer(t):
            if last[1] > 0 and m.start() == last[1] + 1 and t[last[1]] == "@":
                found.setdefault((last[0], m.end() - (t[m.end() - 1] == "." and m.end() - m.start() > 1)), 0)
            last = m.span()
    for k, pattern in ((1, _NUMBER), (2, _DOTTED), (3, _MIXED)):
        for m in pattern.finditer(t):
            if (k != 3 or _DIGITS.search(m[0])) and m.end() > m.start() + 1:
                found.setdefault((m.start(), m.end()), k)
    for i, j in strict:
        found.setdefault((i, j), 0 if "@" in t[i:j] else 2 if t.count(".", i, j) == 3 else 1)
    return [_candidate(t, i, j, k, strict, by_kind) for (i, j), k in sorted(found.items())]


# --- the model --------------------------------------------------------------------------------------------------------


class Detector(NamedTuple):
    model: Boosted | None
    threshold: float

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, score) of each text's selected candidates that meet no base span and no better one."""
        if self.model is None:
            return [[] for _ in texts]
        free = []
        for t, own in zip(texts, base, strict=True):
            taken = _disjoint([(i, j) for i, _, j in own])
            free.append([c for c in candidates(t, own) if not _meets(taken, c.start, c.end)])
        every = [c.features for own in free for c in own]
        scores = iter(self.model.score(np.array(every)).tolist() if every else [])
        out = []
        for own in free:
            found: list[tuple[int, int, int, float]] = []
            chosen: list[tuple[int, int]] = []
            for s, c in sorted(((next(scores), c) for c in own), key=lambda x: (-x[0], x[1].start, -x[1].end)):
                if s >= self.threshold and not _meets(chosen, c.start, c.end):
                    found.append((c.start, c.kind, c.end, s))
                    insort(chosen, (c.start, c.end))
            out.append(sorted(found))
        return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap joined."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i < out[-1][1]:
            out[-1] = out[-1][0], max(j, out[-1][1])
        else:
            out.append((i, j))
    return out


def _meets(spans: list[tuple[int, int]], i: int, j: int) -> bool:
    """Does i..j overlap one of the sorted disjoint spans?"""
    k = bisect_left(spans, (j,))
    return k > 0 and spans[k - 1][1] > i


def lower_bound(hits: int, n: int, confidence: float = CONFIDENCE) -> float:
    """Lower confidence bound of a share, by Chernoff's inequality: n times the divergence of hits / n from it is at most
    -ln(1 - confidence)."""
    if not hits:
        return 0.0
    share, low, high = hits / n, 0.0, hits / n
    for _ in range(60):
        p = (low + high) / 2
        apart = share * math.log(share / max(p, 1e-300)) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0)
        low, high = (p, high) if n * apart > -math.log(1 - confidence) else (low, p)
    return low


def threshold(counts: list[tuple[int, int, int]], precision: float = PRECISION) -> float | None:
    """The lowest score from 0.5 on that is precise enough, from counts of (score in BINS, label, number)."""
    total = np.zeros((BINS + 1, 2), np.int64)
    for score, label, n in counts:
        total[score, label] += n
    above = total[::-1].cumsum(axis=0)[::-1]
    for score in range(BINS // 2, BINS + 1):
        misses, hits = (int(v) for v in above[score])
        if total[score].any() and lower_bound(hits, hits + misses) >= precision:
            return score / BINS
    return None


def _learnt(text: Column, share: float) -> Column:
    """Is the text one to learn from? Of every two texts one at most is."""
    return (F.pmod(F.xxhash64(text, F.lit(6)), F.lit(1 << 20)) < int(share * (1 << 20))) & (F.pmod(F.xxhash64(text, F.lit(7)), F.lit(2)) == 0)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_candidates: int = SAMPLE_CANDIDATES) -> Detector:
    """A detector: trees from the candidates of about `sample_rows` documents, `sample_candidates` at most, chosen by
    hash; the threshold from all other documents."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, h, c) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(candidates(t, base_spans(t))) if c.label >= 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for _, h, _ in rows], pa.int64()), pa.array([i for i, _, _ in rows], pa.int32()), pa.array([c.features for _, _, c in rows], pa.list_(pa.float64())), pa.array([c.label for _, _, c in rows], pa.int32())],
                ["h", "i", "x", "y"],
            )

    some = texts.where(_learnt(F.col("text"), share)).select("text", F.xxhash64("text", F.lit(66)).alias("h"))
    found = some.mapInArrow(learn, "h long, i int, x array<double>, y int").dropDuplicates(["h", "i"]).orderBy("h", "i").limit(sample_candidates).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, N_FEATURES)
    y = found.column("y").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Detector(None, 1.0)
    model = boost(x, y)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS + 1, 2), np.int64)
        for b in slices(batches):
            own = [c for t in b.column(0).to_pylist() for c in candidates(t, base_spans(t)) if c.label >= 0]
            if own:
                score = np.floor(model.score(np.array([c.features for c in own])) * BINS).astype(int)
                np.add.at(total, (score, [c.label for c in own]), 1)
        score, label = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(score.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(total[score, label])], ["score", "y", "n"])

    held = texts.where(~_learnt(F.col("text"), share)).mapInArrow(count, "score int, y int, n long").groupBy("score", "y").agg(F.sum("n").alias("n"))
    least = threshold([tuple(r) for r in held.collect()])  # 2 * (BINS + 1) rows at most
    return Detector(None, 1.0) if least is None else Detector(model, least)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
SPAN_SQL = "array<struct<start:bigint,kind:int,end:bigint>>"


def _struct(spans: list) -> list[dict]:
    return [{"start": s[0], "kind": s[1], "end": s[2]} for s in spans]


def find(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, base, added of each row: the strict spans and the method's, both by start; kind is an index of KINDS."""
    detector = detector or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = detector.added(texts, base)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(map(_struct, x), SPAN) for x in (base, added))], ["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {SPAN_SQL}, added {SPAN_SQL}")


def redacted(texts: list[str], detector: Detector) -> list[str]:
    """The texts with each span, overlapping ones joined, replaced by its kind in brackets."""
    base, done = [base_spans(t) for t in texts], []
    for t, own, more in zip(texts, base, detector.added(texts, base), strict=True):
        out, at, end = [], 0, 0
        for start, kind, stop, *_ in sorted([*own, *more]):
            if start >= end:
                out += [t[at:start], f"[{KINDS[kind].upper()}]"]
            at = end = max(end, stop)
        done.append("".join(out) + t[at:] if out else t)
    return done


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """`docs` with redacted texts; n_chars, if there, is the new length."""
    detector = detector or fit(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            old = b.column(at).to_pylist()
            texts = [None if t is None else r for t, r in zip(old, redacted([t or "" for t in old], detector), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(k).type) if k == at else b.column(k) for k in range(len(names))], names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
