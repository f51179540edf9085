"""A quality classifier that adds up lookup tables: a generalised additive model with pairwise interactions.

Features are counted from the text alone. Training takes turns over the features: in each round every feature gets one
shallow tree fitted to what is left of the log loss, and the tree is added to the feature's table of bins. Then the
pairs whose joint bins explain most of what is left get tables of their own, boosted in turns the same way. Scoring
looks a document's bins up in every table and adds: no tree is kept.

It learns from labelled documents outside the held-out part, a sample of SAMPLE_ROWS at most, chosen by hash.

Edge cases: null and empty texts have features of zero words and get a score like any other; long texts are counted
whole; values that tie fall in one bin, a score that ties with the threshold passes it; labels that contradict each
other for a doc_id are left out; without labels of both classes every score is the share of label 1 (0.5 without
any); repeated rows get equal scores; null doc_ids are scored and never learnt from; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import cut, slices
from txweave.llm.trees import bin_edges, grow, leaves, sigmoid, to_bins

SAMPLE_ROWS = 20_000
BINS = 64
PAIR_BINS = 12
PAIRS = 8
THRESHOLD = 0.7
FEATURES = [
    "log_words", "mean_word", "longest_word", "distinct_words", "distinct_triples", "top_word", "repeats_previous", "capital_words", "upper", "digits",
    "symbols", "shouts", "commas", "stops", "other_marks", "non_ascii", "lines", "dup_lines", "words_a_stop", "joined_marks",
]



def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


#: Byte classes counted by one product with the histogram of a text's bytes.
_CLASSES = np.stack(
    [_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!?"), _class(b",;:"), _class(b"."), _class(b"\"'()[]{}=+-_/\\@^~`"), _class(bytes(range(128, 256))), _class(b"\n"), _class(bytes(range(97, 123)))]
)


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    upper, digits, symbols, shouts, commas, stops, marks, high, lines, lower = (_CLASSES @ np.bincount(np.frombuffer(b, np.uint8), minlength=256)).tolist()
    size = sum(map(len, w))
    counts = Counter(w)
    triples = max(1, n - 2)
    rows = [x for x in b.split(b"\n") if x.strip()]
    capital = sum(map(_CAPITAL.__contains__, (x[0] for x in w)))
    ends = sum(map(_MARKS.__contains__, (x[-1] for x in w)))
    return [
        float(np.log1p(n)), size / n, float(max(map(len, w))), len(counts) / n, len(set(zip(w, w[1:], w[2:], strict=False))) / triples, max(counts.values()) / n,
        sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, capital / n, upper / max(1.0, upper + lower), digits / size, symbols / size, shouts / size, commas / n,
        stops / n, marks / size, high / size, lines / n, 1 - len(set(rows)) / max(1, len(rows)), min(100.0, n / max(1.0, stops)), ends / n,
    ]


_CAPITAL = frozenset(range(65, 91))
_MARKS = frozenset(b"#*$%&|<>!?")


class Gam(NamedTuple):
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    start: float
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair x bin x bin

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: one addition a table."""
        total = np.full(len(x), self.start)
        if not len(self.edges):
            return sigmoid(total)
        fine, coarse = to_bins(x, self.edges), to_bins(x, self.coarse)
        for k, table in enumerate(self.tables):
            total += table[fine[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[:, i], coarse[:, j]]
        return sigmoid(total)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 25, rate: float = 0.1, pairs: int = PAIRS) -> Gam:
    """Cyclic boosting of per-feature trees of four leaves, then of pair trees of four."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Gam([], [], float(np.log(share / (1 - share))), np.zeros((0, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    edges, coarse = bin_edges(x, BINS), bin_edges(x, PAIR_BINS)
    fine, rough = to_bins(x, edges), to_bins(x, coarse)
    start = float(np.log(share / (1 - share)))
    at = np.full(n, start)
    k = x.shape[1]
    tables = np.zeros((k, BINS))
    every = np.arange(BINS)[:, None]
    least = max(2.0, n / 1000)
    for _ in range(rounds):
        for f in range(k):
            p = sigmoid(at)
            tree = grow(fine[:, f : f + 1], p - y, p * (1 - p), 2, BINS, [0], rate, least=least * 0.1)
            step = tree.value[leaves(tree, every)]
            tables[f] += step
            at += step[fine[:, f]]
    chosen = _strongest(rough, sigmoid(at) - y, sigmoid(at) * (1 - sigmoid(at)), pairs)
    pair_tables = np.zeros((len(chosen), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for q, (i, j) in enumerate(chosen):
            p = sigmoid(at)
            step = _quadrants(rough[:, i], rough[:, j], p - y, p * (1 - p), rate)
            pair_tables[q] += step
            at += step[rough[:, i], rough[:, j]]
    return Gam(edges, coarse, start, tables, chosen, pair_tables)


def _quadrants(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, ridge: float = 1.0) -> np.ndarray:
    """The table of the tree of four leaves that cuts each of two features once, best over all pairs of cuts.

    Both cuts are chosen together, so a pair is found even where neither feature tells anything alone."""
    at, size = a * PAIR_BINS + b, (PAIR_BINS, PAIR_BINS)
    corner = [np.bincount(at, x, PAIR_BINS * PAIR_BINS).reshape(size).cumsum(0).cumsum(1) for x in (g, h)]

    def leaves_of(c: np.ndarray) -> np.ndarray:
        low, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([low, row - low, column - low, c[-1, -1] - row - column + low])

    grad, hess = map(leaves_of, corner)
    gain = (grad**2 / (hess + ridge)).sum(axis=0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = -rate * grad[:, i, j] / (hess[:, i, j] + ridge)
    right, upper = np.arange(PAIR_BINS)[:, None] > i, np.arange(PAIR_BINS)[None, :] > j
    return value[2 * right + upper]


def _strongest(rough: np.ndarray, g: np.ndarray, h: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The pairs whose joint bins explain most beyond what their single bins do."""
    size = PAIR_BINS * PAIR_BINS

    def gain(at: np.ndarray, bins: int) -> float:
        return float((np.bincount(at, g, bins) ** 2 / (np.bincount(at, h, bins) + 5.0)).sum())

    single = [gain(rough[:, f], PAIR_BINS) for f in range(rough.shape[1])]
    found = [(gain(rough[:, i] * PAIR_BINS + rough[:, j], size) - single[i] - single[j], i, j) for i, j in combinations(range(rough.shape[1]), 2)]
    return [(i, j) for s, i, j in sorted(found, reverse=True)[:most] if s > 0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (the features) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """A model from the rows of `measured` whose doc_id has one label and is not held out, `sample_rows` at most."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = rows.where(~held_out(F.col("doc_id"))).join(agreed, "doc_id")
    known = cut(known.select(F.xxhash64("doc_id", F.lit(4)).alias("h"), "x", "y"))
    # By hash, a little more than is wanted: few rows of each partition go on to the one task that puts them in order.
    share = min(1.0, 1.2 * sample_rows / max(1, known.count()) + 1e-4)
    near = F.shiftrightunsigned("h", 33) < int(share * (1 << 31))
    some = known.where(near).orderBy("h", "x", "y").limit(sample_rows).toArrow()
    x = np.array(some.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return train(x, some.column("y").to_numpy().astype(float))


def scored(rows: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score of rows of `measured`."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs`."""
    rows = cut(measured(docs))
    out = scored(rows, fit(rows, labels, sample_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
