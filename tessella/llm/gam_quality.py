"""Quality classification by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features, so each feature in turn explains what is
left; their sums are one lookup table a feature. Then the pairs of features that explain most of
the residuals get tables over two features, boosted in the same way. A score is the sum of table
entries at the document's bins, through the logistic function.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, held_out, per_row
from .toxicity import training_sample

#: Labelled rows that the model is fitted on, at most; taken by a hash of doc_id.
MAX_ROWS = 12_000
MAX_BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS, RATE = 60, 20, 0.15
MAX_LEAVES = 3
N_PAIRS = 5
MIN_LEAF = 5
THRESHOLD = 0.5
#: Documents whose bins are looked up together.
TOGETHER = 512

FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct_share", "top_word_share", "same_neighbour_share", "repeat_pair_share",
    "upper_share", "digit_share", "punct_share", "symbol_share", "bang_share", "pipe_share", "alpha_end_share",
    "dup_line_share", "log_line_words", "zip_ratio",
)
SYMBOLS, PUNCT = b"#*$%&<>", b".,;:!?\"'()[]{}-"


def features(text: str | None) -> tuple[float, ...]:
    """The values of FEATURES over a whole text; null and empty texts have zeros."""
    import zlib

    if not text:
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    lens = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    gone = lambda chars: size - len(raw.translate(None, chars))
    upper = gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lower = gone(b"abcdefghijklmnopqrstuvwxyz")
    return (
        math.log1p(n),
        float(lens.mean()),
        float(lens.std()),
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in pairs) / max(1, n - 1),
        1 - len(set(pairs)) / max(1, n - 1) if n > 1 else 0.0,
        upper / max(1, upper + lower),
        gone(b"0123456789") / size,
        gone(PUNCT) / size,
        gone(SYMBOLS) / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        sum(w[-1:].isalpha() or w[-1] > 127 for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        size / len(zlib.compress(raw, 1)),
    )


@dataclass
class Gam:
    """Edges of the bins, and the tables: one a feature, and one a pair over coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    distinct = np.unique(x)
    at = np.searchsorted(distinct, values, side="right")
    return np.unique([(distinct[i - 1] + distinct[i]) / 2 for i in at if i < len(distinct)])


def _leaves(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """Bins cut into at most ``leaves`` runs by the greatest gain at a time."""
    runs = [(0, len(grad))]
    g, h, n = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, rows))
    part = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(runs) < leaves:
        best = (1e-9, None)
        for a, b in runs:
            cuts = np.arange(a + 1, b)
            cuts = cuts[(n[cuts] - n[a] >= MIN_LEAF) & (n[b] - n[cuts] >= MIN_LEAF)]
            if len(cuts):
                gain = part(a, cuts) + part(cuts, b) - part(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, int(cuts[k]), b))
        if best[1] is None:
            break
        a, c, b = best[1]
        runs.remove((a, b))
        runs += [(a, c), (c, b)]
    return runs


def _grow(codes: np.ndarray, size: int, resid: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """One shallow tree over a feature's bins, as a table."""
    g, h, n = np.bincount(codes, resid, size), np.bincount(codes, hess, size), np.bincount(codes, minlength=size)
    table = np.zeros(size)
    for a, b in _leaves(g, h, n, MAX_LEAVES):
        table[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return table


def _grow_pair(a: np.ndarray, b: np.ndarray, shape: tuple[int, int], resid: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """One tree of a cut in each of two features, as a table, and its gain."""
    code, size = a * shape[1] + b, shape[0] * shape[1]
    g, h, n = (np.bincount(code, w, size).reshape(shape) for w in (resid, hess, np.ones(len(code))))
    corner = lambda m: np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    g, h, n = corner(g), corner(h), corner(n)
    best, table = 0.0, np.zeros(shape)
    for i in range(1, shape[0]):
        for j in range(1, shape[1]):
            gs, hs, ns = ([m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]] for m in (g, h, n))
            if min(ns) >= MIN_LEAF:
                gain = sum(x * x / (y + 1.0) for x, y in zip(gs, hs, strict=True))
                if gain > best:
                    best, table = gain, np.zeros(shape)
                    v = [x / (y + 1.0) for x, y in zip(gs, hs, strict=True)]
                    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = v[0], v[1], v[2], v[3]
    return table, best


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = N_PAIRS, rate: float = RATE) -> Gam:
    """Fit by cyclic boosting; without both labels the model is a constant near them."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    intercept = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return Gam(intercept, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    edges = [_edges(c, MAX_BINS) for c in x.T]
    codes = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    raw = np.full(len(y), intercept)
    for _ in range(rounds):
        for j, code in enumerate(codes):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _grow(code, len(tables[j]), y - p, p * (1 - p))
            tables[j] += step
            raw += step[code]
    coarse = [_edges(c, PAIR_BINS) for c in x.T]
    small = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]
    p = 1 / (1 + np.exp(-raw))
    gains = []
    for a, b in itertools.combinations(range(x.shape[1]), 2):
        gains.append((_grow_pair(small[a], small[b], (len(coarse[a]) + 1, len(coarse[b]) + 1), y - p, p * (1 - p))[1], a, b))
    pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _grow_pair(small[a], small[b], table.shape, y - p, p * (1 - p))[0]
            table += step
            raw += step[small[a], small[b]]
    return Gam(intercept, edges, tables, pairs, coarse, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """Fit on the features of at most ``max_rows`` labelled rows that aren't held out."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for text, label in rows:
            yield label, *features(text)

    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
    got = per_row(training_sample(docs, labels, "quality", max_rows), ["text", "label"], schema, run).collect()  # numbers of at most max_rows rows
    rows = np.array(sorted(tuple(r) for r in got), np.float64).reshape(-1, len(FEATURES) + 1)
    return fit_arrays(rows[:, 1:], rows[:, 0])


def score(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """Score and verdict for every document; ``docs`` needs doc_id and text.

    Null and empty texts are scored by zero features. Repeated rows are scored each. Other columns
    are left out.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        while block := list(itertools.islice(rows, TOGETHER)):
            scores = model.scores(np.array([features(text) for _, text in block]))
            for (doc_id, _), s in zip(block, scores.tolist(), strict=True):
                yield doc_id, doc_id is not None and held_out(doc_id), s, int(s >= threshold)

    return per_row(docs, ["doc_id", "text"], "doc_id long, held_out boolean, score double, predicted int", run)


def op10_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
