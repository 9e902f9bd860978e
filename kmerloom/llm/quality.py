"""A quality classifier as a sparse ensemble of rules over text statistics.

Boosted shallow trees on a bounded sample of labelled rows propose rules: every path
from a root to a node is a conjunction of threshold tests.  A lasso logistic regression
over those rules keeps the few that carry weight, and the result is compiled into one
Spark column expression, so scoring stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .arrowmap import per_chunk

#: Statistics that rules may test; all are made from the text alone.
STATISTICS = (
    "n_words", "word_length", "upper_share", "letter_share", "digit_share", "symbol_share", "bar_share", "mark_share",
    "stop_share", "space_share", "line_words", "echo_share", "distinct_share", "capital_share", "stopped_words",
)

SAMPLE = 20_000


def _classes() -> np.ndarray:
    out = np.zeros((8, 256), bool)
    out[0, 65:91] = True  # upper-case letters
    out[1, 65:91] = out[1, 97:123] = out[1, 128:] = True  # letters, with all bytes beyond ASCII
    out[2, 48:58] = True
    out[3, list(b"#*$%&<>~^_=+{}[]\\/@")] = True
    out[4, ord("|")] = True
    out[5, list(b"!?")] = True
    out[6, list(b".,;:")] = True
    out[7, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out


_CLASS = _classes()


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(flags)))
    return (upto[bounds[1:]] - upto[bounds[:-1]]).astype(np.float64)


def statistics_of(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of consecutive texts; 0 where an empty text leaves one undefined."""
    starts, ends, bounds = textbuf.words(buf, offs)
    n_bytes, n_words = np.diff(offs).astype(np.float64), np.diff(bounds).astype(np.float64)
    some_bytes, some_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    count = [_per_text(c[buf], offs) for c in _CLASS]
    hashes = textbuf.word_hashes(textbuf.lower(buf), starts, ends)
    doc = np.repeat(np.arange(len(n_words)), np.diff(bounds))
    echo = np.zeros(len(starts), bool)
    if len(starts) > 1:
        echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    ordered = np.lexsort((hashes, doc))
    fresh = np.ones(len(starts), bool)
    if len(starts) > 1:
        fresh[1:] = (hashes[ordered][1:] != hashes[ordered][:-1]) | (doc[ordered][1:] != doc[ordered][:-1])
    lines = _per_text(buf == 10, offs) + 1
    return {
        "n_words": n_words,
        "word_length": _per_text(~_CLASS[7][buf], offs) / some_words,
        "upper_share": count[0] / np.maximum(count[1], 1),
        "letter_share": count[1] / some_bytes,
        "digit_share": count[2] / some_bytes,
        "symbol_share": count[3] / some_bytes,
        "bar_share": count[4] / some_bytes,
        "mark_share": count[5] / some_bytes,
        "stop_share": count[6] / some_bytes,
        "space_share": count[7] / some_bytes,
        "line_words": n_words / lines,
        "echo_share": _per_text(echo, bounds) / some_words,
        "distinct_share": _per_text(fresh, bounds) / some_words,
        "capital_share": _per_text(_CLASS[0][buf[starts]], bounds) / some_words,
        "stopped_words": _per_text(_CLASS[6][buf[ends - 1]], bounds) / some_words,
    }


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and one column for each statistic of the whole text, of any length.

    A null text counts as empty, and an empty one has 0 throughout.  Rows are taken one by
    one, so repeated ones agree and an empty table stays empty; a column that is named like
    a statistic is replaced.
    """
    keep = [k for k in keep if k not in STATISTICS]
    kept = [docs.schema[k] for k in keep]
    return per_chunk(docs, text, keep, T.StructType([*kept, *(T.StructField(s, T.DoubleType(), False) for s in STATISTICS)]), statistics_of)


Rule = tuple[tuple[str, str, float], ...]


def _stump(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    """The split of these rows with the largest gain: gain, statistic, threshold."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = None
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        code = np.searchsorted(cut, x[rows, j], "left")  # code <= i: x <= cut[i]
        gl = np.cumsum(np.bincount(code, grad[rows], len(cut) + 1))[:-1]
        hl = np.cumsum(np.bincount(code, hess[rows], len(cut) + 1))[:-1]
        nl = np.cumsum(np.bincount(code, minlength=len(cut) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), j, float(cut[i]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 10) -> list[Rule]:
    """Paths of boosted trees as rules, in a fixed order and without repeats."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for _ in range(depth):
            nodes = []
            for path, rows in level:
                found = _stump(x, grad, hess, rows, cuts, least) if len(rows) >= 2 * least else None
                if found is None:
                    nodes.append((path, rows))  # a leaf that is reached early
                    continue
                _, j, at = found
                below = x[rows, j] <= at
                for op, own in (("<=", rows[below]), (">", rows[~below])):
                    rule = tuple(sorted((*path, (STATISTICS[j], op, at))))
                    rules[rule] = None
                    nodes.append((rule, own))
            if len(nodes) == len(level):
                break
            level = nodes
        for _, rows in level:
            margin[rows] -= rate * 3 * grad[rows].sum() / (hess[rows].sum() + 1)
        if np.abs(grad).mean() < 1e-3:
            break
    return list(rules)


def _fires(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, at in rule:
        column = x[:, STATISTICS.index(name)]
        out &= column <= at if op == "<=" else column > at
    return out


def lasso_weights(fires: np.ndarray, y: np.ndarray, penalty: float = 5e-4, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, m = fires.shape
    w, z, b, bz, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    v = np.full(m, 1 / max(m, 1) ** 0.5)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = fires.T @ (fires @ v)
        norm = np.linalg.norm(v)
        if not norm:
            break
        v /= norm
    size = 4.0 / ((norm if m else 0.0) / n + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(fires @ z + bz)))
        step = z - size * (fires.T @ (p - y)) / n
        nw = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        nb = bz - size * (p - y).mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, bz = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; compiles into Spark columns."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability that the label is 1, over the statistics columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, op, at in rule:
                test &= F.col(name) <= at if op == "<=" else F.col(name) > at
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Rules and weights for rows of statistics; without both labels, the share of 1 (no rows: one half)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    fires = np.stack([_fires(x, r) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    b, w = lasso_weights(fires, y)
    return RuleEnsemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def fit_on(stats: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", sample: int = SAMPLE) -> RuleEnsemble:
    """Fits on ``sample`` labelled rows at most, the first in the order of a hash of their key.

    The sample is the only thing that the driver sees of the rows.  Labels that are null
    or neither 0 nor 1 teach nothing; of several labels for a key the smallest counts, and
    a key that comes in several rows teaches once, by the smallest of its statistics.
    Without labels every score is one half, with labels of one kind the same for all.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    own = stats.select(F.col(key).alias("_id"), F.struct(*STATISTICS).alias("_row"))
    taught = own.join(marks, F.col("_id") == F.col("_key")).groupBy("_id", "_label").agg(F.min("_row").alias("_row"))
    rows = taught.orderBy(F.xxhash64(F.col("_id")), "_id").limit(sample).select("_row.*", "_label").toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], 1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows.column("_label").to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0))
