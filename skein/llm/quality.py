"""Quality scores by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text (all rows, whatever their label,
which is unread) give the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

under the logistic loss. The model is additive over binned surface statistics of the
whole text. No row of label 0 is looked at as such, neither for the weights nor for the
prior: this is the least share of unlabelled to positive rows among the best-scored
ones, under a first model (there, where negatives are rare, unlabelled rows are as
frequent as the prior says). The score is the logistic of the margin.

The fit sees bounded samples, chosen by a hash of the id: about `positives` trusted rows
and `unlabelled` others (None: all). Scoring is a map over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the fit by default.
POSITIVES, UNLABELLED = 6000, 12000
BINS = 24
NAMES = ("words", "word_length", "upper", "digits", "symbols", "stops", "bars", "shouts", "marks", "distinct", "commonest", "echoes", "lines_again", "lines", "bare", "punctuated", "short", "long", "packed", "run", "brackets", "capitals")
_LOWER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58] = True, True, True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OF = {"stops": b".,;:", "bars": b"|", "shouts": b"!?", "marks": b"#$%&*", "brackets": b"<>{}[]\\"}


def statistics(text: str | None) -> list[float]:
    """The surface statistics of a whole text, in the order of NAMES; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    array = np.frombuffer(data, np.uint8)
    counts = np.bincount(array, minlength=256)
    n, nw = len(data), len(words)
    upper, letters = counts[_UPPER].sum(), counts[_UPPER].sum() + counts[_LOWER].sum()
    other = n - letters - counts[_DIGIT].sum() - counts[_SPACE].sum() - counts[128:].sum()
    lengths = np.fromiter(map(len, words), np.int64, nw)
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    changes = np.flatnonzero(np.diff(array))
    run = np.diff(np.concatenate([[-1], changes, [n - 1]])).max()
    share = {k: sum(int(counts[c]) for c in v) / n for k, v in _OF.items()}
    last, first = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8), np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    found = {
        "words": math.log1p(nw),
        "word_length": float(lengths.mean()),
        "upper": upper / max(letters, 1),
        "digits": counts[_DIGIT].sum() / n,
        "symbols": other / n,
        "distinct": len(tally) / nw**0.9,
        "commonest": tally.most_common(1)[0][1] / nw,
        "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)) / nw,
        "lines_again": 1 - len(set(lines)) / len(lines),
        "lines": len(lines) / nw,
        "bare": sum(not any(c > 127 or _LOWER[c] or _UPPER[c] for c in w) for w in tally) / len(tally),
        "punctuated": float((~(_LOWER | _UPPER | _DIGIT)[last] & (last < 128)).mean()),
        "short": float((lengths <= 3).mean()),
        "long": float((lengths > 15).mean()),
        "packed": len(zlib.compress(data, 1)) / n,
        "run": math.log1p(float(run)),
        "capitals": float(_UPPER[first].mean()),
    } | share
    return [float(found[k]) for k in NAMES]


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # statistics x (BINS - 1)
    weights: np.ndarray  # statistics x BINS
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        places = bins(x, self.edges)
        return self.bias + self.weights[np.arange(x.shape[1])[None, :], places].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], 1)


def risk(weights: np.ndarray, bias: float, positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The positive part and the negative part of the risk, and the gradient (weights, bias) to follow; positives and unlabelled hold a cell number for each statistic.

    Where the negative part is below 0 the gradient leads back up to it.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    back = lambda c, g: np.bincount(c.ravel(), np.repeat(g, c.shape[1]), len(weights))
    zp, zu = weights[positives].sum(1) + bias, weights[unlabelled].sum(1) + bias
    plus = prior * np.logaddexp(0, -zp).mean()
    minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, down = sig(zu) / len(zu), prior * sig(zp) / len(zp)
    gp, gu = (prior * (sig(zp) - 1) / len(zp) - down, up) if minus >= 0 else (down, -up)
    return plus, minus, back(positives, gp) + back(unlabelled, gu), gp.sum() + gu.sum()


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-3) -> QualityModel:
    """Minimises the non-negative risk by Adam."""
    both = np.concatenate([positives, unlabelled])
    edges = np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T
    n, k = both.shape[1], BINS
    cp, cu = (bins(x, edges) + np.arange(n) * k for x in (positives, unlabelled))
    w, b = np.zeros(n * k), math.log(prior / (1 - prior))
    m, v = np.zeros(n * k + 1), np.zeros(n * k + 1)
    for t in range(1, steps + 1):
        _, _, gw, gb = risk(w, b, cp, cu, prior)
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return QualityModel(edges, w.reshape(n, k), b)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """The share of positives among unlabelled rows, kept off 0 and 1.

    First models, under a prior of a half, order the rows; each row by the one that is
    fitted on the other half of the rows (equal rows lie in one half). Of the rows above
    any cut, unlabelled ones are at least prior times as frequent as positives; the
    estimate is that ratio at the cut where its upper bound (by a standard deviation) is least.
    """
    half = lambda x: np.array([zlib.crc32(row.tobytes()) & 1 for row in x], int)
    parts = [[x[half(x) == i] for x in (positives, unlabelled)] for i in (0, 1)]
    if min(len(x) for part in parts for x in part) < 1:
        return 0.5
    models = [fit(*part, 0.5, steps, decay=1e-2) for part in parts]
    p, u = (np.sort(np.concatenate([models[1 - i].margins(parts[i][j]) for i in (0, 1)])) for j in (0, 1))
    cuts = np.quantile(p, np.arange(0, 0.9, 0.01))
    above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    share, mine = above(u), above(p)
    bound = (share + np.sqrt(share * (1 - share) / len(u))) / np.maximum(mine - np.sqrt(mine * (1 - mine) / len(p)), 1e-9)
    at = int(np.argmin(bound))
    return float(min(0.98, max(0.02, share[at] / max(mine[at], 1e-9))))


def _features(docs: DataFrame, text_col: str) -> DataFrame:
    kept = [c for c in docs.columns if c != text_col]
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            x = [statistics(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(x, pa.list_(pa.float64()))], names=[*kept, "x"])

    return docs.mapInArrow(run, ", ".join([*shape, "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int | None = POSITIVES, unlabelled: int | None = UNLABELLED) -> QualityModel | None:
    """Learns from the rows in fold (of either table). None where there is no trusted positive.

    An id is trusted if any of its labels is 1; null ids and labels take no part. Rows of
    one id are drawn together: bounds on rows hold as far as ids are not repeated.
    """
    trusted = labels.where(fold & F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(id_col).distinct()
    use = docs.where(fold & F.col(id_col).isNotNull()).select(id_col, text_col)

    def drawn(rows: DataFrame, seed: int, want: int | None) -> DataFrame:
        if want is None:
            return rows
        rate = min(1.0, want / max(rows.count(), 1))
        return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < int(rate * (1 << 30)))

    few = drawn(trusted, 11, positives)
    # about so many ids at most, so they are sent to the texts and no text is moved
    few = F.broadcast(few) if positives is not None else few
    found = [_features(rows, text_col).select("x").toArrow().column(0) for rows in (use.join(few, id_col, "left_semi"), drawn(use, 17, unlabelled))]
    p, u = (np.array(sorted(c.to_pylist())).reshape(-1, len(NAMES)) for c in found)
    if not len(p):
        return None
    return fit(p, u, estimated_prior(p, u))


def score(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """Adds score to all rows, in place of the text. Null and empty texts are scored too; without a model the score is 0.5."""
    kept = [c for c in docs.columns if c not in (text_col, "score")]
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]).reshape(-1, len(NAMES))
            s = model.scores(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(s, pa.float64())], names=[*kept, "score"])

    return docs.drop("score").mapInArrow(run, ", ".join([*shape, "score double"]))
