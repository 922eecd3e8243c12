"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier for each of its bits is fitted on
hashed character n-grams (lengths 1 to 4 of the lower-cased text). A text gets the
language whose codeword has the least loss under the bits' margins, each bit weighted
by how well it did on its training rows, and is marked ambiguous where the runner-up
is nearly as near.

The fit sees a bounded sample of labelled rows: about `sample` of them, in equal numbers
for each language and LEAST of each at the least, chosen by a hash of the id. Of those,
whole texts count. One executor task fits them; the driver gets the weights (FEATURES *
4 * bits bytes; the bits grow with the logarithm of the number of languages). All
languages present are learned. Prediction is a map over all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the fit, at the least for one language; hashed features.
SAMPLE, LEAST, FEATURES = 4000, 16, 4096
#: A runner-up within this share of the best one's loss makes a row ambiguous.
NEAR = 0.1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_LETTER.search(text)) and any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram frequencies, of unit length."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts, h = np.zeros(FEATURES), np.zeros(len(chars), np.uint32)
    for n in range(min(4, len(chars))):
        h = (h[: len(chars) - n] ^ (chars[n:] + np.uint32(n + 1))) * _MIX[n]
        h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(FEATURES - 1), minlength=FEATURES)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


def codewords(classes: int, seed: int = 0) -> np.ndarray:
    """classes x bits of +1 and -1: all splits up to five classes, else the best of many random codes."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        splits = np.arange(1, 2 ** (classes - 1))
        bits = (splits[None, :] >> np.arange(classes)[:, None]) & 1
        return (1 - 2 * bits).astype(np.int8)
    rng, bits, best = np.random.default_rng(seed), math.ceil(10 * math.log2(classes)), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = bits - code.astype(int) @ code.T
        np.fill_diagonal(apart, 2 * bits)
        if np.all(abs(code.sum(0)) < classes) and apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1] if best[1] is not None else code


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # (FEATURES + 1) x bits, the last row is the bias
    trust: np.ndarray  # of each bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether another language is nearly as near."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        margins = ngrams(text) @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -self.code * margins) @ self.trust
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < NEAR * max(loss[order[1]], 1e-9)
        return self.languages[order[0]], float(1 / p.sum()), bool(close)


def fit(vectors: np.ndarray, labels: list[str], steps: int = 300, rate: float = 20.0, decay: float = 1e-5) -> LanguageModel:
    languages = tuple(sorted(set(labels)))
    if not languages:
        return LanguageModel((), np.ones((0, 1), np.int8), np.zeros((FEATURES + 1, 1), np.float32), np.ones(1))
    code = codewords(len(languages))
    at = np.array([languages.index(x) for x in labels])
    wanted = code[at].astype(np.float32)
    share = 1.0 / np.bincount(at, minlength=len(languages))[at]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = share * wanted / (1 + np.exp(np.clip(wanted * (vectors @ w + b), -30, 30)))
        speed_w = 0.9 * speed_w + vectors.T @ pull - decay * w
        speed_b = 0.9 * speed_b + 0.1 * pull.sum(0)
        w, b = w + rate * speed_w, b + rate * speed_b
    right = ((np.sign(vectors @ w + b) == wanted) * share).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(languages, code, np.vstack([w, b]).astype(np.float32), trust / trust.sum() * len(trust))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = (batch.column(i).to_pylist() for i in (0, 1))
        kept = [(ngrams(t).tobytes(), x) for t, x in zip(texts, labels, strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], pa.string())], names=["v", "label"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample to one model."""
    labels, vectors = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        vectors += [np.frombuffer(v, np.float32) for v in batch.column(1).to_pylist()]
    model = fit(np.array(vectors, np.float32).reshape(-1, FEATURES), labels)
    cells = [pa.array([list(model.languages)], pa.list_(pa.string())), pa.array([model.code.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.trust.astype(np.float64).tobytes()])]
    yield pa.RecordBatch.from_arrays(cells, names=["languages", "code", "weights", "trust"])


def train(docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fits on a sample of the rows in fold that have a text and a language.

    Rows of one id are drawn together; a repeated row counts as often as it is there. A
    null id or fold leaves a row out. Without any row the model knows no language.
    """
    rows = docs.where(fold & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(LEAST), F.floor(F.lit(sample) / F.count("*").over(Window.partitionBy(F.lit(0)))))
    # a row for each language, whose number labels bound
    rates = F.broadcast(counts.select("label", F.least(F.lit(1.0), each / F.col("n")).alias("rate")))
    chosen = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    found = rows.join(rates, "label").where(chosen).select("text", "label").mapInArrow(_vectors, "v binary, label string")
    one = found.select("label", "v").repartition(1).sortWithinPartitions("label", "v")
    got = one.mapInArrow(_fitted, "languages array<string>, code binary, weights binary, trust binary").collect()
    if not got:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    r, bits = got[0], len(got[0]["trust"]) // 8
    return LanguageModel(tuple(r["languages"]), np.frombuffer(r["code"], np.int8).reshape(-1, bits), np.frombuffer(r["weights"], np.float32).reshape(-1, bits), np.frombuffer(r["trust"], np.float64))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous to every row. A null text, or one without a letter, is `und` with score 0."""
    new = ["lang_pred", "score", "ambiguous"]
    clean = docs.drop(*new)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = [model.predict(t) for t in texts]
            cells = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, *new])

    return clean.mapInArrow(run, ", ".join([*shape, "lang_pred string, score double, ambiguous boolean"]))
