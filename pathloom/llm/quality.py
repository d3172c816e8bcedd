"""A quality classifier from positive and unlabelled texts.

Only texts that are trusted to be good are labelled; web text is unlabelled, good or not. With the share of good text
(the class prior), the risk of a classifier is estimated without bias from these two sets; its part for bad text is kept
from going below zero, which else lets a flexible model overfit (Kiryo et al., 2017). The prior is estimated by the best
bin (Garg et al., 2021): rank both sets by a classifier of labelled against unlabelled, and take the least ratio of the
two sets' shares above a threshold, plus a confidence width.

A text's features are frequencies of hashed byte trigrams and a few ratios; the model is linear. What the fit looks at
is bounded: POSITIVES and UNLABELLED rows, drawn by a hash of their id. Everything else is scored in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_rows, release, small_batches, texts

#: Rows that the model and the prior are fitted on, at most; hashed trigrams; ratios.
POSITIVES, UNLABELLED, TRIGRAMS, RATIOS = 2000, 4000, 1024, 7
#: Texts whose features are held at once.
AT_ONCE = 256
#: Chosen by choose_quality.py, on labels of rows that are not held out.
STEPS, RATE, DECAY, SEED = 400, 0.05, 3e-2, 7
UPPER, SYMBOL, SPACE = (np.array([f(c) for c in range(256)]) for f in (lambda c: 65 <= c <= 90, lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()", lambda c: c in (9, 10, 13, 32)))


def features(text: bytes) -> np.ndarray:
    """TRIGRAMS square roots of frequencies, and RATIOS; all zero for an empty text."""
    out = np.zeros(TRIGRAMS + RATIOS, np.float32)
    if not text:
        return out
    x = np.frombuffer(text, np.uint8)
    if len(x) > 2:
        y = x.astype(np.uint32)
        h = ((y[:-2] << 16 | y[1:-1] << 8 | y[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        out[:TRIGRAMS] = np.sqrt(np.bincount(h, minlength=TRIGRAMS) / len(h))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    out[TRIGRAMS:] = (UPPER[x].mean(), SYMBOL[x].mean(), SPACE[x].mean(), sum(map(eq, words, words[1:])) / n, len(set(words)) / n / (1 + 0.1 * np.log1p(n)), len(set(lines)) / len(lines), min(1.0, len(text) / n / 20))
    return out


def risk_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk for scores z under the logistic loss, and its gradient: if the part for bad text is below
    zero, one that brings it back up."""
    n_p, n_u = positive.sum(), (~positive).sum()
    s = 1 / (1 + np.exp(-z))
    good, bad = np.logaddexp(0, -z), np.logaddexp(0, z)
    below = bad[~positive].sum() / n_u - prior * bad[positive].sum() / n_p
    g_bad = np.where(positive, -prior * s / n_p, s / n_u)
    if below < 0:
        return prior * good[positive].sum() / n_p, -g_bad
    return prior * good[positive].sum() / n_p + below, g_bad + np.where(positive, prior * (s - 1) / n_p, 0)


def descend(x: np.ndarray, gradient, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Adam on a linear model, with steps that shrink to none; gradient: of the loss by the scores."""
    w = np.zeros(x.shape[1], x.dtype)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ gradient(x @ w).astype(x.dtype) + decay * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(x: np.ndarray, positive: np.ndarray, confidence: float = 0.05) -> float:
    """The share of positives among the unlabelled rows, by the best bin on a half that the ranking wasn't fitted on."""
    half = np.random.default_rng(SEED).random(len(x)) < 0.5
    y, n = positive.astype(x.dtype), positive[half].sum() / max(1, half.sum())
    weight = np.where(positive[half], 0.5 / max(n, 1e-9), 0.5 / max(1 - n, 1e-9)) / max(1, half.sum())
    w = descend(x[half], lambda z: (1 / (1 + np.exp(-z)) - y[half]) * weight, steps=150)
    z = x[~half] @ w
    p, u = np.sort(z[positive[~half]])[::-1], np.sort(z[~positive[~half]])
    if not len(p) or not len(u):
        return 0.5
    q_p = np.arange(1, len(p) + 1) / len(p)
    q_u = 1 - np.searchsorted(u, p, "left") / len(u)
    width = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    enough = q_p > 0.1
    best = np.flatnonzero(enough)[np.argmin(((q_u + width) / q_p)[enough])]
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.99))


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(x: np.ndarray, positive: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """x: features; positive: which rows are trusted positives; the others are unlabelled."""
    mean, scale = x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32), (x.std(0) if len(x) else 0) + np.float32(0.01)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    if not positive.any() or positive.all():  # nothing to learn from: everything is as likely as not
        return Model(np.zeros(z.shape[1], np.float32), mean, np.broadcast_to(scale, mean.shape), 0.5)
    prior = estimate_prior(z, positive)
    return Model(descend(z, lambda s: risk_gradient(s.astype(np.float64), positive, prior)[1], steps, rate, decay), mean, scale, prior)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on `positives` rows labelled 1 and `unlabelled` other rows at most, none of them held out; each set is drawn
    by a hash of its id over the whole table. Null ids and labels are left out; a document with labels 0 and 1 isn't
    trusted. Of rows that share an id, one is looked at."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    good = own.groupBy("id").agg(F.min("quality").alias("q")).filter("q = 1").select("id").join(ids.distinct(), "id", "left_semi")
    draw = lambda df, seed, n: [r[0] for r in df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).collect()]
    p = draw(good, 1, positives)
    u = draw(ids.distinct(), 2, unlabelled)
    wanted = docs.sparkSession.createDataFrame([(i, True) for i in p] + [(i, False) for i in u], "id long, positive boolean")
    rows = texts(docs, id_col, text_col, as_bytes=True).filter(F.col("doc_id").isNotNull()).join(F.broadcast(wanted), F.col("doc_id") == F.col("id")).select("id", "text", "positive")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t).tobytes() for t in b.column(1).to_pylist()]
        return batch(id=b.column(0), positive=b.column(2), x=pa.array(x, pa.binary()))

    found = {(r[0], r[1]): r[2] for r in map_rows(rows, run, "id long, positive boolean, x binary").collect()}
    keys = sorted(found)
    x = np.array([np.frombuffer(found[k], np.float32) for k in keys], np.float32).reshape(len(keys), TRIGRAMS + RATIOS)
    return fit(x, np.array([k[1] for k in keys], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, by its whole text alone. Null texts are empty ones, which get
    the score of no features; rows without doc_id are scored, and not held out. Other columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                s = model.score(np.array([features(t) for t in part.column(1).to_pylist()]))
                yield batch(doc_id=part.column(0), score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)))
        release()

    scored = texts(docs, id_col, text_col, as_bytes=True).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't rejected (score of at least 0.5), with all their columns, in any order.

    Null and empty texts have the score of no features; rows that repeat are kept or rejected together; an empty table
    stays empty. Columns may have any names, as long as no two are the same; only the text is sent to Python, and only
    one boolean comes back."""

    @F.pandas_udf("boolean")
    def good(each: pd.Series) -> pd.Series:
        parts = [model.score(np.array([features(t) for t in each[k : k + AT_ONCE]])) >= 0.5 for k in range(0, len(each), AT_ONCE)]
        release()
        return pd.Series(np.concatenate([np.zeros(0, bool), *parts]))

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return small_batches(docs).filter(good(text))
