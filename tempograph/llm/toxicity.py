"""Operator 6: toxicity by a linear classifier over character n-grams.  A hashed n-gram's presence is scaled by its naive Bayes
log-count ratio, and a logistic regression is fitted on the scaled features of labelled text.

The sample is bounded by ``per_class`` (2,000 rows of each label by default) and ``row_bytes`` (32,768 bytes of a row, in pieces from all
over the text) and comes from rows outside the held-out fold; every text is scored whole.  Characters are code points; A-Z count as lower case,
white space as one kind of blank.  N-grams are hashed to 2**SPACE_BITS numbers (what falls together counts together), of which
the ``KEPT`` whose presence differs most surely between the labels have a weight.

Defined results: a null or empty text has no n-grams and gets the intercept's score; with no labels of one kind every score
is the share of label 1; repeated rows are scored each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.labelled import fold_of, platt, prior_shift, sample, sigmoid
from tempograph.llm.textbytes import _LANE, mix, slices

#: hashed dimensions (a power of 2), n-gram lengths in characters, features kept
SPACE_BITS, ORDERS, KEPT = 20, (3, 4, 5, 6, 7, 8), 30_000


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (text number, hashed n-gram) of every n-gram; a blank stands before and after each text."""
    own = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t or "") + 2 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    own = np.where((own >= 65) & (own <= 90), own + 32, own)
    own = np.where((own >= 9) & (own <= 13), 32, own).astype(np.uint64)
    value, total = mix(own), np.zeros(len(own), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            if k >= len(own):
                break
            total[: len(own) - k] += value[k:] * _LANE[k]
            if k + 1 in ORDERS:
                last = len(own) - k
                inside = text[:last] == text[k:]
                h = mix(total[:last] + np.uint64(k)) >> np.uint64(64 - SPACE_BITS)
                yield text[:last][inside], h[inside].astype(np.int64)


def present(texts: list[str | None], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), each pair once; ``keep`` says which features count."""
    pairs = []
    for text, h in grams(texts):
        if keep is not None:
            use = keep[h]
            text, h = text[use], h[use]
        pairs.append(np.unique(text << SPACE_BITS | h))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> SPACE_BITS, both & ((1 << SPACE_BITS) - 1)


def fit(texts: list[str], y: np.ndarray, share: float, rounds: int = 100, ridge: float = 0.02) -> dict | None:
    """A model, or None if one label is missing."""
    if len(set(y.tolist())) < 2:
        return None
    dims = 1 << SPACE_BITS
    count = np.ones((2, dims))
    parts = [(a, texts[a : a + 100]) for a in range(0, len(texts), 100)]
    for a, part in parts:
        text, f = present(part, None)
        for label in (0, 1):
            count[label] += np.bincount(f[y[a + text] == label], minlength=dims)
    rows = np.array([max(1, (y == label).sum()) for label in (0, 1)], float)
    rate = count / (rows[:, None] + 2)
    ratio = np.log(rate[1] / rate[0])
    # how surely the two classes differ in a feature decides what is kept
    pooled = (count.sum(0)) / (rows.sum() + 4)
    z = np.abs(rate[1] - rate[0]) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / rows).sum() + 1e-12)
    z[count.sum(0) < 5] = 0
    keep = np.zeros(dims, bool)
    keep[np.argsort(-z, kind="stable")[:KEPT]] = True
    keep &= z > 1.5
    spot = np.cumsum(keep) - 1
    found = [(a + text, spot[f]) for a, part in parts for text, f in [present(part, keep)]]  # only what is kept is held
    row, col = (np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))
    del found
    scale = ratio[keep]
    m, values = len(y), scale[col].astype(np.float32)
    w, b = np.zeros(len(scale)), 0.0
    weight = np.where(y == 1, 0.5 / rows[1], 0.5 / rows[0])
    # Nesterov steps on the mean loss, each class with half the weight; the step length follows the loss's curvature
    norm = np.bincount(row, values**2, m)
    step = 4.0 / (1 + float(np.quantile(norm, 0.9)))
    old, t = w.copy(), 1.0
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = w + (t - 1) / t2 * (w - old)
        err = (sigmoid(b + np.bincount(row, values * look[col], m)) - y) * weight
        old, t = w, t2
        w = look - step * (np.bincount(col, values * err[row], len(w)) + ridge * look / len(w) ** 0.5)
        b -= step * float(err.sum())
    # the intercept and slope once more on the linear score, then the whole's share of labels
    s = np.bincount(row, values * w[col], m)
    spread = float(s.std()) or 1.0
    c = platt((s / spread)[:, None], y)
    full = np.zeros(dims)
    full[keep] = scale * w * c[1] / spread
    return {"w": full.astype(np.float32), "b": float(c[0]) + prior_shift(y, share)}


def scores(model: dict | None, share: float, col: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(col), share)
    w = model["w"]
    text, f = present(col.to_pylist(), w != 0)
    return sigmoid(model["b"] + np.bincount(text, w[f], len(col)))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, per_class: int = 2000, row_bytes: int = 32_768) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    texts, y, share = sample(docs, labels, label, per_class, row_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, y, share))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                s = scores(model.value, share, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.col("text"), (fold_of("doc_id") == 0).alias("held_out")).mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
