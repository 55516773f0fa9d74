"""What the two text classifiers share: a bounded sample of labelled rows, and logistic fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.textbytes import slices


def fold_of(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


#: bytes of the pieces that a long labelled text is represented by
PIECE = 1024


def spread(text: str, most: int) -> str:
    """A text of up to ``most`` bytes as it is; of a longer one evenly spaced pieces, from its beginning to its end, of so many bytes together."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    many = max(2, most // PIECE)
    at = [i * (len(raw) - PIECE) // (many - 1) for i in range(many)]
    return "\n".join(raw[a : a + PIECE].decode(errors="ignore") for a in at)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, row_bytes: int) -> tuple[list[str], np.ndarray, float]:
    """(texts, 0/1 labels, share of label 1 among all rows that may be learned from).

    At most ``per_class`` documents of each label reach the driver, those with the smallest hash of doc_id, each as one row (of rows that
    share a doc_id the smallest text) of ``row_bytes`` bytes at most, spread over the whole text; held-out rows (fold 0), null labels and
    documents labelled both ways never do.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold_of("doc_id") != 0)
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    share = own.agg(F.avg("y").alias("m")).first()["m"]
    order = F.xxhash64("doc_id")
    picked = own.where("y = 0").orderBy(order, "doc_id").limit(per_class).union(own.where("y = 1").orderBy(order, "doc_id").limit(per_class))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            yield part.set_column(1, "text", pa.array([spread(t, row_bytes) for t in part.column("text").to_pylist()], pa.string()))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    rows = rows.mapInArrow(shorten, "doc_id long, text string, y int").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), float(share if share is not None else 0.5)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def prior_shift(y: np.ndarray, share: float) -> float:
    """What to add to log odds that were fitted on a sample with other shares of the labels than the whole."""
    ones, zeros = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)) - np.log(ones / zeros))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> np.ndarray:
    """Newton fit of a logistic regression with an intercept in the first column's place; x: rows of features."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
