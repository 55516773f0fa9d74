"""Operator 5: quality by compression.  Two zstandard dictionaries are trained, one on good and one on bad labelled text; a
text is compressed with each in independent pieces, and the normalised difference of the sizes becomes a calibrated
probability.

Half of the labelled sample makes the dictionaries, the other half calibrates, and both come from rows outside the held-out
fold.  The sample is bounded by ``per_class`` (4,000 rows of each label by default) and ``row_bytes`` (16,384 bytes of a row, in pieces
from all over the text); every text is scored whole.  The calibration also sees how long a text is, as a difference of a few bytes says little
about a short text.

Defined results: a null or empty text compresses to nothing and gets the calibrated score of a difference of 0; with
no labels of one kind every score is the share of label 1; repeated rows are scored each; further columns are ignored or, in
``keep_good``, kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.labelled import fold_of, platt, prior_shift, sample, sigmoid
from tempograph.llm.textbytes import give_back, slices

#: bytes of a piece that is compressed by itself, so that the dictionary and not the text's own past decides
PIECE = 1024
#: bytes of a dictionary
DICTIONARY = 112_640


def _compressor(dictionary: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(dictionary)
    params = z.ZstdCompressionParameters.from_level(3, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params).compress


def features(texts: list[str | None], good, bad) -> np.ndarray:
    """A row for each text: size difference over the sizes' sum, over the text's bytes, the logarithm of the bytes, and
    the product of the last two (by which the calibration treats short texts with care)."""
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if raw:
            g = b = 0
            for at in range(0, len(raw), PIECE):
                piece = raw[at : at + PIECE]
                g += len(good(piece))
                b += len(bad(piece))
            out[i, :3] = (b - g) / (b + g), (b - g) / len(raw), np.log(len(raw))
    out[:, 3] = out[:, 1] * out[:, 2]
    return out


def fit(texts: list[str], y: np.ndarray, share: float) -> dict | None:
    """A model, or None if one label is missing."""
    import zstandard as z

    if len(set(y.tolist())) < 2:
        return None
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    made = []
    for label in (1, 0):
        own = [t.encode()[a : a + PIECE] for t, l, h in zip(texts, y, half, strict=True) if l == label and h for a in range(0, len(t.encode()), PIECE)]
        own = [p for p in own if len(p) >= 16]
        try:
            made.append(z.train_dictionary(DICTIONARY, own, level=3).as_bytes())
        except (z.ZstdError, ValueError):  # too little text to choose from: the text itself is the dictionary
            made.append(b" ".join(own)[:DICTIONARY] or b" " * 16)
    good, bad = map(_compressor, made)
    rest = ~half if len(set(y[~half].tolist())) == 2 else half
    x = features([t for t, r in zip(texts, rest, strict=True) if r], good, bad)
    scale = np.maximum(x.std(0), 1e-9)
    w = platt(x / scale, y[rest])
    w[0] += prior_shift(y[rest], share)
    return {"good": made[0], "bad": made[1], "b": float(w[0]), "w": w[1:] / scale}


def scorer(model: dict | None, share: float) -> Callable[[list[str | None]], np.ndarray]:
    if model is None:
        return lambda texts: np.full(len(texts), share)
    good, bad = _compressor(model["good"]), _compressor(model["bad"])
    return lambda texts: sigmoid(model["b"] + features(texts, good, bad) @ model["w"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, row_bytes: int = 16_384) -> tuple[dict | None, float]:
    texts, y, share = sample(docs, labels, label, per_class, row_bytes)
    model = fit(texts, y, share)
    del texts
    give_back()
    return model, share


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, per_class: int = 4000, row_bytes: int = 16_384) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    model, share = train(docs, labels, label, per_class, row_bytes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(model, share)
        for part in (p for batch in batches for p in slices(batch, "text")):
            s = f(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold_of("doc_id") == 0).alias("held_out")).mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, per_class: int = 4000, row_bytes: int = 16_384) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose score reaches the threshold."""
    model, share = train(docs, labels, label, per_class, row_bytes)
    where = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(model, share)
        for part in (p for batch in batches for p in slices(batch, where)):
            yield part.filter(pa.array(f(part.column(where).to_pylist()) >= threshold))

    return docs.mapInArrow(apply, docs.schema)
