"""union_distinct has the boundaries of all scales, not of the smallest alone."""

from __future__ import annotations

import numpy as np
import pytest

import tempograph.plans as plans
from tempograph.settings import SCALES


def boundaries(v: np.ndarray, k: int, size: int = 100) -> set[int]:
    """Sentence numbers at which topics end, for one session of vectors numbered from 0."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = []
    for i in range(k, min(size - k, len(u) - 1) + 1):
        a, b = u[i - k : i].mean(0), u[i : i + k].mean(0)
        score.append(1 - a @ b / np.sqrt(a @ a * (b @ b)))
    if not score:
        return set()
    padded = np.r_[0, score, 0]
    smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
    depth = np.maximum.accumulate(smooth) + np.maximum.accumulate(smooth[::-1])[::-1] - 2 * smooth
    return set((np.flatnonzero(depth >= depth.mean() + 0.5 * depth.std()) + k).tolist())


@pytest.fixture(scope="module")
def sessions(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("scales"), np.random.default_rng(11)
    found = {d: rng.normal(size=(n, 64)).astype(np.float32) for d, n in ((0, 100), (1, 100), (2, 60))}
    rows = [(100 * d + i, x.tolist()) for d, v in found.items() for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path), found


def test_all_scales(spark, sessions):
    path, found = sessions
    want = {(d, i) for d, v in found.items() for i in {0, 100}.union(*(boundaries(v.astype(float), k) for k in SCALES))}
    assert want > {(d, i) for d, v in found.items() for i in {0, 100} | boundaries(v.astype(float), SCALES[0])}
    got = [(r.session_id, r.idx) for r in plans.queries()["union_distinct"](spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want
