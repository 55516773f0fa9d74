"""Centres and boxes that are many in one second."""

from __future__ import annotations

import math

import numpy as np

from tempograph.operators import joins

BOXES = "session_id long, second long, box_seq long, x double, y double, w double, h double"
POINTS = "session_id long, point_id long, second long, cx double, cy double"


def made(plan):
    """Rows that the joins of an executed plan made, one number each."""
    children = plan.children()
    out = [n for i in range(children.size()) for n in made(children.apply(i))]
    if "Join" in plan.nodeName():
        out.append(plan.metrics().get("numOutputRows").get().value())
    return out


def test_crowd(spark):
    rng, adaptive = np.random.default_rng(1), spark.conf.get("spark.sql.adaptive.enabled")
    boxes = [(1, 0, i, float(rng.integers(0, 60) * 20), float(rng.integers(0, 50) * 20), 40.0, 20.0) for i in range(3000)]
    points = [(1, i, 0, float(rng.random() * 1.1), float(rng.integers(0, 100) / 100)) for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.snap_nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(boxes, BOXES), 1920, 1080)
        got = {r.point_id: (r.cx, r.cy) for r in out.collect()}
        assert max(made(out._jdf.queryExecution().executedPlan())) < 100_000  # of 3,000,000 pairs
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = {}
    for _, i, _, cx, cy in points:
        d, _, bx, by = min((math.sqrt((cx * 1920 - x - 20) ** 2 + (cy * 1080 - y - 10) ** 2), n, x + 20, y + 10) for _, _, n, x, y, _, _ in boxes)
        want[i] = (bx / 1920, by / 1080) if d <= 150 else (cx, cy)
    assert any(want[i] == (cx, cy) for _, i, _, cx, cy in points)
    assert got == want


def test_odd_places(spark):
    p = spark.createDataFrame([(1, 1, 0, 0.25, 0.5), (1, 2, 0, None, 0.5), (1, 3, 0, math.inf, 0.5), (1, 4, 0, math.nan, 0.5), (1, 5, 1, 0.25, 0.5)], POINTS)
    b = spark.createDataFrame([(1, 0, 0, None, 535.0, 30.0, 20.0), (1, 0, 2, 465.0, 535.0, 30.0, 20.0), (1, 0, 1, 465.0, 535.0, 30.0, 20.0), (1, 0, 3, math.inf, 0.0, 1.0, 1.0)], BOXES)
    got = {r.point_id: (r.cx, r.cy) for r in joins.snap_nearest(p, b, 1920, 1080).collect()}
    assert got[1] == (480 / 1920, 545 / 1080) and got[2] == (None, 0.5) and got[3] == (math.inf, 0.5) and math.isnan(got[4][0]) and got[5] == (0.25, 0.5)
