"""Motion, runs, topics, joins and folds on literal vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tempograph.operators import folds, joins, series
from tempograph.plans.catalog import zoom_segments

US = 1_000_000


def us(t):
    return int(round(t * US))


def events(spark, rows, kind="move"):
    return spark.createDataFrame([(1, i, us(t), float(x), float(y), kind) for i, (t, x, y) in enumerate(rows)], "session_id long, row_seq long, t_us long, x double, y double, event string")


def limit(spark, t=100):
    return spark.createDataFrame([(1, us(t))], "session_id long, lim long")


def spans(df):
    return sorted((r.s / US, r.e / US) for r in df.collect())


def test_movement(spark):
    assert spans(series.movement_intervals(events(spark, [(0, 0.1, 0.1), (0.5, 0.9, 0.9)]), limit(spark))) == [(0.2, 2.0)]
    zigzag = [(i * 0.05, 0.5 + (0.001 if i % 2 else -0.001), 0.5) for i in range(6)]
    assert spans(series.movement_intervals(events(spark, zigzag), limit(spark))) == []
    shaking = [(i * 0.03, 0.5 + (0.025 if i % 2 else -0.025), 0.5) for i in range(20)]
    straight = [(i * 0.03, 0.1 + 0.03 * i, 0.5) for i in range(20)]
    few, many = (len(spans(series.movement_intervals(events(spark, r), limit(spark)))) for r in (shaking, straight))
    assert few <= 3 and few < many / 3


def test_zoom_segments(spark):
    c = events(spark, [(5.0, 0.5, 0.5), (5.3, 0.5, 0.5)], "click")
    out = zoom_segments(c, limit(spark, 29.5)).collect()
    assert [(r.s / US, r.e / US, r.zoom, r.cx, r.cy) for r in out] == [(4.6, 7.1, 1.5, 0.5, 0.5)]
    assert zoom_segments(events(spark, [(9.8, 0.5, 0.5)], "click"), limit(spark, 9.5)).collect() == []


def test_click_groups_never_merge(spark):
    c = events(spark, [(0, 0.1, 0.5), (1, 0.35, 0.5), (2, 0.225, 0.5)], "click")
    assert [r.grp for r in folds.click_groups(c, limit(spark)).orderBy("row_seq").collect()] == [0, 1, 0]


def test_centroid(spark):
    i = spark.createDataFrame([(1, 0, us(1)), (1, us(50), us(51))], "session_id long, s long, e long")
    out = {r.s: (round(r.cx, 6), round(r.cy, 6)) for r in joins.centroid_in(i, events(spark, [(0, 0.2, 0.3), (0.5, 0.4, 0.7)])).collect()}
    assert out == {0: (0.3, 0.5), us(50): (0.5, 0.5)}


@pytest.mark.parametrize(("moves", "t", "want"), [([1, 2], 1.9, 2), ([1, 2], 1.1, 1), ([10], 2, None), ([1], 101, 1), ([1, 2], 1.5, 1)])
def test_asof(spark, moves, t, want):
    p = spark.createDataFrame([(1, 7, us(t))], "session_id long, point_id long, t_us long")
    r = joins.asof_nearest(p, events(spark, [(m, 0.1, 0.1) for m in moves])).first()
    assert (r.mt / US if r.mt is not None else None) == want


def test_asof_takes_the_first_of_equal_times(spark):
    p = spark.createDataFrame([(1, 7, us(1))], "session_id long, point_id long, t_us long")
    assert joins.asof_nearest(p, events(spark, [(1, 0.3, 0.1), (1, 0.9, 0.1)])).first().x == 0.3


def test_priority_merge(spark):
    mk = lambda rows: spark.createDataFrame([(1, us(a), us(b)) for a, b in rows], "session_id long, s long, e long")
    assert spans(joins.zoom_priority_merge(mk([(5, 10)]), mk([(6, 9), (10, 14)]))) == [(5, 10), (10, 14)]


def test_snap(spark):
    p = spark.createDataFrame([(1, 1, 0, 0.25, 0.5)], "session_id long, point_id long, second long, cx double, cy double")
    b = spark.createDataFrame([(1, 0, 0, 470.0, 535.0, 30.0, 20.0), (1, 0, 1, 1000.0, 100.0, 50.0, 20.0)], "session_id long, second long, box_seq long, x double, y double, w double, h double")
    r = joins.snap_nearest(p, b, 1920, 1080).first()
    assert (r.cx, r.cy) == (485 / 1920, 545 / 1080)


def test_runs(spark):
    run = lambda flags: spans(series.runs_of_false(spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "session_id long, idx long, ok boolean"), 500_000, 2 * US))
    assert run([True] * 2 + [False] * 7 + [True] * 2) == [(1.0, 4.5)]
    assert run([True] * 2 + [False] * 6) == [(1.0, 4.0)]


def test_clusters(spark):
    def run(t, ws, we):
        ev = spark.createDataFrame([(1, 0, us(x), 0.5, 0.5) for x in t], "session_id long, win int, t_us long, x double, y double")
        return spans(series.clusters(ev, spark.createDataFrame([(1, 0, us(ws), us(we))], "session_id long, win int, ws long, we long"), 2.0))

    assert run([5.0], 4, 7) == [(4.8, 5.6)]
    assert len(run([5.0, 8.0], 4, 10)) == 2
    assert run([5.1], 5, 6)[0][0] == 5.0


def vectors(spark, rows):
    return spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(rows)], "session_id long, idx long, v array<double>")


def test_gap_scores(spark):
    same = series.gap_scores(vectors(spark, [(1, 2)] * 10), 3).collect()
    assert len(same) == 5 and all(abs(r.score) < 1e-9 for r in same)
    assert [round(r.score, 9) for r in series.gap_scores(vectors(spark, [(1, 0)] * 5 + [(0, 1)] * 5), 5).collect()] == [1.0]


def test_smooth_short_series(spark):
    run = lambda v: [round(r.score, 9) for r in series.smooth3(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "session_id long, gap long, score double")).orderBy("gap").collect()]
    assert run([3.0]) == [1.0, 1.0, 1.0]
    assert run([3.0, 6.0]) == [1.0, 3.0, 2.0]
    assert run([3.0, 3.0, 3.0]) == [2.0, 3.0, 2.0]


def test_fixed_chunks(spark):
    s = spark.createDataFrame([(1, i, us(i), us(i + 0.9)) for i in range(180)], "session_id long, idx long, s long, e long")
    out = folds.fixed_chunks(s).orderBy("first").collect()
    assert len(out) == 3 and out[-1].e == us(179.9) and out[0].first == 0 and out[-1].last == 180


def test_dedup_uses_the_last_kept(spark):
    m = spark.createDataFrame([(1, i, us(t)) for i, t in enumerate([0, 10, 16, 25, 31])], "session_id long, idx long, t_us long")
    assert sorted(r.t_us / US for r in folds.dedup_min_gap(m).collect()) == [0, 16, 31]


def test_sentences(spark):
    w = [("a", 0, 0.2), ("b.", 0.3, 0.5), ("c", 0.6, 0.8), ("d", 2.0, 2.2), ("e", 2.3, 2.5)]
    df = spark.createDataFrame([(1, i, x, us(s), us(e)) for i, (x, s, e) in enumerate(w)], "session_id long, word_idx long, word string, s long, e long")
    assert [r.text for r in series.sentences(df).orderBy("idx").collect()] == ["a b.", "c d", "e"]


def test_verify_cuts_stops(spark):
    cuts = spark.createDataFrame([(1, i, us(10), us(20)) for i in range(3)], "session_id long, cut_id long, s long, e long")

    def verdict(df):
        return df.withColumns({"decision": F.when(F.col("cut_id") == 0, "accept").when(F.col("cut_id") == 1, "trim").otherwise("trim"), "vs": F.when(F.col("cut_id") == 1, F.col("s")).otherwise(F.col("s") + us(1)), "ve": F.col("e") - us(1)})

    out = {r.cut_id: (r.decision, r.level, r.s / US, r.e / US, r.original_e / US) for r in folds.verify_cuts(cuts, verdict).collect()}
    assert out == {0: ("accept", 0, 10, 20, 20), 1: ("trim", 2, 10, 17, 20), 2: ("reject", 0, 10, 20, 20)}


def test_one_euro_keeps_a_constant(spark):
    s = spark.createDataFrame([(1, us(i), us(i + 1), 0.4, 0.6) for i in range(5)], "session_id long, s long, e long, cx double, cy double")
    assert all(abs(r.cx - 0.4) < 1e-12 and abs(r.cy - 0.6) < 1e-12 for r in folds.one_euro(s).collect())
