"""Interval algebra on literal vectors, in seconds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tempograph.operators import intervals as I
from tempograph.operators import joins as J

US = 1_000_000


def us(t):
    return int(round(t * US))


def spans(spark, rows):
    return spark.createDataFrame([(1, us(s), us(e)) for s, e in rows], "session_id long, s long, e long")


def seg(spark, rows, zooms=None):
    data = [(1, us(s), us(e), lay, float(v), [(us(a), us(b), 1.5, 0.5, 0.5) for a, b in (zooms or {}).get(i, [])]) for i, (s, e, lay, v) in enumerate(rows)]
    return spark.createDataFrame(data, "session_id long, s long, e long, layout string, speed double, zooms array<struct<s:long,e:long,zoom:double,cx:double,cy:double>>")


def got(df, *cols):
    return sorted(tuple(r[c] / US if c in ("s", "e") else r[c] for c in (cols or ("s", "e"))) for r in df.collect())


def agree(spark, det, k=2, least=0.0, gap=0.5):
    rows = [(1, d, us(s), us(e)) for d, iv in det.items() for s, e in iv]
    out = I.k_of_n(spark.createDataFrame(rows, "session_id long, detector string, s long, e long"), k, us(least), us(gap))
    return got(out)


@pytest.mark.parametrize(
    ("det", "least", "want"),
    [
        ({"a": [(0, 10)], "b": [(5, 15)]}, 0, [(5, 10)]),
        ({"a": [(0, 5)], "b": [(10, 15)]}, 0, []),
        ({"a": [(0, 3)], "b": [(2, 10)]}, 2, []),
        ({"a": [(0, 5), (5.1, 10)], "b": [(0, 10)]}, 0, [(0, 10)]),
        ({"a": [(0, 5), (7, 12)], "b": [(0, 12)]}, 0, [(0, 5), (7, 12)]),
        ({"a": [(0, 5)], "b": [(3, 8)], "c": [(7, 10)]}, 0, [(3, 5), (7, 8)]),
        ({"a": [(0, 5), (5, 10)], "b": [(0, 10)]}, 0, [(0, 10)]),
        ({"a": [(0, 5)], "b": [(5, 9)]}, 0, [(5, 5)]),
    ],
)
def test_k_of_n(spark, det, least, want):
    assert agree(spark, det, 2, least) == want


def test_three_agree(spark):
    assert agree(spark, {"f": [(0, 12)], "i": [(5, 20)], "s": [(3, 10)]}, 3, 2) == [(5, 10)]
    assert agree(spark, {"f": [(5, 6.5)], "i": [(5, 6.5)], "s": [(5, 6.5)]}, 3, 2) == []
    both = [(0, 5), (10, 15)]
    assert agree(spark, {"f": both, "i": both, "s": both}, 3, 2) == both


def test_detectors_are_named(spark):
    rows = [(1, "a", 0, us(10)), (1, "b", us(5), us(15)), (1, "c", us(20), us(30))]
    out = I.k_of_n(spark.createDataFrame(rows, "session_id long, detector string, s long, e long"), 2, 0)
    assert [r.detectors for r in out.collect()] == [["a", "b"]]


def test_merge_gap(spark):
    assert got(I.merge_gap(spans(spark, [(0, 1), (1.5, 2.5), (5, 6)]))) == [(0, 2.5), (5, 6)]
    assert got(I.merge_gap(spans(spark, [(0, 1), (2, 3)]))) == [(0, 1), (2, 3)]
    assert got(I.merge_gap(spans(spark, [(0, 10), (1, 2), (10.8, 11)]))) == [(0, 11)]


@pytest.mark.parametrize(
    ("rows", "n"),
    [([(0, 10, "pip", 1), (10, 20, "pip", 1)], 1), ([(0, 10, "pip", 1), (10, 20, "cam_full", 1)], 2), ([(0, 10, "pip", 1), (10, 20, "pip", 4)], 2), ([(0, 10, "pip", 1), (15, 20, "pip", 1)], 2)],
)
def test_merge_adjacent(spark, rows, n):
    out = I.merge_adjacent(seg(spark, rows, {0: [(1, 2)], 1: [(16, 17)]})).collect()
    assert len(out) == n
    assert sum(len(r.zooms) for r in out) == 2


@pytest.mark.parametrize(
    ("rows", "cuts", "want"),
    [
        ([(0, 10)], [(3, 7)], [(0, 3), (7, 10)]), ([(0, 10)], [(0, 3)], [(3, 10)]), ([(0, 10)], [(7, 10)], [(0, 7)]), ([(5, 10)], [(0, 20)], []),
        ([(0, 10), (10, 20)], [(5, 15)], [(0, 5), (15, 20)]), ([(0, 10)], [(5, 5)], [(0, 10)]), ([(0, 10)], [(7, 3)], [(0, 10)]), ([(0, 20)], [(3, 5), (10, 12)], [(0, 3), (5, 10), (12, 20)]),
    ],
)
def test_subtract(spark, rows, cuts, want):
    assert got(I.subtract(seg(spark, [(a, b, "pip", 1) for a, b in rows]), spans(spark, cuts))) == want


def test_repeated_segments_stay_repeated(spark):
    twice = seg(spark, [(0, 10, "pip", 1), (0, 10, "pip", 1), (20, 200, "pip", 1), (20, 200, "pip", 1), (20, 200, "pip", 1)])
    assert got(I.subtract(twice, spans(spark, [(3, 4), (100, 110)]))) == sorted([(0, 3), (4, 10)] * 2 + [(20, 100), (110, 200)] * 3)
    assert got(I.apply_zones(twice, zones(spark, [(5, 8, "speed@4x")])), "s", "e", "speed") == sorted([(0, 5, 1), (5, 8, 4), (8, 10, 1)] * 2 + [(20, 200, 1)] * 3)
    z = spark.createDataFrame([(1, us(2), us(6), 1.5, 0.5, 0.5)] * 2, "session_id long, s long, e long, zoom double, cx double, cy double")
    out = J.annotate_zooms(twice.drop("zooms"), z).collect()
    assert sorted((r.s, len(r.zooms)) for r in out) == [(0, 2)] * 2 + [(us(20), 0)] * 3


def test_subtract_cuts_zooms(spark):
    out = I.subtract(seg(spark, [(0, 10, "pip", 1)], {0: [(2, 8)]}), spans(spark, [(4, 6)])).orderBy("s").collect()
    assert [[(z.s / US, z.e / US) for z in r.zooms] for r in out] == [[(2, 4)], [(6, 8)]]


def zones(spark, rows):
    return spark.createDataFrame([(1, us(s), us(e), a, i) for i, (s, e, a) in enumerate(rows)], "session_id long, s long, e long, action string, zone_seq long")


@pytest.mark.parametrize(
    ("z", "want"),
    [
        ([(5, 10, "speed@4x")], [(0, 5, 1), (5, 10, 4), (10, 20, 1)]), ([(5, 10, "cut")], [(0, 5, 1), (10, 20, 1)]), ([(5, 10, "odd")], [(0, 20, 1)]), ([(5, 10, "speed@0x")], [(0, 20, 1)]),
        ([(2, 10, "speed@4x"), (5, 15, "speed@8x")], [(0, 2, 1), (2, 5, 4), (5, 10, 8), (10, 15, 8), (15, 20, 1)]),
    ],
)
def test_zones(spark, z, want):
    assert got(I.apply_zones(seg(spark, [(0, 20, "pip", 1)]), zones(spark, z)), "s", "e", "speed") == want


@pytest.mark.parametrize(
    ("rows", "total", "want"),
    [
        ([(5, 15, "cam_full")], 15, [(0, 5, "pip"), (5, 15, "cam_full")]), ([(0, 10, "cam_full"), (15, 30, "pip")], 30, [(0, 15, "cam_full"), (15, 30, "pip")]),
        ([(0, 20, "cam_full"), (15, 30, "pip")], 30, [(0, 20, "cam_full"), (20, 30, "pip")]), ([(0, 30, "cam_full"), (5, 10, "pip")], 30, [(0, 30, "cam_full")]), ([], 30, [(0, 30, "pip")]),
    ],
)
def test_fill_coverage(spark, rows, total, want):
    data = spark.createDataFrame([(1, us(s), us(e), lay) for s, e, lay in rows], "session_id long, s long, e long, layout string")
    assert got(I.fill_coverage(data, spark.createDataFrame([(1, us(total))], "session_id long, total long")), "s", "e", "layout") == want


def test_idle(spark):
    def run(t, dur):
        ev = spark.createDataFrame([(1, us(x), "move") for x in t], "session_id long, t_us long, event string")
        return got(I.cursor_idle(ev, spark.createDataFrame([(1, us(dur))], "session_id long, duration long")))

    assert run([], 10) == [(0, 10)]
    assert run([3.0, 3.1, 3.2], 5) == [(0, 3)]
    assert run([0.5, 1, 1.5], 10) == [(1.5, 10)]


def test_split_at_zooms(spark):
    out = I.split_at_zooms(seg(spark, [(0, 10, "pip", 1), (10, 20, "pip", 1)], {0: [(2, 6), (4, 8), (5, 6)]}))
    assert got(out) == [(0, 2), (2, 6), (6, 8), (8, 10), (10, 20)]


def test_sample_points(spark):
    def run(s, e):
        return spark.range(1).select(I.sample_points(F.lit(us(s)), F.lit(us(e)), 8, 2 * US).alias("p")).first().p

    assert run(0, 5) == [0, us(2.5), us(5)]
    assert len(run(0, 70)) == 8
    assert run(10, 10.5) == [us(10), us(10.5)]
    assert run(10, 10) == [us(10)]
    assert run(10, 5) is None


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([(0, 10, "pip", 1), (5, 15, "pip", 1)], "overlap"), ([(10, 5, "pip", 1)], "reversed"), ([(0, 99, "pip", 1)], "outside"), ([(0, 10, "odd", 1)], "layout"),
        ([(0, 10, "pip", 0)], "speed"), ([], "empty"), ([(0, 10, "pip", 1)], None),
    ],
)
def test_violations(spark, rows, rule):
    out = I.violations(seg(spark, rows), spark.createDataFrame([(1, us(30))], "session_id long, duration long")).collect()
    assert [r.rule for r in out] == ([rule] if rule else [])
    if rule is None:
        bad = I.violations(seg(spark, rows, {0: [(5, 12)]}), spark.createDataFrame([(1, us(30))], "session_id long, duration long")).collect()
        assert [r.rule for r in bad] == ["zoom"]


def test_annotate(spark):
    z = spark.createDataFrame([(1, us(2), us(4), 1.5, 0.5, 0.5)], "session_id long, s long, e long, zoom double, cx double, cy double")
    out = J.annotate_zooms(seg(spark, [(0, 11, "cam_full", 1), (11, 13, "pip", 1), (13, 20, "screen_full", 1)]), z, us(10)).orderBy("s").collect()
    assert [[(x.s / US, x.e / US) for x in r.zooms] for r in out] == [[], [(12, 13)], [(13, 14)]]


def test_overlap_join_over_buckets(spark):
    a = spark.createDataFrame([(1, 0, us(500))], "session_id long, s long, e long")
    b = spark.createDataFrame([(1, us(10), us(400)), (1, us(500), us(600)), (1, us(501), us(502))], "session_id long, bs long, be long")
    assert I.overlap_join(a, b, "s", "e", "bs", "be").count() == 2


def test_length_is_conserved(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        t, rows = 0.0, []
        for _ in range(30):
            rows.append((t, t := t + rng.uniform(0.5, 5), rng.choice(["pip", "cam_full"]), 1))
        cuts = [(c := rng.uniform(0, t), c + rng.uniform(0, 6)) for _ in range(20)]
        line, away = seg(spark, rows), spans(spark, cuts)
        kept = sum(r.e - r.s for r in I.subtract(line, away).collect())
        gone = sum(max(0, min(us(t), r.e) - r.s) for r in I.merge_gap(away, 0).collect())
        assert abs(kept + gone - us(t)) <= 100
