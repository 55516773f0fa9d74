"""Queries over whole tables and whole texts against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

import tempograph.plans as plans
from tempograph.plans.adapters import Source

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def source(spark):
    return Source(spark, FOLDER)


@pytest.fixture(scope="module")
def nearest(source):
    """hint_id: the nearest move as (t_us, x, y), none if it is later by over 0.5 s; for each of the hints."""
    moves, out = defaultdict(list), {}
    for m in source.cursor_sparse.where("event = 'move'").collect():
        moves[m.session_id].append((m.t_us, m.row_seq, m.x, m.y))
    for h in source.hints.collect():
        best = min(moves[h.session_id], key=lambda m, at=h.s: (abs(m[0] - at), m[0], m[1]), default=None)
        out[h.hint_id] = (best[0], best[2], best[3]) if best and best[0] - h.s <= 500_000 else (None, None, None)
    return out


def rows_of(spark, name):
    return plans.queries()[name](spark, FOLDER).collect()


def test_asof_nearest(spark, nearest):
    got = {r.point_id: (r.mt, r.x, r.y) for r in rows_of(spark, "asof_nearest")}
    assert got == nearest


def test_hints_to_zooms(spark, source, nearest):
    ends = {r.session_id: r.duration for r in source.durations.collect()}
    want = {}
    for h in source.hints.collect():
        if h.session_id in ends and min(h.e, ends[h.session_id]) > h.s:
            _, x, y = nearest[h.hint_id]
            want[h.hint_id] = (h.s, min(h.e, ends[h.session_id]), {"soft": 1.25, "strong": 1.7}.get(h.strength, 1.5), 0.5 if x is None else x, 0.5 if y is None else y)
    assert {r.hint_id: (r.s, r.e, r.zoom, r.cx, r.cy) for r in rows_of(spark, "hints_to_zooms")} == want


def test_clip_to_bounds(spark, source):
    zooms = defaultdict(list)
    for z in source.zooms.collect():
        zooms[z.session_id].append(z)
    want = Counter()
    for lay in source.layout.where("layout in ('pip', 'screen_full')").collect():
        for z in zooms[lay.session_id]:
            if z.e > lay.s + 1 and z.s < lay.e - 1:
                want[lay.session_id, max(z.s, lay.s), min(z.e, lay.e), z.zoom] += 1
    assert Counter((r.session_id, r.s, r.e, r.zoom) for r in rows_of(spark, "clip_to_bounds")) == want


def test_clip_transcript(spark, source):
    text = {(r.session_id, r.idx): r.text.strip(" ") for r in source.sents.collect()}
    want = {(d, i): " ".join(text[d, j] for j in range(i, i + i % 4) if (d, j) in text) for d, i in text}
    assert {(r.session_id, r.clip_id): r.text for r in rows_of(spark, "clip_transcript")} == want


def test_karaoke_line(spark, source):
    want = {}
    for r in source.table("documents").collect():
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", r.text or "") if x]
        if w:
            want[r.doc_id] = " ".join(f"{{\\kf{max(1, 5 * len(x))}}}{x}" for x in w)
    assert max(len(v.split()) for v in want.values()) > 12
    assert {r.session_id: r.line for r in rows_of(spark, "karaoke_line")} == want


def test_fingerprint_of_long_texts(spark, tmp_path):
    mib = 1 << 20
    texts = {1: "short", 2: "a" * mib, 3: "é" * (3 * mib // 4), 4: "x" * mib + "y" * mib, 5: "x" * mib + "z" * 99 + "y" * mib}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in texts.items():
        b = t.encode()
        last = b[-mib:] if len(b) > 2 * mib else b""
        want[i] = (hashlib.sha256(str(len(b)).encode() + b[:mib] + last).hexdigest()[:16], hashlib.md5(b).hexdigest()[:16])
    assert {r.doc_id: (r.print, r.m) for r in plans.queries()["fingerprint"](spark, str(tmp_path)).collect()} == want
