"""Scalar expressions, readers, writers, model calls and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tempograph.functions import text as T
from tempograph.operators import model
from tempograph.sources import readers, writers
from tempograph.streaming import windows

US = 1_000_000


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_logs(spark):
    log = "x freeze_start: 5.883333\nfreeze_end: 13.7 | d\nfreeze_start: 13.7\nfreeze_end: 16.7\nsilence_start: 0\nsilence_end: 7.185896 | silence_duration: 7\nsilence_start: 99"
    got = lambda k: [(r.s / US, r.e / US) for r in one(spark, T.log_intervals(F.lit(log), k))]
    assert got("freeze") == [(5.883333, 13.7), (13.7, 16.7)]
    assert got("silence") == [(0, 7.185896)]


@pytest.mark.parametrize(("t", "want"), [(3.5, "0:00:03.50"), (65.12, "0:01:05.12"), (3723.4, "1:02:03.40")])
def test_ass_time(spark, t, want):
    assert one(spark, T.ass_time(F.lit(int(round(t * US))))) == want


def test_karaoke(spark):
    assert one(spark, T.karaoke(F.lit(" hi "), F.lit(0), F.lit(300_000))) == "{\\kf30}hi"
    assert one(spark, T.karaoke(F.lit("x"), F.lit(5), F.lit(5))) == "{\\kf1}x"


@pytest.mark.parametrize(("t", "want"), [("a {\"x\": {\"y\": 1}} b }", '{"x": {"y": 1}}'), ("none", None), ("{ open", None), (None, None)])
def test_extract_json(spark, t, want):
    assert one(spark, T.extract_json(F.lit(t).cast("string"))) == want


def test_strings(spark):
    assert one(spark, T.slugify(F.lit("  Hello, World!! "))) == "hello_world"
    assert one(spark, T.slugify(F.lit("??"))) == "clip"
    assert len(one(spark, T.slugify(F.lit("x" * 99)))) == 40
    assert one(spark, T.strip_thinking(F.lit("<think>a\nb</think> ok"))) == "ok"


@pytest.mark.parametrize(("v", "want"), [(1.0, []), (4.0, ["atempo=2", "atempo=2"]), (3.0, ["atempo=2", "atempo=1.5"]), (0.5, ["atempo=0.5"]), (16.0, ["atempo=2"] * 4), (17.0, None), (0.4, None)])
def test_atempo(spark, v, want):
    assert one(spark, T.atempo_chain(F.lit(v))) == want


@pytest.mark.parametrize(("text", "dual", "want"), [("look at this, right here", True, "split_vstack"), ("What if", True, "cam_full"), ("what if you notice", True, "split_vstack"), ("notice notice", False, "screen_full"), ("", True, "split_vstack")])
def test_layout(spark, text, dual, want):
    assert one(spark, T.pick_layout(F.lit(text), F.lit(dual))) == want


def test_scores(spark):
    assert one(spark, T.punctuation_density(F.lit(""))) == 0
    assert one(spark, T.length_preference(F.lit(120.0), 30, 60)) == 0
    assert abs(one(spark, T.composite(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) - 0.5 / 0.55) < 1e-12
    assert one(spark, T.smoothstep_zoom(F.lit(1.0), F.lit(2.0), F.lit(1.5))) == 1.5
    assert one(spark, T.smoothstep_zoom(F.lit(0.0), F.lit(2.0), F.lit(1.5))) == 1.0


def test_fingerprint_skips_the_middle(spark):
    import hashlib

    data = bytes(range(256)) * 4096 * 3
    want = hashlib.sha256(str(len(data)).encode() + data[: 1 << 20] + data[-(1 << 20) :]).hexdigest()[:16]
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(T.fingerprint(F.col("b")).alias("v")).first().v == want


def test_cursor_files(spark, tmp_path):
    d = tmp_path / "12"
    d.mkdir()
    (d / "cursor.csv").write_text("t_s,event,x,y,button,down\n1.5,click,96,54,left,1\nbad,move,1,1,,\n2.5,click,5000,1,left,1\n3,move,192,,,\n2,clap,0,0,,\n1,clap,0,0,,\n")
    ev = readers.normalize(spark.read.option("header", True).csv(str(d)).select(F.lit(12).alias("session_id"), F.monotonically_increasing_id().alias("row_seq"), "t_s", "x", "y", "event", "button", "down"), 1920, 1080)
    assert sorted((r.t_us, r.event) for r in ev.collect()) == [(1_000_000, "clap"), (1_500_000, "click"), (2_000_000, "clap")]
    assert readers.cursor(spark, str(d)).select("session_id").first().session_id == 12
    assert readers.first_clap(ev).first().clap_us == 2_000_000
    assert readers.cursor(spark, str(tmp_path / "none")).count() == 0


def test_json_files(spark, tmp_path):
    d = tmp_path / "3"
    d.mkdir()
    (d / "cues.json").write_text('{"cues": [{"start": 1, "end": 2}, {"start": 3}, {"start": 4, "end": 5, "confidence": "low"}, {"start": 6, "end": 7, "confidence": "odd"}]}')
    got = readers.cues(readers.documents(spark, str(d / "cues.json"), "dead_zone_cues"))
    assert [(r.session_id, r.s, r.confidence) for r in got.orderBy("s").collect()] == [(3, US, "high"), (3, 4 * US, "low"), (3, 6 * US, "high")]
    assert readers.cuts(readers.documents(spark, str(d / "missing.json"), "filler_cuts")).count() == 0
    (d / "hints.json").write_text("{broken")
    assert readers.hints(readers.documents(spark, str(d / "hints.json"), "zoom_hints")).count() == 0


def words(spark):
    w = [("hello", 0, 0.4), ("wide", 0.4, 0.8), ("world", 0.8, 1.2), ("again", 3.0, 3.5)]
    return spark.createDataFrame([(1, i, x, int(s * US), int(e * US)) for i, (x, s, e) in enumerate(w)], "session_id long, word_idx long, word string, s long, e long")


def test_captions(spark, tmp_path):
    ass = writers.captions(words(spark)).first().ass
    assert ass.count("Dialogue:") == 2 and ass.startswith("[Script Info]")
    assert "Dialogue: 0,0:00:00.00,0:00:01.20,Default,,0,0,0,,{\\kf40}hello {\\kf40}wide {\\kf40}world" in ass
    writers.write_json(writers.captions(words(spark)), str(tmp_path / "ass"))
    writers.write_json(writers.captions(words(spark).where("false")), str(tmp_path / "ass"), once=True)
    assert spark.read.json(str(tmp_path / "ass")).count() == 1


def test_model_falls_back_and_validates(spark):
    def bad():
        def f(prompt):
            raise RuntimeError

        return f

    def good():
        return lambda prompt: '<think>x</think>{"cuts": [{"start": 1.5, "end": 2, "reason": "um"}]}'

    out = model.analyse(words(spark), "t", readers.SCHEMAS["filler_cuts"], "cuts", [bad, good], wait=0).collect()
    assert [(r.start, r.end, r.reason, r.confidence) for r in out] == [(1.5, 2.0, "um", None)]
    assert model.call(model.transcript_prompts(words(spark), "t"), [bad], wait=0).first().answer is None


def test_streams_see_new_files_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 0), (1, 3 * US), (2, 0)], "session_id long, t_us long").write.parquet(folder)
    live = windows.events(spark, folder, "session_id long, t_us long")
    assert [(r.s, r.e) for r in windows.drain(windows.idle(live, 2 * US)).collect()] == [(0, 3 * US)]
