"""Readers and writers of media facts and logs, and model calls that are checked."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tempograph.operators import model
from tempograph.sources import readers, writers


def test_media_of_odd_probes(spark):
    rows = [(1, json.dumps({"streams": [{"codec_type": "video", "width": 8, "height": 6, "r_frame_rate": "30000/1001"}], "format": {"duration": "2.5"}})), (2, json.dumps({"streams": [{"codec_type": "audio"}], "format": {"duration": "N/A"}})), (3, json.dumps({"streams": [{"codec_type": "video", "r_frame_rate": "0/0"}]})), (4, "no json")]
    docs = readers.parsed(spark.createDataFrame(rows, "session_id long, value string"), "value", "probe")
    got = {r.session_id: (r.duration, r.width, r.height, r.fps and round(r.fps, 3)) for r in readers.media(docs).collect()}
    assert got == {1: (2_500_000, 8, 6, 29.97), 2: (None, None, None, None), 3: (None, None, None, None)}


def test_scenes_fall_back_to_one(spark):
    docs = readers.parsed(spark.createDataFrame([(1, '{"scenes": [{"start": 0, "end": 1.5}, {"start": 1.5}]}'), (2, '{"scenes": []}')], "session_id long, value string"), "value", "scenes")
    durations = spark.createDataFrame([(1, 9), (2, 7), (3, 5)], "session_id long, duration long")
    assert sorted((r.session_id, r.s, r.e) for r in readers.scenes(docs, durations).collect()) == [(1, 0, 1_500_000), (2, 0, 7), (3, 0, 5)]


def test_log_is_appended(spark, tmp_path):
    row = spark.createDataFrame([(1, 2, "accept")], "session_id long, cut_id long, decision string")
    for _ in range(2):
        writers.append_log(row, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_caches_round_trip(spark):
    clips = spark.createDataFrame([(1, 0, 0, 9_000_000, 0, 3, 7.5, "t", "r", 0.5, 0.1, 1.0, 0.8, 1_000_000, 8_000_000)], "session_id long, rank int, s long, e long, first long, last long, llm double, title string, reason string, audio double, punctuation double, length_score double, composite double, effective_s long, effective_e long")
    text = writers.ranked(clips).select("session_id", F.to_json(F.struct("ranked")).alias("value"))
    assert [tuple(r) for r in readers.ranked(readers.parsed(text, "value", "ranked")).collect()] == [(1, 0, 1_000_000, 8_000_000, "t", 0.8)]
    hints = spark.createDataFrame([(1, 4, 0, 2_000_000, "soft", "r"), (1, 2, 5_000_000, 6_000_000, None, None)], "session_id long, anchor_word_idx long, s long, e long, strength string, reason string")
    text = writers.zoom_hints(hints).select("session_id", F.to_json(F.struct("hints")).alias("value"))
    assert sorted((r.s, r.e, r.anchor_word_idx, r.strength) for r in readers.hints(readers.parsed(text, "value", "zoom_hints")).collect()) == [(0, 2_000_000, 4, "soft"), (5_000_000, 6_000_000, 2, None)]
    assert writers.layout_plan(spark.createDataFrame([(1, 0, 1, "pip")], "session_id long, s long, e long, layout string")).count() == 1


def test_segments_of_words(spark):
    words = spark.createDataFrame([(1, i, w, i * 10, i * 10 + 5) for i, w in enumerate(["a", " ", "b.", "c", "d!", "e"])], "session_id long, word_idx long, word string, s long, e long")
    assert sorted((r.segment, r.s, r.e, r.text) for r in writers.word_segments(words).collect()) == [(0, 0, 25, "a b."), (1, 30, 45, "c d!"), (2, 50, 55, "e")]


def test_answers_that_do_not_hold_are_asked_again(spark):
    def client():
        said = iter(["no json", '{"other": 1}', 'x {"score": 3, "end_offset": 1.5}'])
        return lambda prompt: next(said)

    clips = spark.createDataFrame([(1, 0, 9_000_000, "text")], "session_id long, s long, e long, text string").coalesce(1)
    (r,) = model.score_clips(clips, "task", [client], tries=3, wait=0.0).collect()
    assert (r.llm, r.title, r.effective_s, r.effective_e) == (3.0, "", 0, 7_500_000)
    (r,) = model.score_clips(clips, "task", [client], tries=2, wait=0.0).collect()
    assert (r.llm, r.title, r.effective_s, r.effective_e) == (None, None, 0, 9_000_000)
