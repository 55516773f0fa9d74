"""Writers of the pipeline's artefacts.  One row for each session, written in parallel; times leave in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions.text import ass_time, karaoke
from tempograph.operators.folds import caption_lines

# The caption style, and the head of a caption file.
STYLE = {"font": "Montserrat ExtraBold", "size": 88, "primary": "&H00FFFFFF", "secondary": "&H0000FFFF", "outline": 4, "shadow": 1, "w": 1080, "h": 1920}
CAPTION_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: {w}
PlayResY: {h}
ScaledBorderAndShadow: yes
WrapStyle: 2

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,{font},{size},{primary},{secondary},&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,{outline},{shadow},2,40,40,120,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def seconds(c: str) -> Column:
    return F.col(c) / 1_000_000


def nested(rows: DataFrame, field: str, order: str, *items: Column) -> DataFrame:
    """One row for each session with an array of its rows in order."""
    a = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*items).alias("x")))), lambda r: r["x"])
    return rows.groupBy("session_id").agg(a.alias(field))


def edit_list(timeline: DataFrame, durations: DataFrame) -> DataFrame:
    """session_id, source_duration_s, segments: the canonical edit list."""
    zooms = F.transform("zooms", lambda z: F.struct((z["s"] / 1_000_000).alias("start"), (z["e"] / 1_000_000).alias("end"), z["zoom"].alias("zoom"), z["cx"].alias("cx"), z["cy"].alias("cy")))
    t = timeline if "zooms" in timeline.columns else timeline.withColumn("zooms", F.array().cast("array<struct<s:long,e:long,zoom:double,cx:double,cy:double>>"))
    out = nested(t, "segments", "s", seconds("s").alias("start"), seconds("e").alias("end"), F.col("speed"), F.col("layout"), zooms.alias("cursor_zooms"))
    return out.join(durations.select("session_id", seconds("duration").alias("source_duration_s")), "session_id")


def dead_zones(zones: DataFrame) -> DataFrame:
    return nested(zones, "zones", "s", seconds("s").alias("start"), seconds("e").alias("end"), F.col("action"), F.col("detectors"))


def sync(offsets: DataFrame) -> DataFrame:
    """One row for each session: how its sources go together.  Columns that ``offsets`` lacks are null."""
    fields = {"csv_to_video_offset_s": "double", "video_to_video_offset_s": "double", "flash_video_s": "double", "clap_csv_s": "double", "clap_audio_s": "double", "method": "string", "confidence": "double"}
    return offsets.select("session_id", *((F.col(c) if c in offsets.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))


def filler_cuts(cuts: DataFrame) -> DataFrame:
    return nested(cuts, "cuts", "s", seconds("s").alias("start"), seconds("e").alias("end"), F.col("reason"), F.col("confidence"))


def layout_plan(layout: DataFrame) -> DataFrame:
    return nested(layout, "segments", "s", seconds("s").alias("start"), seconds("e").alias("end"), F.col("layout"))


def zoom_hints(hints: DataFrame) -> DataFrame:
    return nested(hints, "hints", "s", F.col("anchor_word_idx").cast("int").alias("anchor_word_idx"), seconds("s").alias("start"), seconds("e").alias("end"), F.col("strength"), F.col("reason"))


def dead_zone_cues(cues: DataFrame) -> DataFrame:
    return nested(cues, "cues", "s", seconds("s").alias("start"), seconds("e").alias("end"), F.col("reason"), F.col("confidence"))


def ranked(clips: DataFrame) -> DataFrame:
    """Scored clips (rank, s, e, first, last, llm, title, reason, audio, punctuation, length_score, composite, effective_s, effective_e) as a cache."""
    candidate = F.struct(seconds("s").alias("start"), seconds("e").alias("end"), F.array(F.col("first").cast("int"), F.col("last").cast("int")).alias("sentence_idx_range")).alias("candidate")
    said = F.when(F.col("llm").isNotNull(), F.struct(F.col("llm").alias("score"), F.col("title"), F.col("reason"))).alias("llm")
    return nested(clips, "ranked", "rank", candidate, said, F.col("audio").alias("audio_energy"), F.col("punctuation"), F.col("length_score"), F.col("composite"), seconds("effective_s").alias("effective_start"), seconds("effective_e").alias("effective_end"))


def word_segments(words: DataFrame) -> DataFrame:
    """Words (word_idx, word, s, e) as segments that end with a word in . ! or ?: session_id, segment, s, e, text, words; blank words go."""
    along = Window.partitionBy("session_id").orderBy("word_idx")
    w = words.withColumn("word", F.trim("word")).where("word <> ''")
    ends = F.sum(F.when(F.col("word").rlike("[.!?]$"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("segment", F.coalesce(ends, F.lit(0)))
    items = F.array_sort(F.collect_list(F.struct("word_idx", "word", "s", "e")))
    out = w.groupBy("session_id", "segment").agg(items.alias("words"))
    return out.select("session_id", "segment", F.element_at("words", 1)["s"].alias("s"), F.element_at("words", -1)["e"].alias("e"), F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), "words")


def append_log(decisions: DataFrame, path: str) -> None:
    """Adds the verifier's decisions to an audit log; what is there stays."""
    decisions.write.mode("append").json(path)


def write_json(rows: DataFrame, path: str, once: bool = False) -> None:
    """JSON lines; ``once`` leaves an existing artefact as it is."""
    rows.write.mode("ignore" if once else "overwrite").json(path)


def write_partitioned(rows: DataFrame, path: str, once: bool = False) -> None:
    """Parquet by session."""
    rows.repartition("session_id").write.mode("ignore" if once else "overwrite").partitionBy("session_id").parquet(path)


def ass_header(style: dict | None = None) -> str:
    return CAPTION_HEAD.format(**STYLE | (style or {}))


def dialogue(words: DataFrame) -> DataFrame:
    """session_id, line_no, line: one karaoke line for each caption line of words (word_idx, word, s, e)."""
    w = caption_lines(words).groupBy("session_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "s", "e"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: karaoke(x["word"], x["s"], x["e"])), " ")
    start, end = ass_time(F.element_at("w", 1)["s"]), ass_time(F.element_at("w", -1)["e"])
    return w.select("session_id", "line_no", F.concat(F.lit("Dialogue: 0,"), start, F.lit(","), end, F.lit(",Default,,0,0,0,,"), text).alias("line"))


def captions(words: DataFrame, style: dict | None = None) -> DataFrame:
    """session_id, ass: a whole caption file for each session."""
    lines = dialogue(words).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("session_id", F.concat(F.lit(ass_header(style)), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("ass"))
