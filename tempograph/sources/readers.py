"""Readers of the pipeline's artefacts: explicit schemas, bad values become null and are skipped, a missing file is an empty table.

Every JSON artefact is one document for each session; its path's folder name is the session, or a session_id column is given.
All times come in seconds and leave in whole microseconds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURSOR = "t_s string, x string, y string, event string, button string, down string"
# The artefacts' fields, which other programs write and read.
SCHEMAS = {
    "layout_plan": "segments array<struct<start:double,end:double,layout:string>>",
    "zoom_hints": "hints array<struct<anchor_word_idx:int,start:double,end:double,strength:string,reason:string>>",
    "dead_zone_cues": "cues array<struct<start:double,end:double,reason:string,confidence:string>>",
    "dead_zones": "zones array<struct<start:double,end:double,action:string,detectors:array<string>>>, dead_zones array<struct<start:double,end:double,action:string,detectors:array<string>>>",
    "silence_intervals": "noise_db double, min_sec double, intervals array<struct<start:double,end:double>>",
    "face_absent": "cam_path string, sample_rate_hz double, min_absence_sec double, absences array<struct<start:double,end:double>>",
    "segments": "source_duration_s double, segments array<struct<start:double,end:double,speed:double,layout:string,cursor_zooms:array<struct<start:double,end:double,zoom:double,cx:double,cy:double>>>>",
    "sync": "csv_to_video_offset_s double, video_to_video_offset_s double, flash_video_s double, clap_csv_s double, clap_audio_s double, method string, confidence double",
    "asr": "segments array<struct<words:array<struct<word:string,start:double,end:double,probability:double>>>>, language string",
    "ranked": "ranked array<struct<candidate:struct<start:double,end:double,sentence_idx_range:array<int>>,llm:struct<score:double,title:string,reason:string,start_offset:double,end_offset:double>,audio_energy:double,punctuation:double,length_score:double,composite:double,effective_start:double,effective_end:double>>",
}
SCHEMAS |= {
    "probe": "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>, format struct<duration:string>",
    "ocr": "second long, found array<struct<polygon:array<array<double>>,text:string>>",
    "scenes": "scenes array<struct<start:double,end:double>>",
}
SCHEMAS |= {"filler_cuts": "cuts array<struct<start:double,end:double,reason:string,confidence:string>>"}


def us(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1_000_000).cast("long")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)) > 0


def documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents of one kind with session_id (the number in the folder's name, 0 if none); malformed ones give nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"session_id long, {SCHEMAS[kind]}")
    raw = spark.read.option("wholetext", True).text(path).select(F.coalesce(F.regexp_extract(F.input_file_name(), r"(\d+)/[^/]*$", 1).try_cast("long"), F.lit(0)).alias("session_id"), "value")
    return parsed(raw, "value", kind)


def parsed(raw: DataFrame, text: str, kind: str) -> DataFrame:
    """Documents from a text column next to session_id."""
    one = raw.select("session_id", F.from_json(text, SCHEMAS[kind], {"mode": "PERMISSIVE"}).alias("_document"))
    return one.where("_document is not null").select("session_id", "_document.*")


def cursor(spark: SparkSession, path: str, schema: str = CURSOR) -> DataFrame:
    """Cursor logs with a header line, columns by name: row_seq, t_us, x, y, event, down; rows without numbers are skipped."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        raw = spark.createDataFrame([], schema)
    session = F.coalesce(F.regexp_extract(F.input_file_name(), r"(\d+)/[^/]*$", 1).try_cast("long"), F.lit(0))
    return normalize(raw.select(session.alias("session_id"), F.monotonically_increasing_id().alias("row_seq"), *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("t_s", "x", "y", "event", "button", "down")]))


def normalize(raw: DataFrame, width: float = 1.0, height: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """All-string rows as numbers, places as fractions of the screen; clicks count only if pressed and on it."""
    n = lambda c: F.trim(F.col(c)).try_cast("double")
    out = raw.select("session_id", "row_seq", us(n("t_s")).alias("t_us"), ((n("x") - x0) / width).alias("x"), ((n("y") - y0) / height).alias("y"), "event", "down")
    out = out.where("t_us is not null and x is not null and y is not null")
    return out.where("event <> 'click' or (down = '1' and x between 0 and 1 and y between 0 and 1)")


def first_clap(events: DataFrame) -> DataFrame:
    """Time of the first clap by file order of each session."""
    return events.where("event = 'clap'").groupBy("session_id").agg(F.min_by("t_us", "row_seq").alias("clap_us"))


def spans(docs: DataFrame, field: str, *more: str) -> DataFrame:
    """One row for each item of an array field with start and end; the ones without are skipped."""
    rows = docs.select("session_id", F.posexplode(field).alias("seq", "x")).where("x.start is not null and x.end is not null")
    return rows.select("session_id", "seq", us("x.start").alias("s"), us("x.end").alias("e"), *(F.col(f"x.{m}").alias(m) for m in more))


def cuts(docs: DataFrame) -> DataFrame:
    return spans(docs, "cuts").select("session_id", "s", "e")


def layout(docs: DataFrame) -> DataFrame:
    """Layout segments merged where neighbours touch and agree."""
    from tempograph.operators.intervals import merge_adjacent

    return merge_adjacent(spans(docs, "segments", "layout").withColumn("speed", F.lit(1.0)))


def dead_zones(docs: DataFrame) -> DataFrame:
    """Zones, under either key; an empty list falls through to the other."""
    either = docs.withColumn("z", F.when(F.size("zones") > 0, F.col("zones")).otherwise(F.col("dead_zones")))
    return spans(either, "z", "action", "detectors").withColumnRenamed("seq", "zone_seq")


def cues(docs: DataFrame) -> DataFrame:
    """Cues; a missing or unknown confidence is high."""
    return spans(docs, "cues", "reason", "confidence").withColumn("confidence", F.when(F.col("confidence") == "low", "low").otherwise("high"))


def hints(docs: DataFrame) -> DataFrame:
    return spans(docs, "hints", "anchor_word_idx", "strength", "reason")


def segments(docs: DataFrame) -> DataFrame:
    """The edit list with its nested zooms in microseconds."""
    out = spans(docs, "segments", "speed", "layout", "cursor_zooms")
    zoom = lambda z: F.struct(us(z["start"]).alias("s"), us(z["end"]).alias("e"), z["zoom"].alias("zoom"), z["cx"].alias("cx"), z["cy"].alias("cy"))
    return out.withColumn("zooms", F.transform("cursor_zooms", zoom)).drop("cursor_zooms")


def words(docs: DataFrame) -> DataFrame:
    """Speech recognition's nested segments as flat words in order; words without times are skipped, no probability is 0."""
    w = docs.select("session_id", F.posexplode("segments").alias("i", "g")).select("session_id", "i", F.posexplode("g.words").alias("j", "w")).where("w.start is not null and w.end is not null")
    return w.select("session_id", "i", "j", F.trim("w.word").alias("word"), us("w.start").alias("s"), us("w.end").alias("e"), F.coalesce("w.probability", F.lit(0.0)).alias("probability"))


def ranked(docs: DataFrame) -> DataFrame:
    return docs.select("session_id", F.posexplode("ranked").alias("rank", "r")).select("session_id", "rank", us("r.effective_start").alias("s"), us("r.effective_end").alias("e"), F.col("r.llm.title").alias("title"), F.col("r.composite").alias("composite"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with a content fingerprint, as keys of caches."""
    from tempograph.functions.text import fingerprint

    return spark.read.format("binaryFile").load(path).select("path", "length", fingerprint(F.col("content")).alias("print"))


def media(docs: DataFrame) -> DataFrame:
    """The session dimension from a probe's documents: duration, and width, height and frames a second of the first video stream."""
    d = docs.where("streams is not null").withColumn("_v", F.filter("streams", lambda x: x["codec_type"] == "video")).withColumn("_v", F.get("_v", F.lit(0)))
    rate = F.split("_v.r_frame_rate", "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return d.select("session_id", us(F.col("format.duration").try_cast("double")).alias("duration"), "_v.width", "_v.height", fps.alias("fps"))


def text_boxes(docs: DataFrame) -> DataFrame:
    """Text recognition's polygons as boxes: session_id, second, box_seq, x, y, w, h, text; entries without points are skipped."""
    rows = docs.select("session_id", "second", F.posexplode("found").alias("box_seq", "f")).where("size(f.polygon) > 0")
    at = lambda k: F.transform("f.polygon", lambda p: F.get(p, F.lit(k)))
    low, high = (lambda k: F.array_min(at(k))), (lambda k: F.array_max(at(k)))
    return rows.select("session_id", "second", "box_seq", low(0).alias("x"), low(1).alias("y"), (high(0) - low(0)).alias("w"), (high(1) - low(1)).alias("h"), F.col("f.text").alias("text")).where("x is not null and y is not null")


def scenes(docs: DataFrame, durations: DataFrame) -> DataFrame:
    """Scenes (session_id, seq, s, e); a session without any is one scene from 0 to its duration."""
    found = spans(docs, "scenes")
    whole = durations.join(found.select("session_id").distinct(), "session_id", "left_anti")
    return found.unionByName(whole.select("session_id", F.lit(0).alias("seq"), F.lit(0).cast("long").alias("s"), F.col("duration").alias("e")))


def head(samples: DataFrame, limit: int = 30_000_000) -> DataFrame:
    """Samples (t_us) of the scan window, the first ``limit`` microseconds, in which sync marks are looked for."""
    return samples.where(F.col("t_us") < limit)
