"""Joins of events, intervals and boxes: by overlap, containment, nearest time and nearest point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.operators.intervals import gather, overlap_join
from tempograph.settings import DEFAULTS, EPS_US, STRENGTH, VISIBLE


def annotate_zooms(timeline: DataFrame, zooms: DataFrame, offset: int = 0) -> DataFrame:
    """Each visible segment gets the zooms (s, e, zoom, cx, cy), shifted by ``offset``, that overlap it, cut to it; other
    layouts get none."""
    z = zooms.select("session_id", (F.col("s") + offset).alias("zs"), (F.col("e") + offset).alias("ze"), "zoom", "cx", "cy")
    hit = gather(timeline.drop("zooms"), z, "s", "e", "zs", "ze")
    seen = F.filter("hits", lambda x: (x["ze"] > F.col("s") + EPS_US) & (x["zs"] < F.col("e") - EPS_US) & F.col("layout").isin(*VISIBLE))
    item = lambda x: F.struct(F.greatest(x["zs"], "s").alias("s"), F.least(x["ze"], "e").alias("e"), x["zoom"].alias("zoom"), x["cx"].alias("cx"), x["cy"].alias("cy"))
    return hit.withColumn("zooms", F.array_sort(F.transform(seen, item))).drop("hits")


def centroid_in(intervals: DataFrame, moves: DataFrame, clamp: bool = False) -> DataFrame:
    """Adds cx, cy: the mean place of the moves (t_us, x, y) in each closed interval, the middle where there is none."""
    m = moves.select("session_id", "t_us", F.col("t_us").alias("t_end"), "x", "y")
    mean = overlap_join(intervals.select("session_id", "s", "e").distinct(), m, "s", "e", "t_us", "t_end").groupBy("session_id", "s", "e").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    out = intervals.join(mean, ["session_id", "s", "e"], "left")
    for c in ("cx", "cy"):
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) if clamp else F.col(c)
        out = out.withColumn(c, F.coalesce(v, F.lit(0.5)))
    return out


def asof_nearest(points: DataFrame, moves: DataFrame, tolerance: int = DEFAULTS.hint_tolerance) -> DataFrame:
    """Adds mt, x, y: the move nearest in time, the earlier one of two equally near; none if that is a later one by more
    than ``tolerance`` (an earlier one may be any time away).  ``points`` has session_id, t_us and a point_id; of moves at the same time the
    first by row_seq counts."""
    m = moves.groupBy("session_id", "t_us").agg(F.min(F.struct("row_seq", "x", "y")).alias("m"))
    both = m.select("session_id", "t_us", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point_id"), F.struct(F.col("t_us").alias("mt"), "m.x", "m.y").alias("m"))
    both = both.unionByName(points.select("session_id", "t_us", F.lit(1).alias("kind"), F.col("point_id").cast("long")), allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy("t_us", "kind")
    both = both.withColumns({"p": F.last("m", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first("m", True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("kind = 1")
    nearest = F.when(F.col("n").isNull() | (F.col("t_us") - F.col("p.mt") <= F.col("n.mt") - F.col("t_us")), F.col("p")).when(F.col("n.mt") - F.col("t_us") <= tolerance, F.col("n"))
    got = both.select("session_id", "point_id", nearest.alias("m")).select("session_id", "point_id", F.col("m.mt").alias("mt"), F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    return points.join(got, ["session_id", "point_id"])


def hints_to_zooms(hints: DataFrame, moves: DataFrame, durations: DataFrame) -> DataFrame:
    """Hints (hint_id, s, e, strength) cut to [0, duration] as zooms at the cursor's nearest place, the middle if unknown."""
    level = F.lit(DEFAULTS.zoom_level)
    for name, z in STRENGTH.items():
        level = F.when(F.col("strength") == name, z).otherwise(level)
    h = hints.join(durations, "session_id").select("session_id", F.col("hint_id").alias("point_id"), F.greatest(F.lit(0), "s").alias("s"), F.least("duration", "e").alias("e"), level.alias("zoom")).where("e > s")
    at = asof_nearest(h.withColumn("t_us", F.col("s")), moves)
    return at.select("session_id", F.col("point_id").alias("hint_id"), "s", "e", "zoom", F.coalesce("x", F.lit(0.5)).alias("cx"), F.coalesce("y", F.lit(0.5)).alias("cy"))


def zoom_priority_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of ``a`` and those of ``b`` whose middle is in no closed interval of ``a`` (b's aren't held against each other)."""
    mid = b.withColumn("_m", (F.col("s") + F.col("e")) / 2)
    lone = mid.select("session_id", F.floor("_m").cast("long").alias("m0"), F.ceil("_m").cast("long").alias("m1"), "_m").distinct()
    hit = overlap_join(lone, a.select("session_id", F.col("s").alias("as_"), F.col("e").alias("ae")), "m0", "m1", "as_", "ae").where("_m between as_ and ae").select("session_id", "_m").distinct()
    return a.unionByName(mid.join(hit, ["session_id", "_m"], "left_anti").select(a.columns))


def snap_nearest(points: DataFrame, boxes: DataFrame, width: int, height: int, most: float = DEFAULTS.snap_px) -> DataFrame:
    """Centres (point_id, second, cx, cy) moved to the nearest box centre of their session and second, by pixels, if it is at
    most ``most`` away; the first box (box_seq) of equally near ones.

    Points look in the nine squares around them: small ones first, and in larger ones only if no box is within such a square's side, so
    that in a crowd of boxes each meets a few.  Boxes at the same place count once."""
    b = boxes.select("session_id", "second", "box_seq", (F.col("x") + F.col("w") / 2).alias("bx"), (F.col("y") + F.col("h") / 2).alias("by"))
    b = b.groupBy("session_id", "second", "bx", "by").agg(F.min("box_seq").alias("box_seq"))
    near = points.select("session_id", "point_id", "second", (F.col("cx") * width).alias("px"), (F.col("cy") * height).alias("py"), F.lit(None).cast("struct<d:double,box_seq:long,bx:double,by:double>").alias("n")).distinct()
    dx, dy = F.col("px") - F.col("bx"), F.col("py") - F.col("by")
    for reach in (most / 16, most / 4, most):
        side = reach * 1.01  # rounding can't put a box within reach two squares away
        cell = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        around = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)  # noqa: B023, E731
        squares = F.flatten(F.transform(around("px"), lambda i: F.transform(around("py"), lambda j: F.struct(i.alias("i"), j.alias("j")))))  # noqa: B023
        asks = near.withColumn("q", F.explode_outer(F.when(F.col("n").isNull() & (F.abs("px") < 1e9) & (F.abs("py") < 1e9), squares))).select("*", F.col("q.i").alias("qi"), F.col("q.j").alias("qj")).drop("q")
        met = asks.join(b.withColumns({"qi": cell("bx"), "qj": cell("by")}), ["session_id", "second", "qi", "qj"], "left")
        d = F.sqrt(dx * dx + dy * dy)
        best = F.min(F.when(d <= reach, F.struct(d.alias("d"), F.col("box_seq").cast("long").alias("box_seq"), "bx", "by")))
        near = met.groupBy("session_id", "point_id", "second", "px", "py").agg(F.coalesce(F.first("n"), best).alias("n"))
    near = near.where("n is not null").groupBy("session_id", "point_id").agg(F.min("n").alias("n")).select("session_id", "point_id", (F.col("n.bx") / width).alias("nx"), (F.col("n.by") / height).alias("ny"))
    return points.join(near, ["session_id", "point_id"], "left").withColumns({"cx": F.coalesce("nx", "cx"), "cy": F.coalesce("ny", "cy")}).drop("nx", "ny")


def crop_lookup(points: DataFrame, crops: DataFrame, fx: float = 0.5, fy: float = 0.5) -> DataFrame:
    """For each point (point_id, t_us) the first crop (crop_seq, s, e, cx, cy) that covers it, else the one with the nearest
    middle, else the given centre."""
    hit = overlap_join(points.select("session_id", "point_id", "t_us", F.col("t_us").alias("t_end")), crops, "t_us", "t_end", "s", "e").groupBy("session_id", "point_id").agg(F.min(F.struct("crop_seq", "cx", "cy")).alias("h"))
    # nearest middle: the neighbours in time before and after
    mids = crops.groupBy("session_id", ((F.col("s") + F.col("e")) / 2).alias("m")).agg(F.min(F.struct("crop_seq", "cx", "cy")).alias("c"))
    rows = mids.select("session_id", F.col("m").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point_id"), F.struct("m", "c.crop_seq", "c.cx", "c.cy").alias("c"))
    rows = rows.unionByName(points.select("session_id", F.col("t_us").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("point_id").cast("long")), allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy("at", "kind")
    rows = rows.withColumns({"p": F.last("c", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first("c", True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("kind = 1")
    dp, dn = F.col("at") - F.col("p.m"), F.col("n.m") - F.col("at")
    use = F.when(F.col("n").isNull(), F.col("p")).when(F.col("p").isNull() | (dn < dp), F.col("n")).when(dp < dn, F.col("p")).when(F.col("p.crop_seq") < F.col("n.crop_seq"), F.col("p")).otherwise(F.col("n"))
    rows = rows.select("session_id", "point_id", use.alias("u"))
    out = points.join(hit, ["session_id", "point_id"], "left").join(rows, ["session_id", "point_id"], "left")
    return out.select(*points.columns, F.coalesce("h.cx", "u.cx", F.lit(fx)).alias("cx"), F.coalesce("h.cy", "u.cy", F.lit(fy)).alias("cy"))


def clip_transcript(clips: DataFrame, sentences: DataFrame) -> DataFrame:
    """Text of sentences first..last - 1 of each clip (clip_id, first, last), stripped and joined by blanks."""
    s = sentences.select("session_id", F.col("idx").alias("i0"), F.col("idx").alias("i1"), F.trim("text").alias("text"))
    c = clips.select("session_id", "clip_id", "first", (F.col("last") - 1).alias("upto"))
    hit = overlap_join(c, s, "first", "upto", "i0", "i1", width=64)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i0", "text"))), lambda x: x["text"]), " ")
    return clips.join(hit.groupBy("session_id", "clip_id").agg(text.alias("text")), ["session_id", "clip_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def clip_words(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Words (word_idx, word, s, e) that start in a clip's closed interval, in the clip's own time."""
    w = words.select("session_id", "word_idx", "word", F.col("s").alias("ws"), F.col("s").alias("ws1"), F.col("e").alias("we"))
    hit = overlap_join(clips.select("session_id", "clip_id", F.col("s").alias("c0"), F.col("e").alias("c1")), w, "c0", "c1", "ws", "ws1")
    return hit.select("session_id", "clip_id", "word_idx", "word", (F.col("ws") - F.col("c0")).alias("s"), (F.col("we") - F.col("c0")).alias("e"))
