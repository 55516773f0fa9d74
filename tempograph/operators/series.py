"""Windows over ordered series: motion, runs, peaks, topic depth.  Order keys are whole microseconds or positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.operators.intervals import islands, overlap_join
from tempograph.settings import DEFAULTS, SCALES
from tempograph.sql import run


def reversals(points: Column) -> Column:
    """How often the direction turns by more than a right angle along an array of (x, y)."""
    steps = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda b, a: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    n = F.greatest(F.size(steps) - 1, F.lit(0))
    dots = F.zip_with(F.slice(steps, 2, n), F.slice(steps, 1, n), lambda b, a: a["x"] * b["x"] + a["y"] * b["y"])
    return F.size(F.filter(dots, lambda d: d < 0))


def path_length(points: Column) -> Column:
    n = F.greatest(F.size(points) - 1, F.lit(0))
    steps = F.zip_with(F.slice(points, 2, n), F.slice(points, 1, n), lambda b, a: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def moving(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Moves before the session's limit with step, shake and emit decisions: session_id, row_seq, t_us, d, shaken, emits."""
    m = events.where("event = 'move'").join(limits.select("session_id", "lim"), "session_id").where("t_us < lim")
    order = Window.partitionBy("session_id").orderBy("t_us", "row_seq")
    m = m.withColumn("d", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0)))
    m = m.where("d > 1e-9").withColumn("seq", F.row_number().over(order))
    back = Window.partitionBy("session_id").orderBy("t_us").rangeBetween(-DEFAULTS.shake_window, 0)
    m = m.withColumn("near", F.collect_list(F.struct("seq", "x", "y")).over(back))
    points = F.array_sort(F.filter("near", lambda p: p["seq"] <= F.col("seq")))
    m = m.withColumn("near", points).withColumn("shaken", (F.size("near") >= 3) & (reversals(F.col("near")) >= 2) & (path_length(F.col("near")) < DEFAULTS.shake_distance)).drop("near")
    trail = Window.partitionBy("session_id").orderBy("t_us").rangeBetween(-DEFAULTS.move_window, 0)
    kept = m.where("not shaken")
    kept = kept.withColumn("total", F.aggregate(F.filter(F.collect_list(F.struct("seq", "d")).over(trail), lambda p: p["seq"] <= F.col("seq")), F.lit(0.0), lambda s, p: s + p["d"]))
    kept = kept.withColumn("emits", (F.col("d") >= DEFAULTS.move_step) | (F.col("total") >= DEFAULTS.move_total))
    return kept.unionByName(m.where("shaken"), allowMissingColumns=True).select("session_id", "row_seq", "t_us", "lim", "d", "shaken", F.coalesce("emits", F.lit(False)).alias("emits"))


def movement_intervals(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Padded intervals around substantial motion: a long step, or enough motion in the trailing window; jitter is left out."""
    m = moving(events, limits).where("emits")
    return m.select("session_id", F.greatest(F.col("t_us") - DEFAULTS.move_pre, F.lit(0)).alias("s"), F.least(F.col("t_us") + DEFAULTS.move_post, "lim").alias("e")).where("e > s")


def runs_of_false(samples: DataFrame, period: int, min_length: int) -> DataFrame:
    """Runs of false among samples (idx, ok) taken every ``period`` microseconds, from the first false to the next true one;
    a last run ends one period after its last sample."""
    order = Window.partitionBy("session_id").orderBy("idx")
    m = samples.withColumn("_r", F.sum(F.col("ok").cast("int")).over(order)).where("not ok")
    return m.groupBy("session_id", "_r").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).select("session_id", (F.col("a") * period).alias("s"), ((F.col("b") + 1) * period).alias("e")).where(f"e - s >= {min_length}")


def clusters(events: DataFrame, windows: DataFrame, hz: float) -> DataFrame:
    """Change events (t_us, x, y, win) clustered while gaps are at most 1.5 periods and 50 ms, padded, kept inside their
    window (win, ws, we), of at least 0.6 s, at most 4 s: session_id, win, s, e, cx, cy."""
    gap = int(1.5 / hz * 1e6) + 50_000
    ev = events.join(windows, ["session_id", "win"]).where("t_us between ws and we").withColumns({"s": F.col("t_us"), "e": F.col("t_us")})
    ev = islands(ev, ["session_id", "win"], gap)
    out = ev.groupBy("session_id", "win", "island", "ws", "we").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    out = out.select("session_id", "win", F.greatest(F.col("a") - DEFAULTS.scroll_pre, "ws").alias("s"), F.least(F.col("b") + DEFAULTS.scroll_post, "we").alias("e"), "cx", "cy")
    return out.where(f"e - s >= {DEFAULTS.scroll_min}").withColumn("e", F.least("e", F.col("s") + DEFAULTS.scroll_max))


def peak(series: DataFrame, least: float, rows: int = 10) -> DataFrame:
    """The first largest rise of a series (idx, v) for each session with at least ``rows`` rows and that much rise."""
    order = Window.partitionBy("session_id").orderBy("idx")
    d = series.withColumn("rise", F.col("v") - F.lag("v").over(order))
    top = d.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rise").isNotNull(), F.struct("rise", (-F.col("idx")).alias("i")))).alias("m"))
    return top.where(f"n >= {rows} and m.rise >= {least}").select("session_id", (-F.col("m.i")).alias("idx"), F.col("m.rise").alias("rise"))


def clap_peak(onsets: DataFrame, samples: DataFrame, reach: int = 25_000) -> DataFrame:
    """The loudest onset (onset_id, t_us) by the largest |v| of samples within ``reach``; it must reach max(0.05, 25 times the
    session's median |v|)."""
    loud = samples.select("session_id", F.col("t_us").alias("st"), F.abs("v").alias("a"))
    lim = loud.groupBy("session_id").agg(F.greatest(F.lit(0.05), 25 * F.median("a")).alias("lim"))
    o = onsets.select("session_id", "onset_id", "t_us", (F.col("t_us") - reach).alias("a0"), (F.col("t_us") + reach).alias("a1"))
    near = overlap_join(o, loud.withColumn("se", F.col("st")), "a0", "a1", "st", "se").groupBy("session_id", "onset_id", "t_us").agg(F.max("a").alias("top"))
    best = near.groupBy("session_id").agg(F.max(F.struct("top", (-F.col("onset_id")).alias("o"), "t_us")).alias("m"))
    return best.join(lim, "session_id").where("m.top >= lim").select("session_id", (-F.col("m.o")).alias("onset_id"), "m.t_us", F.col("m.top").alias("peak"))


def flash_confidence(series: DataFrame, peaks: DataFrame) -> DataFrame:
    """tanh((max - min) / 80) over the five values from two before the peak; 0 for fewer than two values."""
    p = peaks.select("session_id", F.greatest(F.col("idx") - 2, F.lit(0)).alias("lo"))
    near = series.join(p, "session_id").where("idx between lo and lo + 4").groupBy("session_id").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("jump"))
    return near.select("session_id", F.when(F.col("n") < 2, 0.0).otherwise(F.tanh(F.greatest(F.lit(0.0), "jump") / 80)).alias("confidence"))


def gap_scores(vectors: DataFrame, k: int, size: int | None = None) -> DataFrame:
    """1 - cosine of the mean unit vectors of the ``k`` sentences before and after each gap; vectors (idx, v) numbered from 0.
    session_id, gap (0 for the one before sentence k), score.  ``size`` is the number of sentences of a whole session, by default those that
    are there; where its last ones are still missing, gaps have fewer after them."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.withColumn("n", norm).select("session_id", "idx", F.posexplode("v").alias("dim", "x"), "n").withColumn("x", F.col("x") / F.greatest("n", F.lit(1e-12)))
    order = Window.partitionBy("session_id", "dim").orderBy("idx")
    m = unit.withColumns({"l": F.avg("x").over(order.rowsBetween(-k, -1)), "r": F.avg("x").over(order.rowsBetween(0, k - 1)), "size": F.lit(size) if size else F.count("*").over(Window.partitionBy("session_id", "dim"))})
    m = m.where(f"idx >= {k} and idx <= size - {k}")
    g = m.groupBy("session_id", "idx").agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    return g.select("session_id", (F.col("idx") - k).alias("gap"), (1 - F.col("lr") / F.greatest(F.sqrt("ll") * F.sqrt("rr"), F.lit(1e-12))).alias("score"))


def smooth3(scores: DataFrame, spread: bool = True) -> DataFrame:
    """Sums of three neighbours by 3, with zeros beyond the ends; with ``spread`` one or two values become three, as they are all
    that a session has."""
    order = Window.partitionBy("session_id").orderBy("gap")
    s = scores.withColumns({"p": F.coalesce(F.lag("score").over(order), F.lit(0.0)), "n": F.coalesce(F.lead("score").over(order), F.lit(0.0)), "size": F.count("*").over(Window.partitionBy("session_id"))})
    many = (s.where("size >= 3") if spread else s).select("session_id", "gap", ((F.col("p") + F.col("score") + F.col("n")) / 3).alias("score"))
    if not spread:
        return many
    few = s.where("size < 3").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gap", "score"))), lambda x: x["score"]).alias("a"))
    x0, x1 = F.element_at("a", 1), F.coalesce(F.try_element_at(F.col("a"), F.lit(2)), F.lit(None))
    three = F.when(F.size("a") == 1, F.array(x0 / 3, x0 / 3, x0 / 3)).otherwise(F.array(x0 / 3, (x0 + x1) / 3, x1 / 3))
    return many.unionByName(few.select("session_id", F.posexplode(three).alias("gap", "score")).select("session_id", F.col("gap").cast("long").alias("gap"), "score"))


def depth_scores(scores: DataFrame) -> DataFrame:
    """How far each score lies below the largest before and after it: (prefix max - g) + (suffix max - g)."""
    order = Window.partitionBy("session_id").orderBy("gap")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return scores.select("session_id", "gap", ((F.max("score").over(before) - F.col("score")) + (F.max("score").over(after) - F.col("score"))).alias("depth"))


def boundaries(vectors: DataFrame, k: int, factor: float = 0.5, size: int | None = None) -> DataFrame:
    """Sentence numbers at which a topic ends, for windows of ``k`` sentences: depth of at least mean + factor x deviation.
    ``size`` is the number of sentences of a whole session, by default those that are there."""
    d = depth_scores(smooth3(gap_scores(vectors, k, size), spread=size is None))
    w = Window.partitionBy("session_id")
    return d.withColumn("lim", F.avg("depth").over(w) + factor * F.stddev_pop("depth").over(w)).where("depth >= lim").select("session_id", (F.col("gap") + k).alias("idx"))


def all_boundaries(vectors: DataFrame, scales: tuple[int, ...] = SCALES, size: int | None = None) -> DataFrame:
    """Boundaries of all scales, with 0 and the number of sentences: ``size``, by default those that are there."""
    n = vectors.groupBy("session_id").agg((F.lit(size) if size else F.max("idx") + 1).alias("n"))
    out = n.select("session_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("idx"))
    for k in scales:
        out = out.union(boundaries(vectors, k, size=size).select("session_id", F.col("idx").cast("long")))
    return out.distinct()


def frame_change(frames: DataFrame, step: int = 30, share: float = 0.04) -> DataFrame:
    """Pixels (frame, px, py, v) against the frame before: the share that changed by ``step`` or more, and the middle of the
    changed pixels' box, where that share is reached.  width and height are the largest place plus one."""
    now = frames.withColumn("before", F.col("frame") - 1)
    old = frames.select("session_id", F.col("frame").alias("before"), "px", "py", F.col("v").alias("v0"))
    d = now.join(old, ["session_id", "before", "px", "py"]).withColumn("hit", F.abs(F.col("v") - F.col("v0")) >= step)
    on = lambda c, f: f(F.when(F.col("hit"), F.col(c)))
    size = frames.groupBy("session_id").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h"))
    g = d.groupBy("session_id", "frame").agg(F.avg(F.col("hit").cast("double")).alias("part"), *(on(c, f).alias(n) for c, f, n in (("px", F.min, "x0"), ("px", F.max, "x1"), ("py", F.min, "y0"), ("py", F.max, "y1"))))
    return g.where(f"part >= {share}").join(size, "session_id").select("session_id", "frame", "part", ((F.col("x0") + F.col("x1")) / 2 / F.col("w")).alias("cx"), ((F.col("y0") + F.col("y1")) / 2 / F.col("h")).alias("cy"))


def sentences(words: DataFrame, gap: int = 800_000) -> DataFrame:
    """Words (word_idx, word, s, e) as sentences: one ends after a word that ends in . ? or ! or that comes more than ``gap`` after
    the word before; sentences that don't last are dropped, but for a last unfinished one."""
    return run(
        """
        WITH a AS (SELECT *, lag(e) OVER (PARTITION BY session_id ORDER BY word_idx) AS pe FROM {words}),
        b AS (SELECT *, CASE WHEN word RLIKE '[.?!]$' OR s - pe > """
        + str(gap)
        + """ THEN 1 ELSE 0 END AS ends FROM a),
        c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY session_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM b)
        SELECT session_id, idx, array_join(transform(array_sort(collect_list(struct(word_idx, word))), x -> x.word), ' ') AS text, min_by(s, word_idx) AS s, max_by(e, word_idx) AS e
        FROM c GROUP BY session_id, idx HAVING max_by(e, word_idx) > min_by(s, word_idx) OR max(ends) = 0
        """,
        words=words,
    )
