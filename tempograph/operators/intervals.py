"""Interval algebra on (session_id, s, e) rows, times in whole microseconds.

All windows are partitioned by session and all joins have the session as an equi-key; overlap joins add a time bucket, so
that a long session is spread over many tasks instead of being compared all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.settings import DEFAULTS, EPS_US
from tempograph.sql import run

BUCKET = 60_000_000


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, on: str = "session_id", width: int = BUCKET) -> DataFrame:
    """Inner join of rows of one session whose closed intervals meet; other column names must differ.

    Both sides are put into buckets of ``width``; a pair that shares several is made only in the first that both have.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_lb", bucket(ls)).withColumn("_b", F.explode(F.sequence(F.col("_lb"), F.greatest(bucket(le), F.col("_lb")))))
    b = right.withColumn("_rb", bucket(rs)).withColumn("_b", F.explode(F.sequence(F.col("_rb"), F.greatest(bucket(re), F.col("_rb")))))
    pairs = a.join(b, [on, "_b"]).where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_b") == F.greatest("_lb", "_rb")))
    return pairs.drop("_b", "_lb", "_rb")


def gather(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, on: str = "session_id", width: int = BUCKET) -> DataFrame:
    """Rows of ``left`` with ``hits``: the array, in order, of the structs of ``right`` (all columns but the session) whose
    closed intervals meet them.  Every row stays, equal rows as often as they are there, and ``left`` is read once, so plans of many
    steps stay small."""
    bucket = lambda c: F.floor(c / width)
    items = [c for c in right.columns if c != on]
    r = right.withColumn("_b", F.explode(F.sequence(bucket(F.col(rs)), F.greatest(bucket(F.col(re)), bucket(F.col(rs))))))
    r = r.groupBy(on, "_b").agg(F.collect_list(F.struct(*items)).alias("_r"))
    a = left.withColumn("_lb", bucket(F.col(ls))).withColumn("_b", F.explode(F.sequence(F.col("_lb"), F.greatest(bucket(F.col(le)), F.col("_lb")))))
    met = F.filter("_r", lambda x: (x[rs] <= F.col(le)) & (x[re] >= F.col(ls)) & (F.col("_b") == F.greatest(F.col("_lb"), bucket(x[rs]))))
    joined = a.join(r, [on, "_b"], "left").withColumn("_h", met)
    # equal rows of left meet in one group: each has one row in its first bucket, and all have the same hits
    first = F.sum(F.when(F.col("_b") == F.col("_lb"), 1).otherwise(0)).cast("int")
    met = joined.groupBy(*left.columns).agg(first.alias("_n"), F.array_sort(F.flatten(F.collect_list("_h"))).alias("hits"))
    one = F.when(F.col("_n") == 1, F.col("hits")).otherwise(F.filter("hits", lambda _, i: i % F.col("_n") == 0))
    return met.withColumn("hits", one).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def islands(df: DataFrame, by: list[str], gap: int, strict: bool = False) -> DataFrame:
    """Adds ``island``: rows in order of s belong together while s is within ``gap`` of all ends before (strictly less)."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("s") - reach >= gap) if strict else (F.col("s") - reach > gap)
    df = df.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    return df.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_gap(intervals: DataFrame, gap: int = DEFAULTS.merge_gap) -> DataFrame:
    """Union of intervals that are at most ``gap`` apart."""
    return islands(intervals, ["session_id"], gap).groupBy("session_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def k_of_n(detections: DataFrame, k: int = 2, min_length: int = DEFAULTS.agree_min, gap: int = DEFAULTS.agree_gap) -> DataFrame:
    """Ranges in which ``k`` detectors agree, with the detectors that took part: session_id, s, e, detectors.

    A detector is on while any of its intervals is open; at equal times openings come before closings, so touching
    intervals of one detector bridge and those of two agree in a range of length 0.  Ranges less than ``gap`` apart merge, and
    merged ranges of ``min_length`` or more stay.
    """
    ev = detections.select("session_id", "detector", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).select("session_id", "detector", "x.*")
    own = Window.partitionBy("session_id", "detector").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("n", F.sum("d").over(own)).where("(d = 1 and n = 1) or (d = -1 and n = 0)")
    on = Window.partitionBy("session_id", "detector").orderBy("t", F.desc("d"))
    spans = ev.withColumn("e", F.lead("t").over(on)).where("d = 1").select("session_id", "detector", F.col("t").alias("os"), F.col("e").alias("oe"))
    every = Window.partitionBy("session_id").orderBy("t", F.desc("d"), "detector").rowsBetween(Window.unboundedPreceding, 0)
    edge = ev.withColumn("n", F.sum("d").over(every)).where(f"(d = 1 and n = {k}) or (d = -1 and n = {k - 1})")
    nxt = F.lead("t").over(Window.partitionBy("session_id").orderBy("t", F.desc("d"), "detector"))
    ranges = edge.withColumn("e", nxt).where("d = 1").select("session_id", F.col("t").alias("s"), "e")
    ranges = islands(ranges, ["session_id"], gap, strict=True)
    whole = ranges.groupBy("session_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).where(f"e - s >= {min_length}")
    who = overlap_join(ranges, spans, "s", "e", "os", "oe").groupBy("session_id", "island").agg(F.array_sort(F.collect_set("detector")).alias("detectors"))
    return whole.join(who, ["session_id", "island"]).drop("island")


def merge_adjacent(timeline: DataFrame) -> DataFrame:
    """Neighbours that touch and have the same layout and speed become one; their zooms follow one another."""
    order = Window.partitionBy("session_id").orderBy("s", "e")
    same = (F.abs(F.col("s") - F.lag("e").over(order)) < EPS_US) & (F.lag("layout").over(order) == F.col("layout")) & (F.abs(F.lag("speed").over(order) - F.col("speed")) < 1e-6)
    marked = timeline.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = [F.min("s").alias("s"), F.max("e").alias("e"), F.first("layout").alias("layout"), F.first("speed").alias("speed")]
    if "zooms" in timeline.columns:
        made.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "zooms"))), lambda x: x["zooms"])).alias("zooms"))
    return marked.groupBy("session_id", "_i").agg(*made).drop("_i")


def clip_zooms(zooms: Column, lo: Column, hi: Column) -> Column:
    """Zooms that meet (lo, hi) by more than a sliver, cut to it."""
    inside = F.filter(zooms, lambda z: (z["s"] < hi - EPS_US) & (z["e"] > lo + EPS_US))
    return F.transform(inside, lambda z: F.struct(F.greatest(z["s"], lo).alias("s"), F.least(z["e"], hi).alias("e"), z["zoom"].alias("zoom"), z["cx"].alias("cx"), z["cy"].alias("cy")))


def _pieces(timeline: DataFrame, hits: DataFrame, parts: Column, more: list[Column]) -> DataFrame:
    """Rows of ``hits`` (a timeline with extra columns) exploded into ``parts`` (a, b), zooms cut to them, slivers dropped."""
    cols = [c for c in timeline.columns if c not in ("s", "e", "zooms")]
    p = hits.withColumn("_p", F.explode(parts)).withColumns({"a": F.col("_p.a"), "b": F.col("_p.b")}).where(f"b - a > {EPS_US}")
    zooms = [clip_zooms(F.col("zooms"), F.col("a"), F.col("b")).alias("zooms")] if "zooms" in timeline.columns else []
    return p.select(*cols, F.col("a").alias("s"), F.col("b").alias("e"), *more, *zooms)


def subtract(timeline: DataFrame, cuts: DataFrame) -> DataFrame:
    """The timeline without the cuts (s, e): segments are dropped, shortened or split, zooms cut with them, slivers dropped.
    Cuts of no length do nothing."""
    away = merge_gap(cuts.where("e > s").select("session_id", "s", "e"), 0).withColumnsRenamed({"s": "cs", "e": "ce"})
    hit = gather(timeline, away, "s", "e", "cs", "ce")
    inside = F.filter("hits", lambda c: (c["cs"] < F.col("e")) & (c["ce"] > F.col("s")))
    starts = F.concat(F.array("s"), F.transform(inside, lambda c: c["ce"]))
    ends = F.concat(F.transform(inside, lambda c: c["cs"]), F.array("e"))
    parts = F.zip_with(starts, ends, lambda a, b: F.struct(F.greatest(a, "s").alias("a"), F.least(b, "e").alias("b")))
    return _pieces(timeline, hit, parts, [])


def speed_of(action: Column) -> Column:
    """Speed of ``speed@<number>x``; null for anything else."""
    return F.regexp_extract(action, r"^speed@(.*?)x?$", 1).try_cast("double")


def apply_zones(timeline: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones (s, e, action, zone_seq) on a timeline: ``cut`` removes, ``speed@Nx`` sets the speed of what it covers (of
    overlapping ones the last by zone_seq); other actions and speeds of 0 or less do nothing."""
    rest = subtract(timeline, zones.where("action = 'cut'").select("session_id", "s", "e"))
    ramps = zones.withColumn("_v", speed_of(F.col("action"))).where("_v > 0 and e > s").select("session_id", F.col("s").alias("zs"), F.col("e").alias("ze"), "_v", "zone_seq")
    hit = gather(rest, ramps, "s", "e", "zs", "ze").withColumn("_z", F.filter("hits", lambda z: (z["zs"] < F.col("e")) & (z["ze"] > F.col("s"))))
    inner = lambda name: F.filter(F.transform("_z", lambda z: z[name]), lambda t: (t > F.col("s")) & (t < F.col("e")))
    hit = hit.withColumn("_t", F.array_sort(F.array_distinct(F.concat(F.array("s", "e"), inner("zs"), inner("ze")))))
    n = F.size("_t") - 1
    parts = F.zip_with(F.slice("_t", F.lit(1), n), F.slice("_t", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    over = F.filter("_z", lambda z: (z["zs"] <= F.col("a")) & (z["ze"] >= F.col("b")))
    last = F.array_max(F.transform(over, lambda z: F.struct(z["zone_seq"].alias("q"), z["_v"].alias("v"))))
    return _pieces(rest.drop("speed"), hit, parts, [F.coalesce(last["v"], F.col("speed")).alias("speed")])


def fill_coverage(segments: DataFrame, totals: DataFrame, default: str = "pip") -> DataFrame:
    """Segments (s, e, layout) made to cover [0, total] of ``totals`` (session_id, total) exactly: a leading gap gets the
    default layout, other gaps extend the segment before, overlaps push the later start, contained segments go."""
    return run(
        """
        WITH a AS (SELECT g.*, t.total, coalesce(max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
                   FROM {segments} g JOIN {totals} t USING (session_id)),
        b AS (SELECT session_id, greatest(s, reach) AS s, layout, total FROM a WHERE e > reach AND greatest(s, reach) < total),
        c AS (SELECT session_id, s, coalesce(lead(s) OVER (PARTITION BY session_id ORDER BY s), total) AS e, layout, total FROM b),
        first AS (SELECT t.session_id, coalesce(min(c.s), t.total) AS s, t.total FROM {totals} t LEFT JOIN c ON c.session_id = t.session_id GROUP BY t.session_id, t.total)
        SELECT session_id, s, e, layout FROM c WHERE e > s
        UNION ALL SELECT session_id, CAST(0 AS BIGINT), s, '"""
        + default
        + "' FROM first WHERE s > 0",
        segments=segments,
        totals=totals,
    )


def split_at_zooms(segments: DataFrame) -> DataFrame:
    """Segments (s, e, zooms, ...) as pieces with one zoom or none: session_id, seg_s, s, e, zoom (null for none), cx, cy.
    Of overlapping zooms the later starts where the earlier ends; covered ones go."""
    z = segments.select("session_id", F.col("s").alias("seg_s"), F.col("e").alias("seg_e"), F.explode_outer("zooms").alias("z"))
    z = z.select("session_id", "seg_s", "seg_e", F.greatest("z.s", "seg_s").alias("zs"), F.least("z.e", "seg_e").alias("ze"), "z.zoom", "z.cx", "z.cy").where("zoom is null or ze > zs")
    order = Window.partitionBy("session_id", "seg_s", "seg_e").orderBy("zs", "ze", "zoom", "cx", "cy")
    z = z.withColumn("reach", F.coalesce(F.max("ze").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("seg_s"))).withColumn("a", F.greatest("zs", "reach")).where("zoom is null or ze > a")
    z = z.withColumns({"gap_from": F.coalesce(F.max("ze").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("seg_s")), "last": F.lead("zs").over(order).isNull()})
    none = lambda a, b: F.struct(a.alias("s"), b.alias("e"), F.lit(None).cast("double").alias("zoom"), F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"))
    own = F.struct(F.col("a").alias("s"), F.col("ze").alias("e"), "zoom", "cx", "cy")
    rows = F.when(F.col("zoom").isNull(), F.array(none(F.col("seg_s"), F.col("seg_e")))).when(F.col("last"), F.array(none(F.col("gap_from"), F.col("a")), own, none(F.col("ze"), F.col("seg_e")))).otherwise(F.array(none(F.col("gap_from"), F.col("a")), own))
    return z.select("session_id", "seg_s", F.explode(rows).alias("p")).select("session_id", "seg_s", "p.*").where("e > s")


def cursor_idle(events: DataFrame, durations: DataFrame, min_idle: int = DEFAULTS.idle_min) -> DataFrame:
    """Gaps of ``min_idle`` or more between moves (t_us) inside [0, duration], the ones before the first and after the last
    included; ``durations`` has session_id, duration."""
    moves = events.where("event = 'move'").join(durations, "session_id").where("t_us between 0 and duration").select("session_id", "t_us")
    points = moves.unionByName(durations.select("session_id", F.col("duration").alias("t_us")))
    order = Window.partitionBy("session_id").orderBy("t_us")
    return points.withColumn("s", F.coalesce(F.lag("t_us").over(order), F.lit(0))).select("session_id", "s", F.col("t_us").alias("e")).where(f"e - s >= {min_idle}")


def overlap_len(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def subtract_interval(b0: Column, b1: Column, c0: Column, c1: Column) -> Column:
    """Array of the 0 to 2 intervals of [b0, b1] outside [c0, c1]."""
    pair = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    apart = (c1 <= b0) | (c0 >= b1)
    return F.when(apart, F.array(pair(b0, b1))).otherwise(F.filter(F.array(pair(b0, c0), pair(c1, b1)), lambda p: p["s"] < p["e"]))


def sample_points(s: Column, e: Column, n: int, min_gap: int) -> Column:
    """Array of up to ``n`` even times from s to e, both included; one for no length, null for a reversed range."""
    count = F.greatest(F.lit(2), F.least(F.lit(n), F.floor((e - s) / min_gap).cast("int") + 1))
    many = F.transform(F.sequence(F.lit(0), count - 1), lambda i: s + F.floor(i * (e - s) / (count - 1)).cast("long"))
    return F.when(e == s, F.array(s)).when(e > s, many)


def violations(timeline: DataFrame, durations: DataFrame, tolerance: int = 1000) -> DataFrame:
    """Rows of an edit list that break a rule, with the first rule that each breaks; sessions of ``durations`` without rows too."""
    order = Window.partitionBy("session_id").orderBy("s", "e")
    t = timeline.join(durations, "session_id").withColumn("_prev", F.lag("e").over(order))
    zooms = F.exists("zooms", lambda z: (z["s"] < F.col("s") - tolerance) | (z["e"] > F.col("e") + tolerance) | (z["e"] <= z["s"])) if "zooms" in timeline.columns else F.lit(False)
    rule = (
        F.when(F.col("e") <= F.col("s"), "reversed")
        .when((F.col("s") < -tolerance) | (F.col("e") > F.col("duration") + tolerance), "outside")
        .when(F.col("speed") <= 0, "speed")
        .when(~F.col("layout").isin("cam_full", "pip", "screen_full"), "layout")
        .when(F.col("s") < F.col("_prev") - tolerance, "overlap")
        .when(zooms, "zoom")
    )
    bad = t.withColumn("rule", rule).where("rule is not null").select("session_id", "s", "e", "rule")
    empty = durations.join(timeline.select("session_id").distinct(), "session_id", "left_anti")
    return bad.unionByName(empty.select("session_id", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit("empty").alias("rule")))
