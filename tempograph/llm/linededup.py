"""Operator 2: removal of near-duplicate lines by an exact set-similarity join.  DataFrame functions only.

A line is the set of its words (64-bit hashes).  Lines with the same set are one class, named by 128 bits of hash and placed at its first
occurrence by (doc_id, line).  Words are ordered by rarity: by the logarithm of the count in their cell of a hashed count over the
whole corpus (``CELL_BITS`` bounds what the plan carries), then by hash; any such order gives the same result.

What is posted are pairs of neighbours in that order, not single words: a line's rarest words are no longer rare in a large corpus,
and lists of single words grow with its square, but neighbours are rare unless the lines are alike.  Let sets of n and m words have o in
common.  Between two common words that follow one another stands a word of one set only, or they are neighbours in both; there are
n + m - 2 o such words, so one of the first n + m - 2 o + 1 gaps between common words is a shared pair, and with a similarity of
t = num / den or more it is among the first n - ceil(n (2 t - 1)) + 1 pairs of either line.  For that there must be enough common words
in the smallest sets, so t must be at least 3/4; other thresholds are refused.  Pairs of classes that meet pass length and positional filters
and one on the words' parities, and what is left is verified on the whole sets.  A line is removed if an earlier line has
a similarity of t or more, or the same set.

Lists never make all their pairs.  First every class meets the earliest one of each of its lists.  In lists where more than ``SMALL`` classes are
then without a match, the first of those is met by the others, and so on while that finds matches.  Only then does a class meet what
comes before the match that it has so far, in the lists that may hold an earlier one: a group of thousands of variants of
a line finds its first one, and few pairs are left.  A pair of words that very many lines share is found by a count over
65,536 cells, and its list is never sorted or gathered in one task.

The postings, by far the most of what is shuffled, are made and met in up to ``PASSES`` passes, each of the pairs with certain bits of
their hash; the files of one pass are gone before the next.  Tables are dropped as soon as nothing reads them.

Defined results: the match of a removed line is the earliest line that is similar to it; lines without words are never removed; null
texts stay null, empty ones empty; a text that loses all its words goes with its row; rows with the same doc_id share positions and so keep
or lose the same lines (where their texts differ, one of them is compared); rows with a null doc_id are left as they are and match nothing; an
empty table gives no rows; further columns stay as they are.  Ties can't arise, as places differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.base import BROADCAST_ROWS, Scratch, if_small, parts_for

CELL_BITS = 17
#: classes without a match in one list up to which they meet all that comes before at once
SMALL = 64
#: lines in a cell of the pairs' count from which its pairs are handled without windows
HOT = 1_000_000
#: passes over the postings in large tables, and MB of documents for each of them
PASSES, PASS_MB = 4, 24
#: longs of the longer sign of lines in long lists (a power of 2)
WIDE = 8
#: numbers of words and places from here on aren't told apart, and no filter but verification holds for such lines
CLIP = 32_767
_BLANK = "\t\x0b\x0c\r"


def _words(line: Column) -> Column:
    odd = F.lit(False)
    for c in _BLANK:
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.when(odd, F.translate(line, _BLANK, " " * len(_BLANK))).otherwise(line), " ")


def word_hashes(line: Column) -> Column:
    """Distinct hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.expr("xxhash64('')"))


def ordered(line: Column, rarity: list[int]) -> Column:
    """Distinct hashes of a line's words in the global order: 6 bits of the cell's logarithmic count before 57 bits of the hash."""
    table = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<long>")  # a constant, folded once
    cell = lambda h: F.coalesce(F.get(table, h.bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")), F.lit(0).cast("long"))  # noqa: E731  never null, so that the sort is one of longs
    key = lambda h: F.shiftleft(cell(h), 57).bitwiseOR(F.shiftrightunsigned(h, 7))
    return F.sort_array(F.transform(word_hashes(line), key))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose expression isn't copied into what uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").alias("d"), F.posexplode(F.split("text", "\n")).alias("l", "line")).where(F.length(F.trim("line")) > 0)


def before(d: str, l: str, d2: str, l2: str) -> Column:
    """Whether the place (d, l) comes before (d2, l2)."""
    return (F.col(d) < F.col(d2)) | ((F.col(d) == F.col(d2)) & (F.col(l) < F.col(l2)))


class Lines:
    """The lines of ``docs`` with what the join needs of each, and the classes' shared pairs of words."""

    def __init__(self, docs: DataFrame, scratch: Scratch, num: int, den: int) -> None:
        if not 3 * den <= 4 * num <= 4 * den:
            raise ValueError("the threshold must be from 3/4 to 1")
        self.docs, self.scratch, self.num, self.den = docs, scratch, num, den
        cells = docs.where("doc_id is not null").select(F.explode(F.split("text", " ")).alias("w")).select(F.expr(f"cast(xxhash64(w) & {(1 << CELL_BITS) - 1} as int)").alias("c"))
        counted = cells.groupBy("c").count().select("c", F.least(F.ceil(F.log2("count")), F.lit(62)).cast("int").alias("n")).toArrow()  # one row for each cell
        order = np.zeros(1 << CELL_BITS, np.int64)
        order[counted.column("c").to_numpy()] = counted.column("n").to_numpy() + 1
        rarity = order.tolist()
        lines = once(lines_of(docs), "w", ordered(F.col("line"), rarity)).drop("line")
        lines = lines.withColumns({"n": F.size("w"), "key": F.xxhash64("w"), "key2": F.xxhash64(F.lit(2), "w")}).where("n > 0")
        many = F.expr(f"n - cast(ceil(n * {2 * num - den} / {den}) as int) + 1")
        # 48 bits of a pair's hash are enough to meet
        pairs = F.zip_with(F.slice("w", F.lit(1), many), F.slice("w", F.lit(2), many), lambda x, y: F.shiftrightunsigned(F.xxhash64(x, y), 16))
        # one bit for the parity of the words in each of 64 cells, of which 48 are kept: unlike sets differ in about half of them
        flip = lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
        sign = F.aggregate("w", F.lit(0).cast("long"), flip).bitwiseAND(F.lit((1 << 48) - 1))
        # of fewer words than num / (den - num) no two different sets are similar enough
        able = F.col("n") * (den - num) >= num
        self.all = scratch.save(lines.select("d", "l", "key", "key2", "n", *(F.when(able, c).alias(name) for c, name in ((pairs, "p"), (sign, "b")))), "lines")
        # the first of the lines with the same set stands for them
        repeated = self.all.groupBy("key", "key2").agg(F.count("*").alias("c"), F.min(F.struct("d", "l")).alias("at")).where("c > 1")
        self.repeated = scratch.save(repeated.select("key", "key2", F.col("at.d").alias("d0"), F.col("at.l").alias("l0")), "repeated")
        many = self.repeated.count()
        self.few, self.small = if_small(self.repeated, many), many <= BROADCAST_ROWS
        scratch.tidy()

    def near(self, wide: bool = False) -> Column:
        """Whether the other line (d2, l2) is earlier and passes the filters by lengths, by places of what may be the first shared pair of words, and
        by signs, which differ in no more bits than the sets do in words; ``wide``: the longer signs s0, s1 and so on too."""
        num, den, n, i, n2, i2 = self.num, self.den, *map(F.col, ("n", "i", "n2", "i2"))
        most = n + n2 - 2 * F.ceil(num * (n + n2) / (num + den))  # words of one set only
        differ = lambda a: F.bit_count(F.col(a).bitwiseXOR(F.col(f"{a}2")))
        # before the first pair that two lines share, each common word has such a word next to it: at most a third is common
        ahead = F.greatest(F.abs(i - i2), F.ceil((i + i2) / 3))
        fits = (den * F.least(n, n2) >= num * F.greatest(n, n2)) & (ahead + F.abs(n - i - n2 + i2) <= most) & (differ("b") <= most)
        if wide:
            fits = fits & (sum((differ(f"s{k}") for k in range(1, WIDE)), differ("s0")) <= most)
        return before("d2", "l2", "d", "l") & (fits | (F.greatest(n, n2) >= CLIP))

    def lists(self) -> list[DataFrame]:
        """t, d, l, n, i, b, g, d2, l2, hit, later: postings of the pairs of words that several classes share, with the list's length and the place of its
        first class, whether that passes the filters, and whether something may stand between it and this one: any other with a number of words
        that is near enough.  Postings of which neither holds are left out, and t, n, i, b are null where only the first does.  One table for each pass."""
        firsts = self.all.where("p is not null").join(self.few, ["key", "key2"], "left").where("d0 is null or (d = d0 and l = l0)").select("d", "l", "n", "b", "p")
        firsts = firsts if self.small else self.scratch.save(firsts, "firsts")  # else each pass would shuffle all lines
        # a posting is four longs: the pair's 48 bits and its place, the line's place, and the sign with the number of words
        top = lambda v: F.shiftleft(F.least(v.cast("long"), F.lit(CLIP)), 48)
        low = lambda v: v.bitwiseAND(F.lit((1 << 48) - 1))
        posts = firsts.select("d", "l", top(F.col("n")).bitwiseOR(F.col("b")).alias("nb"), F.posexplode("p").alias("i", "t"))
        cell = F.col("t").bitwiseAND(F.lit(0xFFFF))
        hot = [r.c for r in posts.groupBy(cell.alias("c")).count().where(F.col("count") >= HOT).select("c").collect()]  # 65,536 cells at most
        packed = lambda df: df.select("d", "l", "nb", top(F.col("i")).bitwiseOR(F.col("t")).alias("ti"))
        apart = lambda df: df.select(low(F.col("ti")).alias("t"), "d", "l", F.shiftrightunsigned("nb", 48).alias("n"), F.shiftrightunsigned("ti", 48).alias("i"), low(F.col("nb")).alias("b"))
        lead = F.min(F.struct("d", "l", "n", "i", "b"))
        passes = min(PASSES, parts_for(self.docs, PASS_MB))
        out = []
        for k in range(passes):
            own = posts.where(F.shiftright("t", 16) % passes == k)
            # most pairs of words are there once: a count finds the others before any sort, in the same exchange, which is the same one only
            # while both its readers need all its columns
            cold = apart(packed(own.where(~cell.isin(hot)) if hot else own).repartition(low(F.col("ti"))))
            often = cold.groupBy("t").agg(F.count("*").alias("g"), F.max(F.coalesce(F.expr("d ^ l ^ n ^ i ^ b"), F.lit(0))).alias("x")).where("g > 1 and x is not null").select("t", "g")
            sizes = Window.partitionBy("t").orderBy("n")
            whole = sizes.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same order, for one sort
            some = F.coalesce(F.lag("n").over(sizes) * self.den >= F.col("n") * self.num, F.lit(False)) | F.coalesce(F.lead("n").over(sizes) * self.num <= F.col("n") * self.den, F.lit(False))
            met = cold.join(often.hint("shuffle_hash"), "t").withColumns({"lead": lead.over(whole), "some": some}).select(*cold.columns, "g", "lead", "some")
            if hot:
                large = apart(packed(own.where(cell.isin(hot))))
                heads = large.groupBy("t").agg(F.count("*").alias("g"), lead.alias("lead")).where("g > 1")
                met = met.unionByName(large.hint("merge").join(heads, "t").withColumn("some", F.lit(True)).select(*met.columns))
            met = met.select("t", "d", "l", "n", "i", "b", "g", "some", F.col("lead.d").alias("d2"), F.col("lead.l").alias("l2"), F.col("lead.n").alias("n2"), F.col("lead.i").alias("i2"), F.col("lead.b").alias("b2"))
            met = met.select("t", "d", "l", "n", "i", "b", "g", "d2", "l2", self.near().alias("hit"), F.expr("g > 2 and some and (d2 <> d or l2 <> l)").alias("later"))
            out.append(self.scratch.save(met.where("hit or later").withColumns({c: F.when(F.col("later"), F.col(c)) for c in "tnib"}), "lists"))
            self.scratch.tidy()
        if not self.small:
            self.scratch.drop(firsts)
        return out

    def sets(self, places: DataFrame) -> DataFrame:
        """d, l, w: the whole sets of the lines at these places."""
        wanted = self.scratch.save(places.distinct(), "wanted")
        many = wanted.count()
        where = if_small(wanted.groupBy("d").agg(F.collect_set("l").alias("ls")), many)
        own = self.docs.select(F.col("doc_id").alias("d"), "text").join(where, "d").select("d", F.posexplode(F.split("text", "\n")).alias("l", "line"), "ls").where("array_contains(ls, l)")
        sets = self.scratch.save(own.select("d", "l", word_hashes(F.col("line")).alias("w")), "sets")
        self.scratch.drop(wanted)
        if sets.count() > many:  # rows that share doc_id: one of them
            sets = sets.groupBy("d", "l").agg(F.max("w").alias("w"))
        return sets

    def verified(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """d, l, d0, l0: each line of the pairs with the earliest of its partners that is similar enough."""
        pairs = self.scratch.save(pairs.select("d", "l", "d2", "l2").distinct(), "pairs")
        own = sets is None
        sets = self.sets(pairs.select("d", "l").union(pairs.select("d2", "l2"))) if own else sets
        a, b = sets.withColumnRenamed("w", "a"), sets.select(F.col("d").alias("d2"), F.col("l").alias("l2"), F.col("w").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        found = a.join(if_small(pairs), ["d", "l"]).join(b, ["d2", "l2"]).where(self.den * both >= self.num * (F.size("a") + F.size("b") - both))
        out = self.scratch.save(found.groupBy("d", "l").agg(F.min(F.struct("d2", "l2")).alias("at")).select("d", "l", F.col("at.d2").alias("d0"), F.col("at.l2").alias("l0")), "found")
        self.scratch.drop(pairs)
        if own and hasattr(sets, "tempograph_path"):
            self.scratch.drop(sets)
        return out

    def similar(self) -> DataFrame:
        """d, l, d0, l0: every class that has an earlier similar one, with the earliest."""
        s, tables = self.scratch, self.lists()
        lists = s.read(*tables)
        found = self.verified(lists.where("hit"))
        # lists in which something may stand between the first class, which was met, and a class or the match it has
        later = lists.where("later").select("t", "d", "l", "n", "i", "b", "d2", "l2", (F.col("g") > SMALL).alias("long"))
        short, long = later.where("not long").drop("long"), later.where("long").drop("long")
        rest = self.earlier(short, short.drop("d2", "l2"), found).select("d", "l", "d2", "l2")
        if not long.isEmpty():
            # of these lines the sets are at hand, a sign that tells long lines apart, and all posted pairs
            sets = self.sets(long.select("d", "l"))
            posted = self.all.join(if_small(sets.select("d", "l").distinct()), ["d", "l"]).groupBy("d", "l", "n").agg(F.min("p").alias("p"))
            part = lambda k: F.filter("w", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(WIDE - 1)) == k)
            flip = lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
            signs = sets.select("d", "l", *(F.aggregate(part(k), F.lit(0).cast("long"), flip).alias(f"s{k}") for k in range(WIDE)))
            long = s.save(long.join(signs, ["d", "l"]).join(posted, ["d", "l", "n"]), "long")
            found = self.rounds(long, sets, found)
            if hasattr(sets, "tempograph_path"):
                s.drop(sets)
            rest = rest.unionByName(self.earlier(long, long.drop("d2", "l2"), found).select("d", "l", "d2", "l2"))
        more = self.verified(rest)
        s.drop(*tables)
        return s.save(found.unionByName(more).groupBy("d", "l").agg(F.min(F.struct("d0", "l0")).alias("at")).select("d", "l", "at.*"), "similar")

    def rounds(self, long: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
        """``found`` with matches of classes in long lists: those without one meet the first of them, as long as that helps many."""
        s, posting = self.scratch, [c for c in long.columns if c not in ("t", "d2", "l2", "p")]
        open_ = s.save(long.drop("d2", "l2", "p").join(if_small(found.select("d", "l")), ["d", "l"], "left_anti"), "open")
        while True:
            heads = open_.groupBy("t").agg(F.count("*").alias("g"), F.min(F.struct("d", "l", *(c for c in posting if c not in ("d", "l")))).alias("lead")).where(f"g > {SMALL}")
            met = s.save(open_.hint("merge").join(heads.select("t", *(F.col(f"lead.{c}").alias(f"{c}2") for c in posting)), "t"), "met")
            new = self.verified(met.where(self.near(wide=True)), sets)
            many = new.count()
            found = s.save(found.unionByName(new), "found") if many else found
            if 32 * many <= met.count():  # no large group is left whose first line others haven't met
                return found
            # those without a match stay, but for the ones that the others have just met
            rest = met.where("d <> d2 or l <> l2").select("t", *posting).join(if_small(new.select("d", "l")), ["d", "l"], "left_anti")
            s.drop(open_)
            open_ = s.save(rest, "open")
            s.drop(met)

    def earlier(self, rows: DataFrame, others: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs in ``rows``' lists that pass the filters and are earlier than the match that a class has.  In long lists two lines meet
        under the first pair of words that they share, and not under the others again."""
        have = rows.join(if_small(found.withColumnsRenamed({"d0": "d3", "l0": "l3"})), ["d", "l"], "left")
        have = have.where(F.col("d3").isNull() | before("d2", "l2", "d3", "l3")).drop("d2", "l2")
        others = others.select("t", *(F.col(c).alias(f"{c}2") for c in others.columns if c != "t"))
        long = "p" in rows.columns
        fits = self.near(wide=long) & (F.col("d3").isNull() | before("d2", "l2", "d3", "l3"))
        if long:
            fits = fits & ~F.arrays_overlap(F.slice("p", F.lit(1), F.col("i").cast("int")), F.slice("p2", F.lit(1), F.col("i2").cast("int")))
        return have.hint("merge").join(others, "t").where(fits)


def matches(docs: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """d, l, d0, l0: the lines to be removed, each with the earliest line that it matches."""
    lines = Lines(docs, scratch, num, den)
    alike = lines.similar()
    # what holds for the first line of a set holds for all lines with it
    slim = lines.all.select("d", "l", "key", "key2")
    keys = scratch.save(slim.join(if_small(alike), ["d", "l"]).select("key", "key2", "d0", "l0"), "keys")
    copies = slim.join(if_small(keys), ["key", "key2"]).select("d", "l", "d0", "l0")
    same = slim.join(lines.few, ["key", "key2"]).where(before("d0", "l0", "d", "l")).select("d", "l", "d0", "l0")
    out = copies.unionByName(same).groupBy("d", "l").agg(F.min(F.struct("d0", "l0")).alias("at")).select("d", "l", "at.*")
    out = scratch.save(out, "removed")
    scratch.only(out)
    return out


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, line, match_doc_id, match_line of every line to be removed, with the earliest line that it matches."""
    out = matches(docs, Scratch(docs.sparkSession, "lines"), num, den)
    return out.select(F.col("d").alias("doc_id"), F.col("l").alias("line"), F.col("d0").alias("match_doc_id"), F.col("l0").alias("match_line"))


def without_repeats(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, all columns as they were.  A text of which no words are left
    goes with its row; a text that had none before stays."""
    out = matches(docs, Scratch(docs.sparkSession, "lines"), num, den)
    gone = out.groupBy("d").agg(F.collect_set("l").alias("_gone")).withColumnRenamed("d", "_doc")
    gone = if_small(gone, out.count())
    # the row travels as one struct, so that no column's name can clash
    rows = docs.select(F.struct("*").alias("_row")).join(gone, F.col("_row.doc_id") == F.col("_doc"), "left")
    left = F.array_join(F.filter(F.split("_row.text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    rows = once(rows, "_text", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left))
    rows = rows.where(F.col("_gone").isNull() | (F.btrim("_text", F.lit(" \n" + _BLANK)) != ""))
    return rows.select(*(F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
