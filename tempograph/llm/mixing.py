"""Operator 7: mixing sources to target weights by hierarchical budgeting.  DataFrame functions only.

A total of tokens is handed down a tree domain > language > source.  At each node the children get shares by weight, none
more than its subtree can supply (tokens times ``epochs``); what a child can't take goes to its siblings by weight, and only what
all of them can't take is missing to the parent and so goes to the parent's siblings.  All shares are integers, so
that another engine gets the same ones.

A leaf's documents are in the order of md5(seed, epoch, doc_id) of each epoch; epochs follow one another, and the leaf takes the
prefix whose running sum of tokens stays within its budget: some whole epochs and a prefix of the next.  For that the sums of 4,096
buckets of the order are enough, but for the one bucket in which the budget ends; no leaf is ever gathered or sorted as a whole.

Tokens are words (runs of other characters than ASCII white space).  Defined results: a null or empty text has 0 tokens, and
is taken if it stands inside the prefix; null languages and sources count as the empty name; unlisted names weigh ``other``; a
weight of 0 takes nothing; repeated rows are documents each; ties in the order go by tokens and text; an empty table gives no rows;
further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
#: leaves up to which their table is broadcast; beyond, it is joined by shuffling
BROADCAST_LEAVES = 50_000
OWN = "_mix_"


def weight_of(col: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], weight: str, cap: str, budget: str) -> DataFrame:
    """Adds ``got``: each node's part of its parent's ``budget`` by weight, at most ``cap``.

    Nodes in the order of cap / weight fill up first; a node is full if it can't take its part of what the ones before it leave.
    """
    order = Window.partitionBy(*parent).orderBy((F.col(cap) / F.col(weight)).asc(), *(F.col(c) for c in nodes.columns if c in LEVELS))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_left": F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0)), "_weights": F.sum(weight).over(after)})
    # full: cap / weight <= left / weights
    nodes = nodes.withColumn("_full", F.col(cap) * F.col("_weights") <= F.col("_left") * F.col(weight))
    group = Window.partitionBy(*parent)
    level = F.max(F.when(~F.col("_full"), F.struct(F.col("_weights").alias("w"), F.col("_left").alias("l")))).over(group)  # the first that isn't full has the most weight after it
    nodes = nodes.withColumn("_level", level)
    part = F.expr(f"({weight} * _level.l) div _level.w")
    return nodes.withColumn("got", F.when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), F.greatest(F.lit(0), part)))).drop("_left", "_weights", "_full", "_level")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share_of_all: tuple[int, int], epochs: int, other: int = 1) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf; ``leaves`` has domain, lang, source, tokens."""
    num, den = share_of_all
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    for level in LEVELS:
        leaves = leaves.withColumn(f"w_{level}", weight_of(level, weights.get(level, {}), other))
    leaves = leaves.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("cap")).otherwise(0))
    domains = leaves.groupBy("domain", "w_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("own")).withColumn("top", F.lit(0))
    domains = domains.withColumn("all", F.sum("own").over(Window.partitionBy("top"))).withColumn("total", F.expr(f"`all` * {num} div {den}")).where("cap > 0").drop("own", "all")
    domains = share(domains, ["top"], "w_domain", "cap", "total").select("domain", F.col("got").alias("of_domain"))
    langs = leaves.groupBy("domain", "lang", "w_lang").agg(F.sum("cap").alias("cap")).where("cap > 0").join(domains, "domain")
    langs = share(langs, ["domain"], "w_lang", "cap", "of_domain").select("domain", "lang", F.col("got").alias("of_lang"))
    found = leaves.where("cap > 0").join(langs, ["domain", "lang"])
    return share(found, ["domain", "lang"], "w_source", "cap", "of_lang").select("domain", "lang", "source", "tokens", F.col("got").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share_of_all: tuple[int, int], epochs: int, seed: int, other: int = 1) -> DataFrame:
    """Rows of ``docs``, once for each epoch in which they are taken, with the columns ``_mix_epoch``, ``_mix_tokens`` and
    ``_mix_domain`` added."""
    t = lambda name: OWN + name
    keyed = docs.withColumns(
        {
            t("domain"): F.coalesce(domain, F.lit("")), t("lang"): F.coalesce(F.col("lang"), F.lit("")), t("source"): F.coalesce(F.col("source"), F.lit("")),
            t("tokens"): F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        }
    )
    leaf = [t(x) for x in LEVELS]
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    narrow = keyed.select(*leaf, t("tokens"), "doc_id")
    leaves = narrow.groupBy(*leaf).agg(F.sum(t("tokens")).alias("tokens")).select(*(F.col(t(x)).alias(x) for x in LEVELS), "tokens")
    plan = budgets(leaves, weights, share_of_all, epochs, other).where("tokens > 0")
    plan = plan.select(*(F.col(x).alias(t(x)) for x in LEVELS), F.expr("budget div tokens").alias(t("whole")), F.expr("budget % tokens").alias(t("rest")))
    size = plan.count()
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_LEAVES else (lambda df: df)
    bucketed = narrow.join(small(plan), leaf).withColumn(t("bucket"), F.substring(order(F.col(t("whole"))), 1, 3))
    sums = bucketed.groupBy(*leaf, t("bucket"), t("rest")).agg(F.sum(t("tokens")).alias("s"))
    run = F.sum("s").over(Window.partitionBy(*leaf).orderBy(t("bucket")))
    ends = sums.withColumn("after", run).where(F.col("after") > F.col(t("rest"))).groupBy(*leaf).agg(F.min(F.struct(t("bucket"), (F.col("after") - F.col("s")).alias("before"))).alias("at"))
    ends = ends.select(*leaf, F.col(f"at.{t('bucket')}").alias(t("end")), F.col("at.before").alias(t("before")))
    plan = plan.join(ends, leaf, "left")
    full = keyed.join(small(plan), leaf).withColumn(t("key"), order(F.col(t("whole")))).withColumn(t("bucket"), F.substring(t("key"), 1, 3))
    edge = (F.col(t("rest")) > 0) & (F.col(t("bucket")) == F.col(t("end")))
    inside = F.coalesce((F.col(t("rest")) > 0) & (F.col(t("bucket")) < F.col(t("end"))), F.lit(False))
    clear = full.where(~F.coalesce(edge, F.lit(False))).withColumn(t("in"), inside)
    run = F.sum(t("tokens")).over(Window.partitionBy(*leaf).orderBy(t("key"), t("tokens"), F.md5(F.coalesce("text", F.lit("")))).rowsBetween(Window.unboundedPreceding, 0))
    last = full.where(edge).withColumn(t("in"), F.col(t("before")) + run <= F.col(t("rest")))
    taken = clear.unionByName(last).withColumn(t("copies"), F.col(t("whole")) + F.col(t("in")).cast("long")).where(F.col(t("copies")) > 0)
    return taken.withColumn(t("epoch"), F.explode(F.sequence(F.lit(0), (F.col(t("copies")) - 1).cast("int")))).select(*docs.columns, t("epoch"), t("tokens"), t("domain"))
