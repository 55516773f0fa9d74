"""Shared plumbing of the training-data operators: cluster-safe staging, sizing and connected components.

Nothing here keeps rows of the corpus on the driver.  Intermediate tables are written as Parquet below
``spark.checkpoint.dir`` (the folder that driver and executors share) and read back, which cuts lineage in a way
that survives lost executors.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local master without the setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: while this is true, a query's shuffle files go as soon as it is done
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one operator call in the shared folder; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.saved: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the written table; ``df.tempograph_path`` of the result names the folder."""
        path = self.path(name)
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        self.saved.append(path)
        return self.read(path, schema=df.schema)

    def read(self, *tables: DataFrame | str, schema=None) -> DataFrame:
        """One table of what was written as these, which have the same columns."""
        paths = [t if isinstance(t, str) else t.tempograph_path for t in tables]
        out = self.spark.read.schema(schema or tables[0].schema).parquet(*paths)
        out.tempograph_path = paths[0]
        return out

    def only(self, *kept: DataFrame) -> None:
        """Drops all tables but these."""
        stay = {t.tempograph_path for t in kept}
        self.drop(*(p for p in self.saved if p not in stay))
        self.saved = [p for p in self.saved if p in stay]
        self.tidy()

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of queries that are done, which it does once the driver has collected its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame | str) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.tempograph_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size, used for numbers of partitions only; rows x 4 KB if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else df.count() * 4096


def parts_for(df: DataFrame, mb: float, least: int = 1) -> int:
    """How many parts of about ``mb`` MB of input there should be; grows with the input and has no upper limit."""
    return max(least, math.ceil(plan_bytes(df) / (mb * 1e6)))


#: rows up to which a narrow table is broadcast (some tens of MB)
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (``rows`` if that many are known to count), and
    without one, so that a join shuffles, beyond that."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component among 0..n-1 under the edges (a, b)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


#: edges (16 bytes each) up to which one task solves the rest of a graph
ONE_TASK = 500_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        lab = labels_of(len(ids), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[lab])], ["id", "component_id"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (id, component_id), component_id the smallest id reachable.

    ``edges`` has long columns ``a`` and ``b``; self-loops and repeated rows are allowed, nulls are dropped.  Only ids
    that have an edge to another id appear.  Alternating small-star and large-star rounds: each round is two
    aggregates with map-side combining and two joins whose both sides are exchanged (so that AQE can split a hub's
    partition); no vertex's neighbours are ever gathered into one row, and nothing but one count and one checksum per round
    reaches the driver.  A graph of at most ``ONE_TASK`` edges, from the start or after some rounds, is solved in one task.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.save(e.distinct(), "edges")
    print_of = lambda t: t.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = print_of(e)
    while before[0] > ONE_TASK:
        # small-star: each vertex's smaller neighbours move to the smallest of them
        least = scratch.save(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = scratch.save(
            e.hint("merge").join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "small"
        )
        scratch.drop(least, e)
        # large-star: each vertex's larger neighbours move to the smallest vertex it knows, itself included
        least = scratch.save(small.groupBy("u").agg(F.min("v").alias("m")), "least")
        e = scratch.save(
            small.withColumnsRenamed({"u": "x", "v": "u"}).hint("merge").join(least, "u", "left")
            .select(F.col("x").alias("u"), F.coalesce("m", "u").alias("v")).distinct(), "edges",
        )
        scratch.drop(least, small)
        now = print_of(e)
        if now == before:
            roots = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            return roots.union(roots.select(F.col("component_id").alias("id"), "component_id").distinct())
        before = now
    return scratch.save(e.repartition(1).mapInArrow(_solve, "id long, component_id long"), "components")
