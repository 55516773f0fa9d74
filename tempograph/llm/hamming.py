"""Operator 8: exact top-k search in Hamming space by incremental multi-index hashing.

Binary codes (one bit for each component: whether it is above 0) are cut into segments of 16 bits; a shard of rows has one
table for each segment.  A query looks up all segment values within radius 0, then 1, and so on; when radius r is done in all m
segments, every code within m (r + 1) - 1 bits has been seen, and the search ends as soon as its kth verified distance is within that.
Shards hold as many rows as a task can index, and blocks as many queries as it can answer, so that few copies of either are sent;
the best k of each shard are merged by (distance, id).

Defined results: rows with a null id, or a vector that is null, empty or holds null or NaN components, have no code and are
neither queries nor neighbours; codes of other lengths than the query's are no neighbours; a row isn't its own
neighbour, but a repeated row with another id is; of rows with one id and different vectors the one with the smallest code asks, and each
is a neighbour; ties go to the smaller id; a shorter table gives fewer than k
neighbours; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.textbytes import utf8

#: segments of a shard's rows, and queries of a block, about; blocks of fewer queries only keep all cores busy
SHARD, QUERIES, FEW = 1 << 21, 1 << 16, 256
BITS = 16


def rings(bits: int) -> list[np.ndarray]:
    """For each radius the masks with so many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.int64) for r in range(bits + 1)]


def search(codes: np.ndarray, ids: np.ndarray, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, neighbour id, distance) of the k nearest of ``codes`` (rows of uint16 segments, ascending ``ids``) for
    each query; the row with the query's own id is left out."""
    n, m = codes.shape
    order = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(m)]
    starts = [np.searchsorted(codes[order[s], s], np.arange(65_537)) for s in range(m)]
    masks = rings(BITS)
    rows, found, away = [], [], []
    for q in range(len(query)):
        seen = np.zeros(n, bool)
        seen[np.searchsorted(ids, own[q], "left") : np.searchsorted(ids, own[q], "right")] = True
        left = n - int(seen.sum())
        at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(BITS + 1):
            parts = []
            for s in range(m):
                value = masks[r] ^ int(query[q, s])
                a, b = starts[s][value], starts[s][value + 1]
                size = b - a
                if size.any():
                    a, size = a[size > 0], size[size > 0]
                    parts.append(order[s][np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            if parts:
                new = np.unique(np.concatenate(parts))
                new = new[~seen[new]]
                seen[new] = True
                at = np.concatenate([at, new])
                dist = np.concatenate([dist, np.bitwise_count(codes[new] ^ query[q]).sum(1, dtype=np.int64)])
            if len(at) >= min(k, left):
                best = np.lexsort((ids[at], dist))[:k]
                at, dist = at[best], dist[best]
                if len(at) == left or len(at) and dist[-1] <= m * (r + 1) - 1:
                    break
        rows.append(np.full(len(at), q))
        found.append(ids[at])
        away.append(dist)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, away))


def coded(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, bits): the sign bits as a string of 0 and 1."""
    v = F.col(vector)
    ok = F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)) & (F.size(v) > 0)
    bits = F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return rows.where(ok).select(F.col(id_col).cast("long").alias("id"), bits.alias("bits"))


def top_k(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by ``every``: query_id, rank, neighbour_id, distance."""
    base = coded(rows, id_col, vector)
    sizes = base.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.coalesce(F.max(F.length("bits")), F.lit(1)).alias("d")).first()
    shards = max(1, -(-sizes["n"] * -(-sizes["d"] // BITS) // SHARD))
    busy = -(-rows.sparkSession.sparkContext.defaultParallelism // shards)
    blocks = max(1, -(-sizes["q"] // QUERIES), min(busy, -(-sizes["q"] // FEW)))
    data = base.select("id", "bits", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"))
    asked = base.where(F.col("id") % every == 0).groupBy("id").agg(F.min("bits").alias("bits"))
    asked = asked.select("id", "bits", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        bits, off = utf8(table.column("bits"))
        length = np.diff(off)
        out = [[], [], []]
        for d in np.unique(length[asks]).tolist():
            use = np.flatnonzero(length == d)
            code = np.zeros((len(use), -(-d // BITS)), np.uint16)
            for a in range(0, len(use), 65_536):
                part = use[a : a + 65_536]
                wide = np.zeros((len(part), code.shape[1] * BITS), np.uint8)
                wide[:, :d] = bits[off[part][:, None] + np.arange(d)] - 48
                code[a : a + len(part)] = np.packbits(wide, axis=1, bitorder="little").view(np.uint16)
            of, ask = use[~asks[use]], asks[use]
            order = np.argsort(ids[of], kind="stable")
            q, found, away = search(code[~ask][order], ids[of][order], code[ask], ids[use[ask]], k)
            for o, x in zip(out, (ids[use[ask]][q.astype(int)], found, away), strict=True):
                o.append(x)
        q, found, away = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        return pa.table({"query_id": pa.array(q, pa.int64()), "neighbour_id": pa.array(found, pa.int64()), "distance": pa.array(away, pa.int64()).cast(pa.int32())})

    found = data.unionByName(asked).groupBy("shard", "block").applyInArrow(meet, "query_id long, neighbour_id long, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


ORACLE = """
WITH c AS (SELECT vec_id AS id, embedding AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
     d AS (SELECT q.id AS query_id, r.id AS neighbour_id,
                  CAST(len(list_filter(list_zip(q.v, r.v), lambda x: (x[1] > 0) <> (x[2] > 0))) AS INTEGER) AS distance
           FROM c q JOIN c r ON q.id <> r.id AND len(q.v) = len(r.v) WHERE q.id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 10
"""
