"""Vectors in Arrow columns, and the operator on embeddings' near-duplicates.

Operator 1: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Exact copies (same label, same vector) become one class first.  Each class's vector goes into ``probes`` buckets of each
of ``tables`` hash tables; a bucket's vectors are compared by exact cosine in double precision, and a pair that meets in
several buckets counts only in the first of them, which both vectors' own codes tell.  Buckets of more than ``BLOCK``
vectors are dealt out as pairs of blocks, so that no task gets an unbounded group, and no pair is ever a row: a block
gives for each vector its number of links and one edge of a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
null vec_id, link with nothing; repeated rows count as other vectors; vectors of different lengths never link; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.base import Scratch, components, labels_of, plan_bytes
from tempograph.llm.textbytes import mix

#: vectors of a bucket that one task compares with as many others
BLOCK = 1024
ROUNDS = 3


@lru_cache
def _signs(tables: int, size: int, polytopes: int) -> np.ndarray:
    rng = np.random.default_rng(97 + size)
    return rng.choice(np.array([-1.0, 1.0], np.float32), (tables, polytopes, ROUNDS, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of the rows, whose length is a power of 2."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x


def codes(x: np.ndarray, tables: int, probes: int, polytopes: int = 2) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit vectors: in each table the ``probes`` best pairs of cross-polytope
    vertices, by the sum of the coordinates that are given up against the best pair."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((n, size), np.float32)
    wide[:, :d] = x
    signs = _signs(tables, size, polytopes)
    out = np.empty((n, tables, probes), np.uint64)
    ahead = min(probes, 2 * size)
    for t in range(tables):
        best, loss = [], []
        for p in range(polytopes):
            y = wide
            for r in range(ROUNDS):
                y = hadamard(y * signs[t, p, r]) / np.float32(size**0.5)
            both = np.concatenate([y, -y], 1)
            top = np.argpartition(-both, ahead - 1, 1)[:, :ahead]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, 1, kind="stable")
            best.append(np.take_along_axis(top, order, 1).astype(np.uint64))
            value = np.take_along_axis(value, order, 1)
            loss.append(value[:, :1] - value)
        code, total = best[0], loss[0]
        for p in range(1, polytopes):
            total = (total[:, :, None] + loss[p][:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * np.uint64(2 * size) + best[p][:, None, :]).reshape(n, -1)
        order = np.argsort(total, 1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(code, order, 1)
        out[:, t, : chosen.shape[1]] = chosen * np.uint64(tables) + np.uint64(t)
        out[:, t, chosen.shape[1] :] = chosen[:, :1] * np.uint64(tables) + np.uint64(t)
    return out


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary column of vectors of one length."""
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    return raw.reshape(n, -1).view(np.float64)


def usable(v: str = "embedding") -> F.Column:
    """Whether a vector column has a direction: not null, no null or non-finite component, not all zero."""
    big = float("inf")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x > -big) & (x < big)
    return F.coalesce(F.forall(v, ok) & F.exists(v, lambda x: x != 0), F.lit(False))


def _compare(ids, label, copies, x, key, side, at_least, tables, probes):
    """Links and forest edges of one block: (ids, links, root ids)."""
    n = len(ids)
    norm = np.sqrt((x * x).sum(1))
    cosine = (x @ x.T) / (norm[:, None] * norm)
    link = cosine >= at_least
    link &= label[:, None] == label
    a, b = np.nonzero(np.triu(link, 1))
    if side.any():
        use = side[a] != side[b]
        a, b = a[use], b[use]
    if not len(a):
        return None
    c = codes((x / norm[:, None]).astype(np.float32), tables, probes)
    first = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    found = np.zeros(len(a), bool)
    for t in range(tables):
        low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
        for p in range(probes):
            for q in range(probes):
                same = c[a, t, p] == c[b, t, q]
                low[same] = np.minimum(low[same], c[a, t, p][same])
        here = ~found & (low != np.iinfo(np.uint64).max)
        first[here] = low[here]
        found |= here
    use = first == key
    links = np.bincount(a[use], copies[b[use]], n) + np.bincount(b[use], copies[a[use]], n)
    order = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    root = order[labels_of(n, place[a], place[b])][place]
    say = (links > 0) | (root != np.arange(n))
    return ids[say], links[say].astype(np.int64), ids[root][say]


def near_duplicates(vectors: DataFrame, at_least: float = 0.98, tables: int = 5, probes: int = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("label", "v")), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v", "label"))})
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("vec_id", "v", "label")).alias("one"))
    classes = scratch.save(classes.select("k1", "k2", "rep", "copies", F.col("one.v").alias("v"), F.col("one.label").cast("string").alias("label")), "classes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("v")
            flat, off = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
            ends = np.cumsum(off)
            for d in np.unique(off).tolist():
                at = np.flatnonzero(off == d)
                x = flat[(ends[at] - d)[:, None] + np.arange(d)]
                for a in range(0, len(at), 512):
                    part, y = at[a : a + 512], x[a : a + 512]
                    c = codes((y / np.sqrt((y * y).sum(1))[:, None]).astype(np.float32), tables, probes)
                    c = np.sort(c.reshape(len(part), -1), 1)
                    use = np.ones(c.shape, bool)
                    use[:, 1:] = c[:, 1:] != c[:, :-1]
                    row, place = np.nonzero(use)
                    raw = [v.tobytes() for v in y]
                    take = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[row, place].view(np.int64)), pa.array(np.full(len(row), d, np.int32)), batch.column("rep").take(take), batch.column("label").take(take), batch.column("copies").take(take), pa.array([raw[r] for r in row.tolist()], pa.binary())],
                        ["code", "dim", "rep", "label", "copies", "x"],
                    )

    dealt = classes.select("rep", "label", "copies", "v").mapInArrow(deal, "code long, dim int, rep long, label string, copies long, x binary")
    # buckets of more than BLOCK vectors are cut into blocks by a hash of the id
    big = dealt.groupBy("code", "dim", "label").count().where(F.col("count") > BLOCK).select("code", "dim", "label", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    big = scratch.save(big, "big")
    dealt = dealt.join(big, ["code", "dim", "label"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("code", "dim", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "rep", "copies", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def block(t: pa.RecordBatch) -> None:
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            got = _compare(
                t.column("rep").to_numpy(), np.zeros(t.num_rows), t.column("copies").to_numpy().astype(float), matrix(t.column("x")), np.int64(t.column("code")[0].as_py()).view(np.uint64),
                np.array(t.column("side").to_numpy(zero_copy_only=False), bool) if i != j else np.zeros(t.num_rows, bool), at_least, tables, probes,
            )
            if got:
                out.append(got)

        for t in groups(batches, ["code", "dim", "label", "i", "j"]):
            block(t)
            if len(out) >= 64:
                yield _rows(out)
                out.clear()
        if out:
            yield _rows(out)

    n = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-plan_bytes(dealt) // 64_000_000))
    keys = ["code", "dim", "label", "i", "j"]
    found = scratch.save(dealt.repartition(int(min(n, 100_000)), *keys).sortWithinPartitions(*keys).mapInArrow(compare, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "rep", "component_id": "c"})
    about = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    about = about.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("c", "rep").alias("c"))
    out = rows.select("vec_id", "k1", "k2").join(about, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["rep", "links", "root"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, of ``least`` rows at least, from sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if not same:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
                if t.num_rows >= least:
                    yield t
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k)
            v = (col.dictionary_encode().indices if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cut = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
        for q in range(len(cut) - 1):
            part = batch.slice(cut[q], cut[q + 1] - cut[q])
            if q < len(cut) - 2:
                if held:
                    part = pa.Table.from_batches([*held, part]).combine_chunks().to_batches()[0]
                    held = []
                if part.num_rows >= least:
                    yield part
            else:
                held.append(part)
    if held:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if t.num_rows >= least:
            yield t


#: All pairs of each label, for tables of a few thousand rows.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
 r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, t.vec_id = m.c AS kept FROM embeddings t
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = t.vec_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = t.vec_id
"""
