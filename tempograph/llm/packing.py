"""Operator 3: best-fit packing of documents into sequences by pattern packing with non-negative least squares.

Lengths become a histogram (as many bins as a sequence has tokens, whatever the input's size).  Patterns of two or three
length classes that fill a sequence are enumerated; non-negative least squares fits their repeat counts to the histogram;
the counts are rounded down, and what is left is packed best fit, longest first, into the gaps of the patterns and into new
sequences.  All of that works on counts.  The pieces themselves are only numbered within their length, in about
sqrt(count) chunks so that a length that a third of all documents share is spread over many tasks, and then look their place up.

Defined results: a null text is an empty text (its document is the end id alone); repeated rows are packed each; an empty
table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.base import Scratch
from tempograph.llm.textbytes import give_back, slices, utf8
from tempograph.llm.tokens import encoder

#: tokens of a length class
CLASS = 4


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 (active set; columns enter by the largest gradient)."""
    n = a.shape[1]
    gram, atb = a.T @ a if n <= 2000 else None, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = atb - a.T @ (a @ x)
        w[passive] = -np.inf
        if passive.all() or w.max() <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        # several columns enter at once while they are far from the optimum
        enter = np.argsort(-w)[:8]
        passive[enter[w[enter] > 0.5 * w.max()]] = True
        while True:
            at = np.flatnonzero(passive)
            sub = gram[np.ix_(at, at)] if gram is not None else a[:, at].T @ a[:, at]
            s = np.linalg.lstsq(sub, atb[at], rcond=1e-10)[0]
            if (s > 1e-10).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 1e-10
            old = x[at]
            step = np.min(np.where(bad, old / np.maximum(old - s, 1e-300), np.inf))
            x[at] = old + min(1.0, step) * (s - old)
            passive[at[(x[at] <= 1e-10) & bad]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(counts: np.ndarray) -> np.ndarray:
    """Pairs and triples of classes (1-based, 0 for none) that are in use and whose upper lengths fill a sequence."""
    m = len(counts) - 1
    have = np.flatnonzero(counts[1:]) + 1
    used = np.zeros(m + 1, bool)
    used[have] = True
    found = [(k, m - k, 0) for k in have.tolist() if k <= m - k and used[m - k]]
    for k in have.tolist():
        js = have[(have >= k) & (have <= (m - k) // 2)]
        rest = m - k - js
        found += [(k, int(j), int(r)) for j, r in zip(js[used[rest] & (rest >= js)], rest[used[rest] & (rest >= js)], strict=True)]
    return np.array(found, np.int64).reshape(-1, 3)


def plan(hist: np.ndarray, most: int, width: int = CLASS, limit: int = 8000) -> list[tuple[int, list[int]]]:
    """Sequences as (repeats, lengths) for a histogram over lengths 0..most.

    Classes become wider until at most ``limit`` patterns are left for the solver, which bounds its time for any input."""
    left = hist.astype(np.int64).copy()
    groups: list[tuple[int, list[int]]] = []
    if left[most]:
        groups.append((int(left[most]), [most]))
        left[most] = 0
    while True:
        m = most // width
        of = -(-np.arange(most + 1) // width)
        counts = np.bincount(of, weights=left, minlength=m + 1)[: m + 1]
        found = patterns(counts)
        if len(found) <= limit or width * 2 > most // 4:
            break
        width *= 2
    taken: list[tuple[int, list[int]]] = []
    if len(found):
        a = np.zeros((m + 1, len(found)))
        for c in range(3):
            np.add.at(a, (found[:, c], np.arange(len(found))), found[:, c] > 0)
        weight = np.sqrt(np.arange(m + 1) / m)  # a long document that is left over costs more
        x = np.floor(nnls(a * weight[:, None], counts * weight) + 1e-6).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            classes, want = [int(k) for k in found[p][::-1] if k], int(x[p])
            while want > 0:
                # the longest of each class go together, the last place takes the document that fits best
                lengths: list[int] = []
                for k in classes:
                    gap = most - sum(lengths)
                    top = min(gap, k * width) if len(lengths) < len(classes) - 1 else gap
                    low = (k - 1) * width + 1
                    near = [n for n in range(top, low - 1, -1) if left[n] > lengths.count(n)][:1]
                    lengths += near
                if len(lengths) < len(classes):
                    break
                step = min([want, *(int(left[n]) // lengths.count(n) for n in lengths)])
                for n in lengths:
                    left[n] -= step
                taken.append((step, lengths))
                want -= step
    # best fit, longest first; open sequences by their gap
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    sizes: list[int] = []


    def put(gap: int, group: tuple[int, list[int]]) -> None:
        if not gap:
            groups.append(group)
            return
        if not gaps[gap]:
            bisect.insort(sizes, gap)
        gaps[gap].append(group)

    for r, lengths in taken:
        put(most - sum(lengths), (r, lengths))
    for n in range(most, 0, -1):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                fit = most // n
                full, rest = divmod(int(left[n]), fit)
                left[n] = 0
                if full:
                    put(most - fit * n, (full, [n] * fit))
                if rest:
                    put(most - rest * n, (1, [n] * rest))
                break
            gap = sizes[at]
            r, lengths = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(at)
            use = min(r, int(left[n]))
            left[n] -= use
            put(gap - n, (use, [*lengths, n]))
            if use < r:
                put(gap, (r - use, lengths))
    groups += [g for gap in sizes for g in gaps[gap]]
    return groups


def runs(groups: list[tuple[int, list[int]]], most: int) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces' numbers: rows (first number, sequence of that one, offset)."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for repeats, lengths in groups:
        offset = 0
        for n in lengths:
            out[n].append((used[n], sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    return {n: np.array(v, np.int64) for n, v in out.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with the end id, those above ``most`` tokens cut from their
    end into pieces of ``most``, the first piece shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, many = enc.encode(*utf8(part.column("text")))
                ends = np.cumsum(many)
                ids = np.insert(ids.astype("<u4"), ends, end_id)
                size = many + 1
                first = np.cumsum(size) - size
                count = -(-size // most)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                short = size - (count - 1) * most
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * most)
                length = np.where(piece == 0, short[doc], most)
                at = (first[doc] + start).tolist()
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, end_id, most), "pieces")
    counts = cut.groupBy("length").count().collect()  # at most `most` rows
    hist = np.zeros(most + 1, np.int64)
    for row in counts:
        hist[row["length"]] = row["count"]
    places = runs(plan(hist, most), most)
    give_back()

    chunks = docs.sparkSession.createDataFrame([(n, max(1, int(hist[n] ** 0.5))) for n in np.flatnonzero(hist).tolist()], "length long, chunks long")
    cut = cut.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "chunks"))
    sizes = cut.groupBy("length", "chunk").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("chunk")
    sizes = sizes.select("length", "chunk", (F.sum("size").over(before) - F.col("size")).alias("base"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("number", F.row_number().over(within) - 1).join(sizes, ["length", "chunk"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                run = places[n][np.searchsorted(places[n][:, 0], number[at], "right") - 1]
                sequence[at], offset[at] = run[:, 1] + number[at] - run[:, 0], run[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
