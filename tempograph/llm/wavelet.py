"""Operator 4: token-id output as one compressed wavelet-matrix file for each shard.

A shard is a contiguous range of doc_id (nulls first, ties keep together).  Its file holds the bit-planes of the shard's
token ids, most frequent id first, in zstandard blocks with a rank directory, so that one file answers token access,
counting, occurrence lookup (select) and full decoding.

Defined results: a null text is an empty text (its document has the end id only); repeated rows stay repeated; an empty
table gives no files and no rows; further input columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.base import Scratch
from tempograph.llm.textbytes import slices, utf8
from tempograph.llm.tokens import encoder

MAGIC = b"TGWM0001"
#: bits of a block; the directory has the ones before each block
BLOCK = 1 << 16
#: bytes of text in a shard, about
SHARD = 32_000_000


def file_system(uri: str):
    """(file system, path) of a URI that every executor can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def build(ids: np.ndarray, docs: np.ndarray, known: np.ndarray, lens: np.ndarray) -> bytes:
    """A file's content.  ids: of all documents one after the other; docs, known, lens: each one's id, whether it has one,
    and its number of ids."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    many = np.bincount(ids, minlength=1)
    alphabet = np.flatnonzero(many)
    alphabet = alphabet[np.argsort(-many[alphabet], kind="stable")]
    width = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    rank = np.zeros(len(many), np.uint16 if width <= 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    values = rank[ids]
    body, zeros, blocks = io.BytesIO(), [], []
    for plane in range(width - 1, -1, -1):
        bits = (values >> plane & 1).astype(bool)
        packed = np.packbits(bits, bitorder="little")
        ones = 0
        for a in range(0, len(packed), BLOCK // 8):
            part = packed[a : a + BLOCK // 8]
            blocks.append((body.tell(), ones))
            ones += int(np.bitwise_count(part).sum())
            body.write(pack(part.tobytes()))
        zeros.append(len(bits) - ones)
        values = np.concatenate([values[~bits], values[bits]])
    blocks.append((body.tell(), 0))
    tables = [alphabet.astype("<u4"), docs.astype("<i8"), known.astype("u1"), lens.astype("<u8"), np.array(blocks, "<u8")]
    raw = [pack(t.tobytes()) for t in tables]
    head = json.dumps({"n": len(ids), "docs": len(docs), "width": width, "zeros": zeros, "tables": [len(r) for r in raw]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *raw, body.getvalue()])


class WaveletFile:
    """Reader of one file's content."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self._unpack = zstandard.ZstdDecompressor().decompress
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + size])
        at, tables = 16 + size, []
        for length, kind in zip(head["tables"], ("<u4", "<i8", "u1", "<u8", "<u8"), strict=True):
            tables.append(np.frombuffer(self._unpack(data[at : at + length]), kind))
            at += length
        self.n, self.width, self.zeros = head["n"], head["width"], head["zeros"]
        self.alphabet, self.docs, self.known, self.lens = tables[0], tables[1], tables[2].astype(bool), tables[3].astype(np.int64)
        self.blocks = tables[4].reshape(-1, 2).astype(np.int64)
        self.per = math.ceil(math.ceil(self.n / 8) / (BLOCK // 8)) if self.n else 0
        self._body, self._data = at, data
        self._cache: dict[int, np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per + block
        if k not in self._cache:
            if len(self._cache) > 64:
                self._cache.clear()
            raw = self._unpack(self._data[self._body + self.blocks[k, 0] : self._body + self.blocks[k + 1, 0]])
            self._cache[k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
        return self._cache[k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        b, rest = divmod(i, BLOCK)
        return int(self.blocks[plane * self.per + b, 1]) + int(self._block(plane, b)[:rest].sum())

    def access(self, i: int) -> int:
        """The token at place i."""
        code = 0
        for p in range(self.width):
            bit = bool(self._block(p, i // BLOCK)[i % BLOCK])
            ones = self._ones(p, i)
            code, i = code << 1 | bit, self.zeros[p] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        found = np.flatnonzero(self.alphabet == token)
        if not len(found):
            return 0, 0
        for p in range(self.width):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if found[0] >> (self.width - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs in places lo to hi - 1."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, j: int) -> int:
        """Place of the token's occurrence number j (from 0)."""
        lo, hi = self._span(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        code, at = int(np.flatnonzero(self.alphabet == token)[0]), lo + j
        for p in range(self.width - 1, -1, -1):
            one = code >> (self.width - 1 - p) & 1
            want = at - self.zeros[p] if one else at
            lo_b, hi_b = 0, self.per - 1  # the last block with at most `want` such bits before it
            before = lambda b, p=p, one=one: int(self.blocks[p * self.per + b, 1]) if one else b * BLOCK - int(self.blocks[p * self.per + b, 1])
            while lo_b < hi_b:
                mid = (lo_b + hi_b + 1) // 2
                lo_b, hi_b = (mid, hi_b) if before(mid) <= want else (lo_b, mid - 1)
            bits = self._block(p, lo_b)[: self.n - lo_b * BLOCK]
            at = lo_b * BLOCK + int(np.flatnonzero(bits == bool(one))[want - before(lo_b)])
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, decoded plane by plane from the last one up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.width - 1, -1, -1):
            raw = b"".join(
                self._unpack(self._data[self._body + self.blocks[k, 0] : self._body + self.blocks[k + 1, 0]]) for k in range(p * self.per, (p + 1) * self.per)
            )
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).astype(bool)
            above = np.empty(self.n, kind)
            above[~bits], above[bits] = values[: self.zeros[p]], values[self.zeros[p] :] | kind(1 << (self.width - 1 - p))
            values = above
        return self.alphabet[values] if self.n else np.zeros(0, "<u4")


#: ranges of doc_id that are cut at once; more shards are cut within each range
RANGES = 1024


def cuts(docs: DataFrame, n: int) -> np.ndarray:
    """About n - 1 ascending doc_ids at which shards begin, by approximate quantiles: of the whole, and beyond RANGES shards also within each of
    so many ranges, so that no aggregate holds more than one range's share."""
    at = lambda df, k: df.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], max(10_000, 50 * k)).alias("at"))
    top = min(n, RANGES)
    found = at(docs, top).first()["at"]
    bounds = np.array(found or [0], np.int64)[: top - 1]
    if n == top or found is None:
        return bounds
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(shared.value, batch.column("doc_id").to_numpy(), "right")), batch.column("doc_id")], ["r", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").mapInArrow(ranged, "r long, doc_id long")
    fine = at(rows.groupBy("r"), -(-n // top)).select(F.explode("at").alias("at")).toArrow().column("at").to_numpy()
    shared.destroy()
    return np.unique(np.concatenate([bounds, fine]))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD) -> DataFrame:
    """Write ``folder``/shard-N.wm for all rows of ``docs`` (doc_id, text); lazily returns (shard, path, n_docs, n_tokens,
    n_bytes), a row for each file.  A file is written under a name of its attempt and then renamed, so that a task can be
    run again at any time."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, math.ceil(size / shard_bytes))
    bounds = docs.sparkSession.sparkContext.broadcast(cuts(docs, n))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = np.dtype("<u2") if enc.kind.itemsize == 2 and end_id < 65_536 else np.dtype("<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = utf8(part.column("text"))
                ids, many = enc.encode(raw, off)
                ends = np.cumsum(many)
                out = np.insert(ids.astype(wide), ends, end_id)
                at = (np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * wide.itemsize).astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))])
                key = np.searchsorted(bounds.value, part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), part.column("doc_id"), values], ["shard", "doc_id", "ids"])

    def write(table: pa.Table) -> pa.Table:
        enc = encoder(tokenizer)
        wide = np.dtype("<u2") if enc.kind.itemsize == 2 and end_id < 65_536 else np.dtype("<u4")
        shard = table.column("shard")[0].as_py()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_start"))
        parts = [np.frombuffer(x.as_buffer(), wide) for x in table.column("ids")]
        doc = table.column("doc_id").combine_chunks()
        data = build(np.concatenate(parts), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), np.array([len(p) for p in parts]))
        path = f"{folder}/shard-{shard:08d}.wm"
        fs, at = file_system(path)
        fs.create_dir(os.path.dirname(at), recursive=True)
        own = f"{at}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(own) as f:
            f.write(data)
        fs.move(own, at)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(parts)], "n_tokens": [sum(map(len, parts))], "n_bytes": [len(data)]})

    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    return coded.groupBy("shard").applyInArrow(write, "shard int, path string, n_docs long, n_tokens long, n_bytes long")


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Decode the files named by ``shards`` (as write_shards returns it, and written before): a row (doc_id, start,
    n_tokens, ids) for each document, start over all shards in order.  The running sum over shards is taken in two
    levels, so that no task sees more than about the square root of their number."""
    from pyspark.sql import Window

    shards = shards.withColumn("g", F.expr("shard div 1024"))
    groups = shards.groupBy("g").agg(F.sum("n_tokens").alias("t"))
    groups = groups.select("g", (F.sum("t").over(Window.orderBy("g")) - F.col("t")).alias("base"))
    inner = Window.partitionBy("g").orderBy("shard")
    based = shards.join(groups, "g").select("shard", "path", (F.col("base") + F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = file_system(path)
                with fs.open_input_stream(at) as f:
                    w = WaveletFile(f.read())
                ids, ends = np.ascontiguousarray(w.tokens().astype("<u4")), np.cumsum(w.lens)
                for a in range(0, len(ends), 512):
                    e = ends[a : a + 512]
                    s = e - w.lens[a : a + 512]
                    off = (np.concatenate([s[:1], e]) - s[0]).astype(np.int64) * 4
                    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(e), [None, pa.py_buffer(off), pa.py_buffer(ids[s[0] : e[-1]])]).cast(pa.binary())
                    doc = pa.array(w.docs[a : a + 512], pa.int64(), mask=~w.known[a : a + 512])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(base + s), pa.array(e - s), values], ["doc_id", "start", "n_tokens", "ids"])

    return based.repartition(max(1, shards.count()), "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = SHARD) -> DataFrame:
    """Write all documents to shard files in the shared folder, read the files back, and give for each document
    doc_id, start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "wavelet")
    shards = scratch.save(write_shards(docs, scratch.path("files"), tokenizer, end_id, shard_bytes), "shards")
    return read_shards(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
