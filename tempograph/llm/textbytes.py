"""Vectorised work on the UTF-8 bytes of an Arrow string column: segment hashes, words and word shingles.

All arithmetic is modulo 2**64.  A segment's hash is the sum over its bytes of value times a random number of the byte's place,
mixed with the length (multilinear hashing): the places' numbers are independent, so two different segments of one length, whatever
they hold, collide for a share of about 2**-57 of the possible numbers.  Who needs certainty compares the bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_517)
_LANE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: bytes of a segment up to which each place has a random number of its own
LONG = 1 << 20
_PLACE = np.zeros(0, np.uint64)

#: ASCII letters only change case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def places(n: int) -> np.ndarray:
    """Random numbers of the first ``n`` places or more; always the same ones."""
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = np.random.PCG64(20_240_518).random_raw(max(n, 4096) * 2)
    return _PLACE


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Returns freed memory to the system, so that workers that wait for their next task don't hold it (glibc only)."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, text: str | int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text at most; a longer text makes a part of its own."""
    col = batch.column(text).cast(pa.large_string()) if batch.num_rows else None
    if col is None:
        return
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to
    give_back()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts and their end); a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def segment_hashes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of the segments, which must be disjoint, ascending and not empty; ``raw`` holds nothing between them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lens)
    most = int(lens.max())
    with np.errstate(over="ignore"):
        value = raw.astype(np.uint64) + np.uint64(1)
        h = np.add.reduceat(value * places(min(most, LONG))[place if most <= LONG else np.minimum(place, LONG - 1)], starts)
        h = mix(h ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(lens > LONG).tolist() if most > LONG else ():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + lens[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other bytes than ASCII white space) with A-Z in lower case: hashes, byte starts, byte ends, and the
    index of each text's first word (one more entry at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lens = stops - starts
    packed = LOWER[raw[inside]]
    return segment_hashes(packed, np.cumsum(lens) - lens, lens), starts, stops, np.searchsorted(starts, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and the index of each text's first run.  A text of 1 to k-1
    words has one run, the whole sequence; a text without words has none."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), np.uint64)
        for j in range(k):
            total[: max(0, len(h) - j)] += h[j:] * _LANE[j]
        runs = mix(total + np.uint64(k))
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        at = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
        out = runs[take]
        for d in np.flatnonzero((n > 0) & (n < k)):
            own = h[first[d] : first[d + 1]]
            out[at[d]] = mix((own * _LANE[: len(own)]).sum(dtype=np.uint64) + np.uint64(1000 + len(own)))[()]
    return out, at
