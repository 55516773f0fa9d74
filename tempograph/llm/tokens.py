"""Whole-text token ids from a public tokenizer file, with a store of the ids of chunks that were met before.

The tokenizers library encodes each distinct chunk once for a worker; chunks are found by a hash and told apart by their bytes.  A text is cut only where the tokenizer's own
pre-tokenizer always cuts, so that joining the chunks' ids gives the ids of the whole text:

* before a blank or line feed that a character other than white space follows, and after such a line feed (white space
  before the last blank of a run is a pre-token of its own, and the last blank belongs to the word that follows);
* between an ASCII letter and a run of punctuation marks that reaches up to the next cut at white space.

Texts that hold a special token's string are encoded at once, by the library alone.
"""

from __future__ import annotations

import numpy as np

from tempograph.llm.textbytes import segment_hashes

#: About so many chunks are remembered by one worker, the first ones that it meets (speed only).
MEMO = 1_500_000
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!*$%&#|;:?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: bytes that begin a character which is surely no white space
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:] = True
_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending byte places at which chunks begin; texts' starts are among them."""
    n = len(raw)
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    blank, feed = raw == 32, raw == 10
    solid = np.zeros(n, bool)
    solid[:-1] = _SOLID[raw[1:]]
    solid[off[1:][off[1:] > 0] - 1] = False
    at = (blank | feed) & solid
    begins[:-1] |= at
    begins[1:] |= feed & solid
    mark = _MARK[raw]
    first = mark.copy()
    first[1:] &= _LETTER[raw[:-1]]
    first[0] = False
    starts = np.flatnonzero(first)
    if len(starts):
        other = np.flatnonzero(np.concatenate([~mark, [True]]))
        stop = other[np.searchsorted(other, starts)]
        ok = begins[stop]
        # a text's end may lie inside the run of marks
        edge = off[np.searchsorted(off, starts, "right").clip(max=len(off) - 1)]
        begins[starts[ok | (edge <= stop)]] = True
    begins[n] = False
    return np.flatnonzero(begins[:n])


def _same(raw: np.ndarray, begin: np.ndarray, other: np.ndarray, lead: np.ndarray, lens: np.ndarray) -> bool:
    """Whether the segments of ``raw`` at ``begin`` hold the bytes of ``other`` at ``lead``."""
    if not len(lens):
        return True
    within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    return bool((raw[np.repeat(begin, lens) + within] == other[np.repeat(lead, lens) + within]).all())


class Encoder:
    """Encodes texts to little-endian unsigned ids of 2 bytes (vocabularies below 65,536) or 4 bytes."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(name if "/" in name else tokenizer_path(name))
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.special = [str(t.content).encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)
        # the bytes of the chunks that are remembered
        self.text, self.text_at, self.text_len = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks joined, and how many each has."""
        e = self.tok.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, self.kind), np.bincount(np.array(e.word_ids, np.int64), minlength=len(chunks))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has) of the texts raw[off[i]:off[i + 1]]."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        begin = cuts(raw, off)
        lens = np.diff(np.concatenate([begin, [len(raw)]]))
        h = segment_hashes(raw, begin, lens)
        one, where, back = np.unique(h, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, one)
        known = np.zeros(len(one), bool)
        if len(self.keys):
            known = self.keys[spot.clip(max=len(self.keys) - 1)] == one
        # equal hashes must mean equal bytes, within this batch and in what is remembered
        away = (begin[where][back] - begin).astype(np.int32 if len(raw) < 1 << 30 else np.int64)
        if (lens != lens[where][back]).any() or (raw != raw[np.arange(len(raw), dtype=away.dtype) + np.repeat(away, lens)]).any():  # the chunks are all of raw
            return self._plain(raw, off)
        seen = spot[known]
        if (lens[where[known]] != self.text_len[seen]).any() or not _same(raw, begin[where[known]], self.text, self.text_at[seen], self.text_len[seen]):
            return self._plain(raw, off)
        at, count = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        at[known], count[known] = self.at[seen], self.count[seen]
        flat = self.flat
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            chunks = [data[begin[i] : begin[i] + lens[i]] for i in where[new].tolist()]
            ids, many = self._each([c.decode() for c in chunks])
            at[new], count[new] = len(flat) + np.cumsum(many) - many, many
            flat = np.concatenate([flat, ids])
            if len(self.keys) < MEMO:
                size = lens[where[new]]
                self.at, self.count = np.insert(self.at, spot[new], at[new]), np.insert(self.count, spot[new], many)
                self.text_at = np.insert(self.text_at, spot[new], len(self.text) + np.cumsum(size) - size)
                self.text_len = np.insert(self.text_len, spot[new], size)
                self.text = np.concatenate([self.text, np.frombuffer(b"".join(chunks), np.uint8)])
                self.keys, self.flat = np.insert(self.keys, spot[new], one[new]), flat
        many = count[back]
        each = np.add.reduceat(many, np.searchsorted(begin, off[:-1]).clip(max=len(begin) - 1))
        each[off[1:] == off[:-1]] = 0
        out = flat[np.repeat(at[back] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        data = None
        for s in self.special:
            data = raw.tobytes() if data is None else data
            if s in data:
                return self._with_special(data, off, out, each)
        return out, each

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library alone."""
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        parts = [np.array(e.ids, self.kind) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _with_special(self, data: bytes, off: np.ndarray, out: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, ends = [], np.concatenate([[0], np.cumsum(each)])
        for i in range(len(off) - 1):
            text = data[off[i] : off[i + 1]]
            if any(s in text for s in self.special):
                parts.append(np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, self.kind))
            else:
                parts.append(out[ends[i] : ends[i + 1]])
        return np.concatenate(parts), np.array([len(p) for p in parts])


def encoder(name: str) -> Encoder:
    """One encoder for each file and worker process."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(name)
    return _LOADED[name]
