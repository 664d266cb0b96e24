"""Token ids by the tokenizers library, each piece of a text encoded once.

Pre-tokenizers of these files cut texts by character class, and no token crosses a cut. A text can therefore be cut at
such places and equal pieces encoded once. Three ways, the first that a text allows:
- ASCII and Latin-1 letters without apostrophes: pieces are runs of letters and runs of other characters. Texts are cut,
  and pieces of up to 24 bytes are looked up by their bytes, as arrays, without a Python object per piece;
- no white space but space and line feed: pieces are what stands between blanks;
- others, and texts with a special token's text: the library takes the text whole.
Ids come as bytes: little-endian unsigned 32-bit.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cachelens.llm._text import mix  # noqa: E402

#: A white-space character by any definition in use, other than space and line feed.
_ODD = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85\\u180e\\u200b-\\u200f\\u2028\\u2029\\u2060\\ufeff]").search
_LETTER = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
_LATIN = bytes([0x0A, *range(0x20, 0x27), *range(0x28, 0x7F), *(b for b in _LETTER if b > 0x7F)])
_LOWER = bytes(ord(c.lower()) if b in _LETTER else b for b, c in enumerate(map(chr, range(256))))
_COARSE = {True: re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall, False: re.compile(r"[^ \n]+").findall}
#: Kinds of bytes of Latin texts, which end with a zero byte.
_END, _WORD, _SIGN, _BLANK = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[_LETTER], _KIND[[0x0A, 0x20]], _KIND[0] = _WORD, _BLANK, _END
#: Keeps the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_KEYED = 24  # bytes of a piece that three words hold
_PART = 1 << 20
U = np.uint64


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_signs() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_SIGNS = np.array([_byte_signs().get(b, b) if b != 0x0A else b for b in range(256)], "<u4")


class _Words:
    """The same model for lines of words, without the steps that leave a word of lower-case Latin letters as it is."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None}
        spec |= {"pre_tokenizer": {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that a token stands for
        for token, i in vocabulary.items():
            self.size[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the Latin-1 words, and how many each word has."""
        lines = [b"\n".join(words[at : at + 256]).decode("latin-1").encode() for at in range(0, len(words), 256)]
        lines = [_SIGNS[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in lines]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.cumsum([len(w) for line in lines for w in line.split("\n")])
        upto = np.cumsum(self.size[ids])
        last = np.searchsorted(upto, ends)
        if len(ids) and not (upto[last] == ends).all():
            raise ValueError("tokens do not add up to words")
        return ids, np.diff(last + 1, prepend=0)


class _Table:
    """Pieces of up to 24 bytes, by their bytes, with their ids: open addressing over arrays."""

    def __init__(self):
        self.n = self.used = 0
        self.keys, self.off, self.size = [np.zeros(1 << 14, U) for _ in range(3)], np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.slots, self.words = np.full(1 << 16, -1, np.int32), np.zeros(1 << 16, U)  # entries, and their first words

    @staticmethod
    def hash(keys: list[np.ndarray]) -> np.ndarray:
        return mix(keys[0] + keys[1] * U(0x9E3779B97F4A7C15) + keys[2] * U(0xC2B2AE3D27D4EB4F))

    def find(self, keys: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Entries of the keys, -1 where there is none. Pieces have no zero bytes, so where the first word is not full it says all."""
        got = np.full(len(h), -1, np.int64)
        todo, mask = np.arange(len(h)), U(len(self.slots) - 1)
        first, full = keys[0], keys[0] >> U(56) != 0
        while len(todo):
            slot = (h & mask).view(np.int64)
            entry = self.slots.take(slot)
            same = self.words.take(slot) == first
            more = np.flatnonzero(same & full)
            if len(more):
                e, k = entry[more], todo[more]
                same[more] = (self.keys[1].take(e) == keys[1].take(k)) & (self.keys[2].take(e) == keys[2].take(k))
            hit = np.flatnonzero(same)
            got[todo[hit]] = entry[hit]
            rest = np.flatnonzero((entry >= 0) & ~same)
            todo, h, first, full = todo[rest], h[rest] + U(1), first[rest], full[rest]
        return got

    def _place(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = U(len(self.slots) - 1)
        while len(entries):
            slot = (h & mask).astype(np.int64)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            self.words[slot[free]] = self.keys[0][self.slots[slot[free]]]
            lost = np.flatnonzero(self.slots[slot] != entries)
            h, entries = h[lost] + U(1), entries[lost]

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries, which find() does not see yet."""
        n, used = self.n + len(sizes), self.used + len(ids)
        while len(self.off) < n:
            self.keys, self.off, self.size = [np.append(k, np.zeros_like(k)) for k in self.keys], np.append(self.off, np.zeros_like(self.off)), np.append(self.size, np.zeros_like(self.size))
        while len(self.ids) < used:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        entries = np.arange(self.n, n)
        self.size[entries] = sizes
        self.off[entries] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = ids
        self.n, self.used = n, used
        return entries

    def add(self, keys: list[np.ndarray], h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        entries = self.append(ids, sizes)
        for mine, k in zip(self.keys, keys, strict=True):
            mine[entries] = k
        if 2 * self.n > len(self.slots):
            while 2 * self.n > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, np.int32)
            self.slots[:] = -1
            self.words = np.zeros(len(self.slots), U)
            self._place(self.hash([k[: self.n] for k in self.keys]), np.arange(self.n))
        else:
            self._place(h, entries)
        return entries

    def short(self) -> _Table:
        """A table of the pieces of at most eight bytes, as the frequent ones are short."""
        keep = np.flatnonzero(self.keys[1][: self.n] == 0)
        out = _Table()
        out.add(some := [k[keep] for k in self.keys], self.hash(some), self.gathered(keep), self.size[keep])
        return out

    def gathered(self, entries: np.ndarray) -> np.ndarray:
        """Ids of the entries, one after the other."""
        sizes = self.size[entries]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.off[entries] - before, sizes)
        at += np.arange(len(at))
        return self.ids[at]


class PieceEncoder:
    """spaces: whether blanks have tokens; if not, the file also lower-cases. limit: pieces remembered at once, so memory has a bound."""

    def __init__(self, path: str, spaces: bool, limit: int):
        self.tokenizer, self.words = Tokenizer.from_file(path), _Words(path)
        self.spaces, self.limit, self.known, self.table = spaces, limit, {}, _Table()

    def _latin(self, text: str) -> bytes | None:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, _LATIN):
            return None
        return raw if self.spaces else raw.translate(_LOWER)

    def _parts(self, text: str) -> list[str] | None:
        return None if "<|" in text or _ODD(text) else _COARSE[self.spaces](text)

    def _many(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(pieces), 8192) for e in self.tokenizer.encode_batch_fast(pieces[at : at + 8192], add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _cut(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and end, in texts that each end with a zero byte."""
        kind = _KIND[buf]
        new = np.ones(len(buf), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        if self.spaces:  # one space belongs to what follows it; the last blank of a run before something stands apart
            solid = (kind == _WORD) | (kind == _SIGN)
            new[1:] &= ~(solid[1:] & (buf[:-1] == 0x20))
            new[:-1] |= (kind[:-1] == _BLANK) & solid[1:]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(buf))
        first = kind[starts]
        keep = first != _END if self.spaces else (first == _WORD) | (first == _SIGN)
        return starts[keep], ends[keep]

    def _entries(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        """Entries of the table for all pieces, and the table's length to go back to, without those of longer pieces."""
        size = ends - starts
        word = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
        keys = [word[starts] & _FIRST[np.minimum(size, 8)]]
        for at in (8, 16):
            more = np.flatnonzero(size > at)
            k = np.zeros(len(size), U)
            k[more] = word[starts[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
            keys.append(k)
        h = self.table.hash(keys)
        got = self.table.find(keys, h)
        long = np.flatnonzero(size > _KEYED)
        got[long] = 0
        miss = np.flatnonzero(got < 0)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if any((k[miss] != k[miss][one][back]).any() for k in keys):  # different pieces with one hash
                _, one, back = np.unique(np.stack([k[miss] for k in keys], 1), axis=0, return_index=True, return_inverse=True)
            new = miss[one]
            pieces = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            is_word = _KIND[np.frombuffer(raw, np.uint8)[ends[new] - 1]] == _WORD
            entries = np.zeros(len(new), np.int64)
            for some, encode in ((np.flatnonzero(is_word), self.words.encode), (np.flatnonzero(~is_word), self._signs)):
                if len(some):
                    ids, sizes = encode([pieces[i] for i in some])
                    entries[some] = self.table.add([k[new[some]] for k in keys], h[new[some]], ids, sizes)
            got[miss] = entries[back]
        kept = self.table.n, self.table.used
        if len(long):
            pieces = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            order = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            entries = self.table.append(*self._signs(list(order)))
            got[long] = entries[[order[p] for p in pieces]]
        return got, kept

    def _signs(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._many([p.decode("latin-1") for p in pieces])
        return np.array([*chain.from_iterable(ids)], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _latin_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        if not texts:
            return
        if self.table.n > self.limit:
            short = self.table.short()
            self.table = short if 2 * short.n < self.limit else _Table()
        raw = b"\0".join([*texts, b""])
        starts, ends = self._cut(np.frombuffer(raw, np.uint8))
        entries, kept = self._entries(raw, starts, ends)
        ids = self.table.gathered(entries)
        upto = np.concatenate(([0], np.cumsum(self.table.size[entries])))
        self.table.n, self.table.used = kept
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        bounds = upto[np.searchsorted(starts, first)].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b].tobytes()

    def _coarse_ids(self, parts: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > self.limit // 4:
            short = {p: b for p, b in self.known.items() if len(p) < 9}
            self.known = short if 8 * len(short) < self.limit else {}
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(parts)))
        long = {p: self._whole(p) for p in new if len(p) > 64}
        some = list(new.difference(long))
        self.known.update(zip(some, map(packed, self._many(some)), strict=True))
        get = (lambda p: long[p] if p in long else self.known[p]) if long else self.known.__getitem__
        for p in parts:
            yield b"".join(map(get, p))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each whole text; None is the empty text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") < _PART):
                size += len(texts[to] or "")
                to += 1
            some = [t or "" for t in texts[at:to]]
            latin = [self._latin(t) if "<|" not in t else None for t in some]
            parts = [self._parts(t) if r is None else None for t, r in zip(some, latin, strict=True)]
            fine, coarse = self._latin_ids([r for r in latin if r is not None]), self._coarse_ids([p for p in parts if p is not None])
            for t, r, p in zip(some, latin, parts, strict=True):
                yield next(fine) if r is not None else next(coarse) if p is not None else self._whole(t)
            at = to


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaces: bool, limit: int = 1_200_000) -> PieceEncoder:
    """One for each Python worker, which serves many tasks; what it has learned doesn't change results. A million pieces take
    about 100 MB; the limit is that of the last call."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = PieceEncoder(path, spaces, limit)
    _encoders[path, spaces].limit = limit
    return _encoders[path, spaces]
