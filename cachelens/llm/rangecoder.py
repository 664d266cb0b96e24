"""Adaptive context-mixing range coder for token ids.

A block holds the ids of whole documents, cut into lanes of equal length that are coded in step. All lanes of a block
share one model, reset at its start: after each step it learns the ids just coded. Order 2 (hashed) and order 1 each keep
the id last seen after the two ids before, and after the one before, with a confidence. The guess is order 2's where its
confidence is over a third of order 1's, else that; it is mixed, as a point mass, with the distribution of all ids so far
(order 0), at the rate at which guesses held in the same state: both confidences, and whether both orders say the same.
The mixture's cumulative distribution has a closed form, so a step is a few array operations.
Each lane is a carry-less range coder with a 64-bit low end that sends 16 bits at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
MAGIC = b"CLRC"
VERSION = 3
#: Magic, version, 0, vocabulary, documents, ids, lanes, bytes of words, crc32 of all that follows.
HEAD = struct.Struct("<4sHHIIIIII")
T0 = 20  # log2 of the total of order 0
TW = 12  # log2 of the total of the weights
SHARE, BITS2 = U(T0 + TW), 18
TOP, BOTTOM = U(1 << 48), U(1 << 44)
STEPS, LANES, REBUILD = 256, 4096, 16


#: What an entry's confidence changes by, by confidence and, from 16 on, after a hit; entries of 0 or 1 that miss are replaced.
_CHANGE = np.array([0, 0, *(-((c + 1) >> 1) for c in range(2, 16)), *[1] * 15, 0])


class Model:
    """Entries of the tables of order 1 and 2 are id * 16 + confidence."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.seen: list[np.ndarray] = []  # ids that the counts do not hold yet
        self.one, self.two = np.zeros(vocabulary, np.int64), np.zeros(1 << BITS2, np.int64)
        self.last, self.slot = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.hits = np.ones((512, 2))  # by both confidences and whether both orders say the same: guesses that failed and held
        self.steps = 0
        self.rebuild()
        self.weigh()

    def rebuild(self) -> None:
        """Order 0 as integer frequencies with total 2^T0."""
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary)
            self.seen = []
        f = 1 + self.counts * ((1 << T0) - self.vocabulary) // max(1, int(self.counts.sum()))
        f[0] += (1 << T0) - int(f.sum())
        self.freq = f
        self.start = np.cumsum(f) - f
        self.at = None

    def weigh(self) -> None:
        """Weights of order 0 and of the guess, by state, which sum to 2^TW."""
        w = (self.hits[:, 1] / self.hits.sum(1) * ((1 << TW) - 16)).astype(np.int64)
        self.weights = (1 << TW) - w, w

    def predict(self) -> None:
        self.e1, self.e2 = self.one.take(self.last), self.two.take(self.slot)
        self.p1, self.p2, self.s1, self.s2 = self.e1 >> 4, self.e2 >> 4, self.e1 & 15, self.e2 & 15
        differ = self.p2 - self.p1
        self.guess = self.p1 + differ * (3 * self.s2 > self.s1)
        self.bucket = (self.s2 << 5) + (self.s1 << 1) + (differ == 0)
        self.w0, self.w = (w.take(self.bucket) for w in self.weights)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hit = self.guess == ids
        mass = self.w << T0
        return self.w0 * self.start.take(ids) + mass * (self.guess < ids), self.w0 * self.freq.take(ids) + mass * self.hit

    def found(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the targets, and these intervals."""
        if self.at is None:
            self.at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.freq)
        mass, low = self.w << T0, self.w0 * self.start.take(self.guess)
        size = self.w0 * self.freq.take(self.guess) + mass
        past = target >= low + size
        self.hit = (target >= low) & ~past
        begin = mass * past
        # both operands are below 2^53 and the divisor below 2^12, so the floor of the quotient is exact
        plain = ((target - begin) / self.w0).astype(np.int64)
        ids = self.at.take(plain, mode="clip").astype(np.int64)
        begin += self.w0 * self.start.take(ids)
        width = self.w0 * self.freq.take(ids)
        at = np.flatnonzero(self.hit)
        ids[at], begin[at], width[at] = self.guess[at], low[at], size[at]
        return ids, begin, width

    def learn(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.hits += np.bincount(((self.bucket << 1) + self.hit)[:n], minlength=1024).reshape(512, 2)
        new = (ids << 4) + 1
        ids_ = ids if n == len(self.last) else np.append(ids, np.zeros(len(self.last) - n, np.int64))
        for table, at, e, sure, hit in ((self.one, self.last, self.e1, self.s1, self.p1 == ids_), (self.two, self.slot, self.e2, self.s2, self.p2 == ids_)):
            state = ((hit << 4) + sure)[:n]
            e = e[:n] + _CHANGE.take(state)
            weak = np.flatnonzero(state < 2)
            e[weak] = new[weak]
            table[at[:n]] = e
        self.seen.append(ids)
        slot = self.last[:n] * 0x9E3779B1
        slot += ids * 0x85EBCA6B
        slot >>= 7
        slot &= (1 << BITS2) - 1
        self.slot[:n], self.last[:n] = slot, ids
        self.steps += 1
        early = self.steps & (self.steps - 1) == 0  # soon at first, then seldom
        if self.steps % REBUILD == 0 or early:
            self.rebuild()
        if self.steps % 4 == 0 or early:
            self.weigh()


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids: the first lanes may be one id longer."""
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _lanes(n: int) -> tuple[int, np.ndarray, int]:
    lanes, steps = shape(n)
    full = n - (steps - 1) * lanes  # lanes with an id in the last step
    sizes = np.full(lanes, steps - 1) + (np.arange(lanes) < full)
    return steps, np.concatenate(([0], np.cumsum(sizes))), full


def encode_block(docs: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """A self-contained block of whole documents. Ids must be below `vocabulary`, which must be below 2^20."""
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    if len(flat) and not 0 <= flat.min() <= flat.max() < vocabulary < 1 << T0:
        raise ValueError("ids outside the vocabulary")
    table = np.array([(0 if d is None else d, d is None, len(x)) for d, x in zip(docs, ids, strict=True)], np.int64).reshape(-1, 3)
    meta = zlib.compress(table.T.astype("<i8").tobytes(), 1)
    words, sizes = b"", np.zeros(0, np.uint16)
    if n := len(flat):
        steps, first, full = _lanes(n)
        lanes = len(first) - 1
        model = Model(vocabulary, lanes)
        low, width = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        out, at = np.zeros((lanes, 2 * steps + 8), np.uint16), np.zeros(lanes, np.int64)
        for s in range(steps):
            m = lanes if s < steps - 1 else full
            x = flat[first[:-1] + s] if m == lanes else np.append(flat[first[:m] + s], np.zeros(lanes - m, np.int64))
            model.predict()
            start, size = (v.view(U) for v in model.interval(x))
            unit = width[:m] >> SHARE
            low[:m] += unit * start[:m]
            width[:m] = unit * size[:m]
            _send(low[:m], width[:m], out, at)
            model.learn(x[:m])
        last = low + U((1 << 32) - 1)  # 32 bits that name a value inside the width, whatever bits follow them
        for shift in (48, 32):
            out[np.arange(lanes), at] = (last >> U(shift)).astype(np.uint16)
            at += 1
        sizes = at.astype("<u2")
        words = out[np.arange(out.shape[1]) < at[:, None]].astype("<u2").tobytes()
    body = struct.pack("<I", len(meta)) + meta + sizes.tobytes() + words
    head = HEAD.pack(MAGIC, VERSION, 0, vocabulary, len(docs), n, len(sizes), len(words), zlib.crc32(body))
    return head + body


def _due(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes that can send 16 bits, their low ends, and their widths, cut where a carry could still reach the bits sent."""
    idx = np.flatnonzero(width < TOP)
    lo, w = low[idx], width[idx]
    same = (lo ^ (lo + w)) < TOP
    due = same | (w < BOTTOM)
    idx, lo, w, same = idx[due], lo[due], w[due], same[due]
    if not same.all():
        w = np.where(same, w, (~lo + U(1)) & (BOTTOM - U(1)))
    return idx, lo, w


def _send(low: np.ndarray, width: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    idx, lo, w = _due(low, width)
    while len(idx):
        to = at[idx]
        out[idx, to] = lo >> U(48)
        at[idx] = to + 1
        lo, w = lo << U(16), w << U(16)
        low[idx], width[idx] = lo, w
        again, lo, w = _due(lo, w)
        idx = idx[again]


def decode_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents and their ids. Raises ValueError if the block is not whole."""
    if len(block) < HEAD.size:
        raise ValueError("block too short")
    magic, version, _, vocabulary, docs, n, lanes, size, crc = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc:
        raise ValueError("not a block, or a damaged one")
    (k,) = struct.unpack_from("<I", body)
    table = np.frombuffer(zlib.decompress(body[4 : 4 + k]), "<i8").reshape(3, docs)
    sizes = np.frombuffer(body[4 + k : 4 + k + 2 * lanes], "<u2").astype(np.int64)
    words = np.append(np.frombuffer(body[4 + k + 2 * lanes :], "<u2"), np.zeros(4, np.uint16)).astype(U)
    flat = np.zeros(n, np.int64)
    if n:
        steps, first, full = _lanes(n)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        code = np.zeros(lanes, U)
        for _ in range(4):
            code = (code << U(16)) | words[at]
            at += 1
        model = Model(vocabulary, lanes)
        low, width = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        for s in range(steps):
            m = lanes if s < steps - 1 else full
            model.predict()
            unit = width >> SHARE
            target = np.minimum((code - low) // unit, U((1 << (T0 + TW)) - 1)).view(np.int64)
            x, start, size_ = model.found(target)
            low[:m] += (unit * start.view(U))[:m]
            width[:m] = (unit * size_.view(U))[:m]
            idx, lo, w = _due(low[:m], width[:m])
            while len(idx):
                to = at[idx]
                code[idx] = (code[idx] << U(16)) | words[to]
                at[idx] = to + 1
                lo, w = lo << U(16), w << U(16)
                low[idx], width[idx] = lo, w
                again, lo, w = _due(lo, w)
                idx = idx[again]
            flat[first[:m] + s] = x[:m]
            model.learn(x[:m])
    ids = np.split(flat, np.cumsum(table[2])[:-1]) if docs else []
    return [None if missing else int(d) for d, missing in table[:2].T.tolist()], ids
