"""Packing documents into training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cachelens.llm._ship import ship
from cachelens.llm.encoding import encoder, packed

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences of one partition are numbered from its number times this.
STRIDE = 1 << 32


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k sets of the items' positions with near-equal sums.

    A partial partition is the list of its non-empty sets, largest first, as (sum, items), items a nested pair. The two
    partitions of widest spread are merged: largest sets of one with smallest of the other.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)  # sets of a that are empty
        if len(b) <= free:
            both = a + b
        else:
            over = len(b) - free  # the smallest sets of b fill a's empty ones, its largest meet a's smallest
            meet = a[len(a) - over :]
            both = a[: len(a) - over] + b[over:] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(meet), b[:over])]
        both.sort(key=itemgetter(0), reverse=True)
        heapq.heappush(heap, ((both[-1][0] if len(both) == k else 0) - both[0][0], i, both))
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def fitted(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within capacity: as few as the total needs, one more each time a window exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        found = difference(sizes, k)
        worst = max(sum(sizes[i] for i in w) for w in found)
        if worst <= capacity:
            return found
        k += 1
    return []


def _packed(batches: Iterator[pd.DataFrame], tokenizer: str, end: int, length: int, most: int, group: int, remember: int) -> Iterator[pd.DataFrame]:
    encode, tail = encoder(tokenizer, spaces=False, limit=remember).encode, packed([end])
    sequence = TaskContext.get().partitionId() * STRIDE
    rows: list[tuple] = []
    rest: list[tuple] = []
    held = 0

    def settle() -> None:
        nonlocal sequence, held
        for window in fitted([r[2] for r in rest], length):
            at = 0
            for i in window:
                doc, start, n, ids, total = rest[i]
                rows.append((doc, start, n, ids, total, sequence, at))
                at += n
            sequence += 1
        rest.clear()
        held = 0

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        rows.clear()
        return out.astype({"doc_id": "Int64"})

    for batch in batches:
        docs = batch["doc_id"].tolist()
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        for doc, ids in zip(docs, encode(texts), strict=True):
            ids += tail
            doc, total, at = None if pd.isna(doc) else int(doc), len(ids) // 4, 0
            while total - at >= length:  # a full sequence of its own
                rows.append((doc, at, length, ids[4 * at : 4 * (at + length)], total, sequence, 0))
                sequence, at = sequence + 1, at + length
            left = total - at
            cuts = np.linspace(at, total, -(-left // most) + 1).astype(int).tolist() if left else []
            for a, b in zip(cuts, cuts[1:]):
                rest.append((doc, a, b - a, ids[4 * a : 4 * b], total))
            held += left
            if held >= group * length:
                settle()
            if len(rows) >= 2000:
                yield frame()
    settle()
    yield frame()


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 4096, piece: int = 1024, group: int = 512, remember: int = 1_200_000) -> DataFrame:
    """Every token of every document in exactly one piece, pieces laid gapless into sequences of at most `length` tokens.

    docs: doc_id long, text string; other columns are ignored. A document is its ids and `end`. Stretches of `length`
    tokens are sequences of their own; what remains is cut into pieces of at most `piece` tokens, and the remainders of
    about `group` sequences at a time are spread over windows by differencing. No shuffle: groups are made within the
    partitions of the input, so a lost task is redone alone, and its last group wastes less than a sequence.

    remember: pieces of text whose ids a Python worker keeps, about 200 bytes each; results don't depend on it.

    A null or empty text is one piece that holds `end`; repeated rows and equal ids are packed each; an empty table gives
    no rows; a null doc_id stays null. Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset. Padding is not stored: a sequence reaches from 0 to its last piece's end.
    """
    ship(docs.sparkSession)
    work = partial(_packed, tokenizer=tokenizer, end=end, length=length, most=piece, group=group, remember=remember)
    return docs.select("doc_id", "text").mapInPandas(work, PIECES)
