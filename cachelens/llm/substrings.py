"""Removal of long word sequences that an earlier document has, by fixed-block anchors.

A repeat of W words holds a whole block of B = W // 2 words wherever blocks of B are laid without overlap. Blocks of all
documents are the index; every window of B words probes it; a hit is a block that two documents have. Hits are extended to
the windows of W words around them, which are compared by 96 bits of two independent fingerprints: maximal exact repeats
are runs of windows that an earlier document has.

Documents are dealt into chunks by hash. Fingerprints travel between chunks and slices of the fingerprint space in
packed arrays, four bytes a probe; texts are shuffled once, and each of the three passes reads that shuffle. A chunk tells
which of its probes several of its own documents have, and a slice which chunks hold a fingerprint, so all repeats, within
a chunk or across, are found in the same way, no pairs of documents are ever formed, and a passage that all documents have
costs one entry a chunk.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm._ship import ship
from cachelens.llm._store import prefix
from cachelens.llm._text import U, utf8, windows, word_prints

PROBES = "slice long, chunk long, index binary, probes binary, several binary"
REPLY = "chunk long, slice long, hits binary"
WIDE = "slice long, chunk long, prints binary"
EARLIER = "chunk long, prints binary"
#: A window of a chunk: its two fingerprints, and the smallest and largest id of the chunk's documents that have it.
WINDOW = np.dtype([("w", "<u8"), ("v", "<u4"), ("low", "<i8"), ("high", "<i8")])
#: A window that several documents have, and the smallest of their ids.
LEAST = np.dtype([("w", "<u8"), ("v", "<u4"), ("low", "<i8")])
DONE = "doc_id long, text_hash long, n_words long, n_removed long, text string"
NO_ID = np.iinfo(np.int64).min


def layout(n_words: int) -> tuple[int, int]:
    """Chunks and bits of the slice number: as many slices as chunks, so that neither side's pieces get small."""
    each = max(1 << 18, int((50 * n_words) ** 0.5))
    return max(1, -(-n_words // each)), max(1, int(n_words // each)).bit_length()


def _docs(chunk: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    texts = utf8(chunk["text"])
    prints, bounds = word_prints(texts)
    ids = np.array([NO_ID if pd.isna(d) else int(d) for d in chunk["doc_id"].tolist()], np.int64)
    return texts, prints, bounds, ids


def _owner(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each position is in."""
    return np.searchsorted(bounds, at, side="right") - 1


def _second(texts: list[bytes], bounds: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Independent fingerprints of the windows at these positions, from the texts that hold them."""
    owner = _owner(bounds, at)
    some, place = np.unique(owner, return_inverse=True)
    prints, inner = word_prints([texts[i] for i in some.tolist()], other=True)
    return (windows(prints, inner, width, other=True)[0][inner[place] + at - bounds[owner]] >> U(32)).astype("<u4")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sliced(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice numbers that occur, and where each begins among the sorted prints."""
    numbers = prints >> U(64 - bits)
    cut = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(prints) else np.zeros(0, np.int64)
    return numbers[cut].astype(np.int64), np.append(cut, len(prints))


def _low(prints: np.ndarray, bits: int) -> np.ndarray:
    return (prints << U(bits) >> U(32)).astype("<u4")


def _emit(chunk: pd.DataFrame, width: int, bits: int) -> pd.DataFrame:
    _, prints, bounds, ids = _docs(chunk)
    h, fits = windows(prints, bounds, width // 2)
    at = np.flatnonzero(fits)
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))[at]
    aligned = (at - bounds[:-1][owner]) % (width // 2) == 0
    index = np.unique(h[at[aligned]])
    order = np.argsort(h[at], kind="stable")
    all_probes, of = h[at][order], ids[owner[order]]
    first = _runs(all_probes)
    probes = all_probes[first]
    several = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first) if len(first) else np.zeros(0, bool)
    slices, cut = _sliced(probes, bits)
    edges = np.searchsorted(index, np.append(probes[cut[:-1]] >> U(64 - bits) << U(64 - bits), U(2**64 - 1))) if len(slices) else [0]
    low, low_index = _low(probes, bits), _low(index, bits)
    return pd.DataFrame(
        {
            "slice": slices,
            "chunk": chunk["_chunk"].iloc[0],
            "index": [low_index[a:b].tobytes() for a, b in zip(edges, edges[1:])],
            "probes": [low[a:b].tobytes() for a, b in zip(cut, cut[1:])],
            "several": [np.packbits(several[a:b]).tobytes() for a, b in zip(cut, cut[1:])],
        }
    )


def _probe(part: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: for each chunk, its probes that the index has and that two documents hold, of one chunk or of two."""
    index = np.unique(np.frombuffer(b"".join(part["index"]), "<u4"))
    often = np.zeros(len(index), np.int64)
    chunks, hits = part["chunk"].tolist(), []
    for raw, several in zip(part["probes"], part["several"], strict=True):
        p = np.frombuffer(raw, "<u4")
        at = np.minimum(np.searchsorted(index, p), max(0, len(index) - 1))
        there = index[at] == p if len(index) else np.zeros(len(p), bool)
        hits.append(at[there])
        np.add.at(often, at[there], 1 + np.unpackbits(np.frombuffer(several, np.uint8), count=len(p))[there])
    rows = [(c, index[np.unique(y)].tobytes()) for c, x in zip(chunks, hits, strict=True) if len(y := x[often[x] > 1])]
    return pd.DataFrame({"chunk": [c for c, _ in rows], "slice": part["slice"].iloc[0], "hits": [b for _, b in rows]}).astype({"chunk": "int64", "slice": "int64"})


def _keys(replies: pd.DataFrame, bits: int) -> np.ndarray:
    """Slice number and 32 more bits of all hits of a chunk, sorted."""
    got = [(U(s) << U(32)) | np.frombuffer(b, "<u4").astype(np.uint64) for s, b in zip(replies["slice"], replies["hits"], strict=True)]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _within(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _extend(chunk: pd.DataFrame, replies: pd.DataFrame, width: int, bits: int) -> pd.DataFrame:
    """Windows of `width` words around the hits, each once, with the smallest and largest id of the chunk's documents that have it."""
    if chunk.empty:
        return pd.DataFrame({"slice": [], "chunk": [], "prints": []})
    texts, prints, bounds, ids = _docs(chunk)
    half = width // 2
    h, fits = windows(prints, bounds, half)
    hit = fits & _within((h >> U(64 - bits) << U(32)) | _low(h, bits).astype(np.uint64), _keys(replies, bits))
    near = np.zeros(len(h) + 1, np.int64)  # starts of windows that hold a hit
    at = np.flatnonzero(hit)
    np.add.at(near, np.maximum(at - (width - half), 0), 1)
    np.add.at(near, at + 1, -1)
    wide, whole = windows(prints, bounds, width)
    at = np.flatnonzero(whole & (np.cumsum(near[:-1]) > 0))
    w, v, d = wide[at], _second(texts, bounds, at, width), ids[_owner(bounds, at)]
    order = np.lexsort((v, w))
    w, v, d = w[order], v[order], d[order]
    first = _runs(w, v)
    found = np.empty(len(first), WINDOW)
    found["w"], found["v"] = w[first], v[first]
    if len(first):
        found["low"], found["high"] = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
    slices, cut = _sliced(found["w"], bits)
    return pd.DataFrame({"slice": slices, "chunk": chunk["_chunk"].iloc[0], "prints": [_packed(found[a:b]) for a, b in zip(cut, cut[1:])]})


def _packed(found: np.ndarray) -> bytes:
    """Windows column by column; the largest id only where it is not the smallest."""
    more = np.flatnonzero(found["low"] != found["high"]).astype("<u4")
    parts = (found["w"], found["v"], found["low"], more, found["high"][more])
    return np.array([len(found), len(more)], "<u4").tobytes() + b"".join(x.tobytes() for x in parts)


def _windows(raw: bytes) -> np.ndarray:
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    found, at = np.empty(n, WINDOW), 8
    for name, kind in (("w", "<u8"), ("v", "<u4"), ("low", "<i8")):
        found[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    found["high"] = found["low"]
    found["high"][np.frombuffer(raw, "<u4", m, at)] = np.frombuffer(raw, "<i8", m, at + 4 * m)
    return found


def _earliest(part: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: for each chunk, those of its windows that a document of smaller id has than one of its own, with the smallest id."""
    each = [_windows(b) for b in part["prints"]]
    every = np.concatenate(each)
    order = np.lexsort((every["v"], every["w"]))
    every = every[order]
    first = _runs(every["w"], every["v"])
    low = np.repeat(np.minimum.reduceat(every["low"], first), np.diff(np.append(first, len(every))))
    least = np.empty(len(every), np.int64)
    least[order] = low
    chunks, prints, at = [], [], 0
    for chunk, x in zip(part["chunk"], each, strict=True):
        mine = least[at : at + len(x)]
        at += len(x)
        if len(late := np.flatnonzero(mine < x["high"])):
            out = np.empty(len(late), LEAST)
            out["w"], out["v"], out["low"] = x["w"][late], x["v"][late], mine[late]
            chunks.append(chunk)
            prints.append(out.tobytes())
    return pd.DataFrame({"chunk": chunks, "prints": prints}).astype({"chunk": "int64"})


def _kept(chunk: pd.DataFrame, replies: pd.DataFrame, width: int) -> pd.DataFrame:
    """The chunk's documents without the words of windows that an earlier document has."""
    if chunk.empty:
        return pd.DataFrame({"doc_id": [], "text_hash": [], "n_words": [], "n_removed": [], "text": []})
    texts, prints, bounds, ids = _docs(chunk)
    known = np.concatenate([np.frombuffer(b, LEAST) for b in replies["prints"]]) if len(replies) else np.zeros(0, LEAST)
    known = known[np.lexsort((known["v"], known["w"]))]
    cover = np.zeros(len(prints) + 1, np.int64)
    if len(known):
        wide, whole = windows(prints, bounds, width)
        keys = known["w"]
        at = np.flatnonzero(whole & _within(wide, keys))
        v, d, place = _second(texts, bounds, at, width), ids[_owner(bounds, at)], np.searchsorted(keys, wide[at])
        gone = np.zeros(len(at), bool)
        todo = np.arange(len(at))
        while len(todo):  # windows of one first fingerprint follow each other
            same = known["v"][place[todo]] == v[todo]
            gone[todo[same]] = known["low"][place[todo[same]]] < d[todo[same]]
            todo = todo[~same]
            place[todo] += 1
            todo = todo[place[todo] < len(keys)]
            todo = todo[keys[place[todo]] == wide[at[todo]]]
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + width, -1)
    lost = np.cumsum(cover[:-1]) > 0
    removed = np.concatenate(([0], np.cumsum(lost)))
    out = []
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        words = text.split()
        if removed[b] > removed[a]:
            words = [x for x, g in zip(words, lost[a:b].tolist(), strict=True) if not g]
        out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    done = {"n_words": np.diff(bounds), "n_removed": removed[bounds[1:]] - removed[bounds[:-1]], "text": out}
    return pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in chunk["doc_id"].tolist()], "Int64"), "text_hash": chunk["text_hash"].to_numpy(), **done})


def _done(docs: DataFrame, width: int) -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_words, n_removed, text (what is left)."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks, bits = layout(size // 6)
    hashed = F.xxhash64("text").alias("text_hash")
    rows = docs.select("doc_id", "text", hashed, F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(chunks)).alias("_chunk"))
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "_chunk")
    half = partial(_emit, width=width, bits=bits)
    hits = rows.groupBy("_chunk").applyInPandas(half, PROBES).groupBy("slice").applyInPandas(_probe, REPLY)
    wide = rows.groupBy("_chunk").cogroup(hits.groupBy("chunk")).applyInPandas(partial(_extend, width=width, bits=bits), WIDE)
    earlier = wide.groupBy("slice").applyInPandas(_earliest, EARLIER)
    return rows.groupBy("_chunk").cogroup(earlier.groupBy("chunk")).applyInPandas(partial(_kept, width=width), DONE)


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Documents without the words that lie in a window of `width` words which also starts in a document of smaller id.

    docs: doc_id long, text string; other columns are ignored. Words are runs of characters other than 0x20 and
    0x09-0x0D, unchanged; windows lie within one document and are judged on the input. Returns a row for each row of
    docs: doc_id, n_words, n_removed, text (kept words joined by one space).

    Null and empty texts have no words; a document shorter than `width` loses none; repeats within one document stay;
    repeated rows (the same id) don't remove each other; a null id counts as smaller than all others; an empty table
    gives no rows.
    """
    return _done(docs, width).drop("text_hash")


def cleaned(docs: DataFrame, width: int = 50) -> DataFrame:
    """The rows and columns of docs, with the text that without_repeats() leaves where it removes words; other texts stay as they are.

    Rows with one id and different texts are cleaned each by its own text. Null texts stay null; a text of which nothing
    is left is empty; an empty table gives no rows.
    """
    names, own = docs.columns, prefix(docs)
    changed = _done(docs, width).where("n_removed > 0").select(F.struct("doc_id", "text_hash").alias(f"{own}key"), F.col("text").alias(f"{own}left"))
    changed = changed.dropDuplicates([f"{own}key"])
    joined = docs.join(changed, F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash")).eqNullSafe(F.col(f"{own}key")), "left")
    return joined.select(*[F.coalesce(f"{own}left", "text").alias(c) if c == "text" else c for c in names])
