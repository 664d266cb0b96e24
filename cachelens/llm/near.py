"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm._ship import ship
from cachelens.llm._store import dropped, fresh, written
from cachelens.llm._text import U, mix, utf8, windows, word_prints

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(77))
_MUL = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
SKETCH = "row long, doc_id long, text_hash long, n_shingles long, class binary, sig binary, bands array<long>"
PAIR = "a long, b long"
RIVALS = "band long, i int, j int, id long, comp long, asks boolean, partners array<long>"


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of k-word shingles of each text; the whole sequence where there are fewer words."""
    prints, bounds = word_prints(texts, lower=True)
    h, _ = windows(prints, bounds, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in prints[a:b]:
                whole = mix(whole * U(0x9E3779B97F4A7C15) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, a row for each set; sets must not be empty."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    x = np.concatenate(sets)
    x = (x >> U(32)).astype(np.uint32) ^ x.astype(np.uint32)
    out = np.empty((HASHES, len(sets)), np.uint32)
    for i in range(HASHES):
        y = x ^ _ADD[i]
        y *= _MUL[i]
        y ^= y >> np.uint32(15)
        y *= _MUL[i - 1]
        out[i] = np.minimum.reduceat(y, starts)
    return np.ascontiguousarray(out.T)


def _sketched(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    number = np.arange(BANDS, dtype=np.uint64) * U(0xA24BAED4963EE407)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            sets = shingles(utf8(part["text"]), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), HASHES), np.uint32)
            if full:
                sig[full] = signatures([sets[i] for i in full])
            bands = np.empty((len(sets), BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(sets), number[b])
                for c in range(b * ROWS, (b + 1) * ROWS):
                    h = mix(h * U(0x9FB21C651E98DF25) + sig[:, c])
                bands[:, b] = h
            signed = bands.view(np.int64)
            yield pd.DataFrame(
                {
                    "row": part["row"].to_numpy(),
                    "doc_id": part["doc_id"].to_numpy(),
                    "text_hash": part["text_hash"].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [sig[i].tobytes() if len(s) else None for i, s in enumerate(sets)],
                    "bands": [signed[i] if len(s) else None for i, s in enumerate(sets)],
                }
            )


@lru_cache
def least_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """For each batch end: fewest matches for which the posterior chance of `similarity` or more, from a uniform prior, is `miss` or more.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), and its mass above t is the chance of m
    or fewer successes of n+1 with probability t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _rows(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)


def _plausible(batches: Iterator[pd.DataFrame], similarity: float, miss: float) -> Iterator[pd.DataFrame]:
    """The pairs that no batch of their signatures rules out."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.iloc[at : at + 4096]
            a, b = _rows(part["sig_a"]), _rows(part["sig_b"])
            alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
            for i, least in enumerate(least_matches(similarity, miss)):
                cols = slice(i * BATCH, (i + 1) * BATCH)
                hits[alive] += (a[alive, cols] == b[alive, cols]).sum(1)
                alive = alive[hits[alive] >= least]
            yield part[["a", "b"]].iloc[alive]


def _exact(batches: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """The pairs whose full sets are alike."""
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.iloc[at : at + 128]
            left, right = shingles(utf8(part["text_a"]), k), shingles(utf8(part["text_b"]), k)
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part[["a", "b"]][keep]


def _rivals(bucket: pd.DataFrame, similarity: float, miss: float) -> pd.DataFrame:
    """Of a block of a bucket's documents and one of asking ones: those that signatures do not keep apart, asking ones with their
    partners. A pair that shares several bands is given in the first one alone."""
    ids, comp, asks = bucket["id"].to_numpy(), bucket["comp"].to_numpy(), bucket["asks"].to_numpy()
    answers, number = np.flatnonzero(~asks), int(bucket["number"].iloc[0])
    columns = _rows(bucket["sig"]).T
    pool, pool_comp = np.ascontiguousarray(columns[:, answers]), comp[answers]
    least = least_matches(similarity, miss)
    found, named = [], np.zeros(len(answers), bool)
    for i in np.flatnonzero(asks).tolist() if len(answers) else []:
        mine = columns[:, i : i + 1]
        hits = (pool[:BATCH] == mine[:BATCH]).sum(0, dtype=np.uint8).astype(np.int64)
        alive = np.flatnonzero((hits >= least[0]) & (pool_comp != comp[i]))
        hits = hits[alive]
        for at, enough in zip(range(BATCH, HASHES, BATCH), least[1:], strict=True):
            if not len(alive):
                break
            hits = hits + (pool[at : at + BATCH, alive] == mine[at : at + BATCH]).sum(0)
            stay = hits >= enough
            alive, hits = alive[stay], hits[stay]
        if len(alive):
            shared = (pool[:, alive] == mine).reshape(BANDS, ROWS, -1).all(1)
            alive = alive[shared.argmax(0) == number]
        if len(alive):
            named[alive] = True
            found.append((ids[i], comp[i], True, ids[answers[alive]]))
    found += [(ids[x], comp[x], False, None) for x in answers[named].tolist()]
    out = pd.DataFrame(found, columns=["id", "comp", "asks", "partners"])
    return out.assign(**{c: bucket[c].iloc[0] for c in ("band", "i", "j")})[["band", "i", "j", "id", "comp", "asks", "partners"]]


def _settled(part: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Exact check of asking documents against their partners: components that a pair links."""
    sets = shingles(utf8(part["text"]), k)
    asks, comp, ids = part["asks"].to_numpy(), part["comp"].to_numpy(), part["id"].to_numpy()
    at = {d: i for i, d in enumerate(ids.tolist()) if not asks[i]}
    out = set()
    for i in np.flatnonzero(asks).tolist():
        mine = sets[i]
        others = [j for p in part["partners"].iloc[i] if (comp[i], comp[j := at[p]]) not in out]
        if others:
            sizes = np.array([len(sets[j]) for j in others])
            every, owner = np.concatenate([sets[j] for j in others]), np.repeat(np.arange(len(others)), sizes)
            place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            both = np.bincount(owner[mine[place] == every], minlength=len(others))
            for x in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)).tolist():
                out.add((comp[i], comp[others[x]]))
    return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that links reach from a smaller one, and the smallest that each reaches by these links."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    linked = np.flatnonzero(low != np.arange(len(ids)))
    return ids[linked], ids[low[linked]]


def _forests(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Links of a task, contracted whenever there are more than `chunk` of them."""
    u = v = np.zeros(0, np.int64)
    for batch in batches:
        u, v = np.concatenate((u, batch["a"].to_numpy())), np.concatenate((v, batch["b"].to_numpy()))
        if len(u) > chunk:
            u, v = forest(u, v)
            if 2 * len(u) > chunk:
                yield pd.DataFrame({"a": u, "b": v})
                u = v = np.zeros(0, np.int64)
    if len(u):
        u, v = forest(u, v)
        yield pd.DataFrame({"a": u, "b": v})


def components(links: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Smallest id that each end of a link (a, b) reaches: id, comp. Ids that reach none smaller have no row.

    Each round contracts links within tasks of about `chunk` links to stars, without a shuffle, and so at least the links
    of one document in a task to one; what is left in several tasks takes a large-star and a small-star step, in which
    links alone travel, aggregated before each shuffle. Links that fit in one task are done by contraction alone.
    """
    edges, stars = links.select("a", "b").where("a <> b"), None
    while True:
        tasks = max(1, -(-edges.count() // chunk))
        edges = written(edges.coalesce(tasks).mapInPandas(partial(_forests, chunk=chunk), PAIR), "near-forest")
        if stars is not None:
            dropped(stars)
        if tasks == 1:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        ends = edges.select("a", F.lit(1).alias("low")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("low")))
        once = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if once.isEmpty() and ends.groupBy("a").agg(F.count_distinct("low").alias("n")).where("n > 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ways = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(ways).alias("e")).select("e.a", "e.b")
        stars = written(small.where("a <> b").distinct(), "near-stars")
        dropped(edges)
        edges = stars


def _relabelled(comps: DataFrame, links: DataFrame, chunk: int) -> DataFrame:
    """comps after more links between components. Those links are few against those within components, and only they are contracted."""
    new = components(links, chunk).select(F.col("id").alias("old"), F.col("comp").alias("new"))
    kept = comps.join(new, comps["comp"] == new["old"], "left").select("id", F.coalesce("new", "comp").alias("comp"))
    return written(kept.unionByName(new.select(F.col("old").alias("id"), F.col("new").alias("comp"))), "near-comps")


def grouped(docs: DataFrame, k: int, percent: int, miss: float, block: int, chunk: int) -> DataFrame:
    """Rows of docs with doc_id, text_hash, n_shingles, row (a number of its own), first_id and first_row: id and number of its
    component's first row by (doc_id, row), null where the row has no shingles or no id."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    sketches = written(rows.mapInPandas(partial(_sketched, k=k), SKETCH), "near-sketch")
    usable = sketches.where("class is not null and doc_id is not null")
    # documents with equal sets are one node, and equal in signature and bands; its number is that of its first row
    first = F.min(F.struct("doc_id", "row", "text_hash")).alias("f")
    reps = usable.groupBy("class").agg(first, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = written(reps.select(F.col("f.row").alias("id"), "class", F.col("f.doc_id").alias("doc_id"), F.col("f.text_hash").alias("text_hash"), "sig", "bands"), "near-reps")
    members = reps.select("id", F.posexplode("bands").alias("number", "band"))
    buckets = written(members.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "near-buckets")
    inside = written(members.join(buckets, "band"), "near-members")
    sig = reps.select("id", "sig")
    similarity = percent / 100

    # texts of the candidates, gathered once
    candidates = reps.select("id", "doc_id", "text_hash").join(inside.select("id").distinct(), "id", "left_semi")
    some = written(texts.join(candidates, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("id", "text"), "near-texts")

    # all against their bucket's first
    pairs = inside.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    one = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")  # hot leaders, while rows are short
    two = one.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = written(two.mapInPandas(partial(_plausible, similarity=similarity, miss=miss), PAIR), "near-pairs")
    one = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(two.mapInPandas(partial(_exact, k=k, percent=percent), PAIR), "near-links")
    comps = components(links, chunk)

    # the rest of each bucket across components: those outside the largest one ask, block by block
    named = inside.where("id <> lead").join(comps, "id", "left").select("band", "number", "id", F.coalesce("comp", "id").alias("comp"))
    counts = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"), F.max("n").alias("most")).where("c > 1")
    mixed = mixed.select("band", "largest", F.ceil(F.col("m") / block).cast("int").alias("mb"), F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("qb"))
    open_ = named.join(mixed, "band").join(sig, "id")
    mine = F.pmod(F.xxhash64("id"), F.col("mb")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("j"), F.lit(True).alias("asks")))
    places = F.when(F.col("comp") == F.col("largest"), places).otherwise(F.concat(places, asking))
    dealt = open_.select("band", "number", "id", "comp", "sig", F.explode(places).alias("p")).select("band", "number", "id", "comp", "sig", "p.i", "p.j", "p.asks")
    rivals = dealt.groupBy("band", "i", "j").applyInPandas(partial(_rivals, similarity=similarity, miss=miss), RIVALS)
    rivals = written(rivals, "near-rivals")
    more = rivals.join(some, "id").groupBy("band", "i", "j").applyInPandas(partial(_settled, k=k, percent=percent), PAIR)
    more = written(more, "near-links")
    comps = _relabelled(comps, more, chunk)
    dropped(buckets, inside, some, pairs, links, rivals, more)
    named = reps.select("id", "class", "doc_id").join(comps, "id", "left").select("class", F.coalesce("comp", "id").alias("comp"), F.struct("doc_id", F.col("id").alias("row")).alias("f"))
    firsts = named.groupBy("comp").agg(F.min("f").alias("first"))
    out = sketches.select("row", "doc_id", "text_hash", "n_shingles", "class").join(named.select("class", "comp").join(firsts, "comp").select(F.col("class").alias("c"), "first"), (F.col("class") == F.col("c")) & F.col("doc_id").isNotNull(), "left")
    return out.select("row", "doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-4, block: int = 256, chunk: int = 1 << 20) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their k-word shingle sets.

    docs: doc_id long, text string; other columns are ignored. A-Z are lower-cased; words are runs of characters other
    than 0x20 and 0x09-0x0D. Rows with equal sets are one node. Nodes that share a band (32 bands of 5 hashes: at
    similarity 0.8 all miss with a chance of 3 in a million) are candidates. First each is compared with the first of its
    bucket. Then, in buckets that still hold several components, every document outside the largest one is compared with
    all documents of other components there, in blocks of `block` by `block`; each pair is compared in the first band it
    shares. So pairs within a component need not be formed, a bucket of many alike texts costs its length, and no pair
    across components is given up.
    Signatures are compared in batches of 32 and a pair is dropped when the posterior chance that it reaches the
    similarity falls below `miss`; the others are verified on their full sets.

    Returns for each row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    Texts without words, and null texts, have no shingles, are linked with nothing and kept; with fewer than k words the
    whole sequence is the one shingle; repeated rows (same id) each get a row, and with different texts each has the
    links of its own text; a null id is kept and linked with nothing; an empty table gives no rows.
    """
    out = grouped(docs, k, percent, miss, block, chunk)
    component = F.coalesce("first_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def unique(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-4, block: int = 256, chunk: int = 1 << 20) -> DataFrame:
    """The rows of docs that stay when of each component of near_duplicates() only the first stays, by doc_id.

    All columns of docs stay as they are. Of rows with one id and text one stays, null ids and null texts included; of
    rows with one id and different texts each is judged by its own text, so none goes with another. Texts without words
    and rows without id are in no component and stay. An empty table gives no rows.
    """
    rows = grouped(docs, k, percent, miss, block, chunk)
    stay = rows.where("first_row is null or row = first_row").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    key = fresh(docs, "text_hash")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    stay = stay.select(F.struct("_d", "_t").alias("s"))
    kept = keyed.join(stay, F.struct(keyed["doc_id"], keyed[key]).eqNullSafe(F.col("s")), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
