"""Exact top-k search by BM25: an inverted index per shard, pruned by block maxima, merged under global statistics."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.llm._ship import ship
from cachelens.llm._store import dropped, written
from cachelens.llm._text import parts_of, utf8, word_prints

FOUND = "query_id long, doc_id long, score double"
SHARD_WORDS = 8 << 20
#: Queries and their terms in a pack, queries that are multiplied at once, and tasks that the results of a block of queries come from, at most.
PACK, PACK_TERMS, GROUP, MERGED = 256, 1 << 17, 32, 128


def term_counts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Terms of each text with their counts, and its number of words. A term is a word with A-Z in lower case."""
    for cut in parts_of(texts, 1 << 20):
        prints, bounds = word_prints(texts[cut], lower=True)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            terms, counts = np.unique(prints[a:b], return_counts=True)
            yield terms.view(np.int64), counts, b - a


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        every = [t for t, _, _ in term_counts(utf8(batch["text"]))]
        terms, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pd.DataFrame({"term": terms, "df": n})


def _queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            got = list(term_counts(utf8(part["text"])))
            yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "term": [t for t, _, _ in got], "count": [c for _, c, _ in got]})


class Shard:
    """Inverted index of some documents: lists of postings by term, cut into blocks of documents, each with its largest impact.

    Documents are laid out by their most frequent term and length, so that a block holds alike ones and its bound is tight.
    Lists of common terms are dense columns as well, which are multiplied for many queries at once.
    """

    def __init__(self, rows: list[tuple], average: float, k1: float, b: float, block: int = 128, common: float = 0.08):
        """rows: (id, terms, counts, words) of each document, emptied as they are taken."""
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][1][np.argmax(rows[i][2])]) if len(rows[i][1]) else 0, rows[i][3], i))
        rows[:] = [rows[i] for i in order]
        n = len(rows)
        self.ids, words = [r[0] for r in rows], np.array([r[3] for r in rows], np.int64)
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        terms = np.concatenate([r[1] for r in rows]) if n else np.zeros(0, np.int64)
        impact = np.concatenate([r[2] for r in rows]).astype(float) if n else np.zeros(0)
        rows.clear()  # arrays with an element for each posting fill the memory; each goes as soon as it can
        impact = impact * (k1 + 1) / (impact + np.repeat(k1 * (1 - b + b * words / max(average, 1e-9)), sizes))
        docs = np.repeat(np.arange(n, dtype=np.int32), sizes)
        by_term = np.argsort(terms, kind="stable")
        terms = terms[by_term]
        docs, self.impact = docs[by_term], impact[by_term]
        del impact, by_term
        self.terms, start = np.unique(terms, return_index=True)
        del terms
        start = np.append(start, len(docs))
        self.block, self.blocks = block, -(-n // block)
        # runs: the postings of one term in one block; a run is skipped whole or read whole
        of_block = docs // block
        new = np.ones(len(of_block), bool)
        new[1:] = of_block[1:] != of_block[:-1]
        new[start[:-1]] = True
        cut = np.flatnonzero(new)
        narrow = np.uint16 if self.blocks < 1 << 16 else np.int32  # 16 bits sort in linear time
        self.run_block, self.run_start = of_block[cut].astype(narrow), np.append(cut, len(docs))
        self.run_most = np.maximum.reduceat(self.impact, cut) if len(cut) else np.zeros(0)
        self.runs_of = np.searchsorted(cut, start)
        del of_block, new, cut
        often = np.flatnonzero(np.diff(start) > common * n)
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks * block, len(often)))
        for c, t in enumerate(often):
            part = slice(start[t], start[t + 1])
            self.dense[docs[part], c] = self.impact[part]
        self.docs = docs.astype(np.min_scalar_type(n))
        self.dense_most = self.dense.reshape(self.blocks, block, len(often)).max(1) if self.blocks else np.zeros((0, len(often)))
        self.postings_read = self.postings_met = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, together: int = 8, least: float = 0.0) -> list[tuple[float, object]]:
        """The k best (score, id) of the documents with a query term, by block-max WAND; more where scores tie. Those that
        score under `least`, the k-th best score elsewhere, may be missing."""
        return next(self.search_all(terms, [(np.arange(len(terms)), weights, least)], k, together))

    def search_all(self, terms: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int, together: int = 8) -> Iterator[list[tuple[float, object]]]:
        """search() for queries given as (indexes of their terms, weights, least).

        The dense columns are multiplied for GROUP queries at once, passed over or not: a product of matrices takes less than
        the products with vectors that skipping would save. Sparse lists are read for each query by itself.
        """
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        place = np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)
        column = np.where(place >= 0, self.column[at], -1) if len(self.terms) else place
        for x in range(0, len(queries), GROUP):
            group = queries[x : x + GROUP]
            wc = np.zeros((len(group), self.dense.shape[1]))
            for i, (mine, weights, _) in enumerate(group):
                c = column[mine]
                wc[i, c[c >= 0]] = weights[c >= 0]
            dense, most = wc @ self.dense.T, wc @ self.dense_most.T
            for i, (mine, weights, least) in enumerate(group):
                sparse = (place[mine] >= 0) & (column[mine] < 0)
                yield self._best(place[mine][sparse], weights[sparse], dense[i], most[i], k, together, least)

    def _best(self, lists: np.ndarray, w: np.ndarray, dense: np.ndarray, most: np.ndarray, k: int, together: int, least: float) -> list[tuple[float, object]]:
        """A block's bound is the sum of its lists' weighted maxima, from the index alone. Blocks are taken by their bounds, a few
        `together`; the pivot is the next one whose bound reaches the k-th best score. The lists move to it by their runs, so no
        posting of a block that is passed over is read, and the search ends where no bound reaches."""
        runs, size = _spans(self.runs_of[lists], self.runs_of[lists + 1])
        in_block, weight = self.run_block[runs], np.repeat(w, size)
        bound = most + np.bincount(in_block, self.run_most[runs] * weight, self.blocks)
        order = np.argsort(-bound, kind="stable")
        scores, rows, at = np.zeros(0), np.zeros(0, np.int64), 0
        while at < self.blocks:
            pivots = order[at : at + together]
            pivots = pivots[(bound[pivots] >= least - 1e-9) & (bound[pivots] > 0)]
            if not len(pivots):
                break
            at += together
            together *= 2
            chosen = np.zeros(self.blocks, bool)
            chosen[pivots] = True
            mine = np.flatnonzero(chosen[in_block])  # in the order of terms, so that lists are read from front to back
            run = runs[mine]
            entry, size = _spans(self.run_start[run], self.run_start[run + 1])
            self.postings_read += len(entry)
            rare = np.bincount(self.docs[entry], self.impact[entry] * np.repeat(weight[mine], size), len(dense))
            row = (pivots[:, None] * self.block + np.arange(self.block)).ravel()
            score = dense[row] + rare[row]
            new = (score > 0) & (score >= least - 1e-9)
            scores, rows = np.concatenate((scores, np.round(score[new], 9))), np.concatenate((rows, row[new]))
            if len(scores) >= k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                rows, scores = rows[scores >= least], scores[scores >= least]
        self.postings_met += int((self.run_start[runs + 1] - self.run_start[runs]).sum())
        return [(s, self.ids[r]) for s, r in zip(scores.tolist(), rows.tolist(), strict=True)]


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges starts[i] to ends[i], and how many each range has."""
    size = ends - starts
    return np.arange(int(size.sum())) + np.repeat(starts - np.cumsum(size) + size, size), size


def _packed(batches: Iterator[pd.DataFrame], together: int) -> Iterator[pd.DataFrame]:
    """Queries in rows of `together`, or fewer where they are long."""
    held: list[tuple] = []

    def full() -> pd.DataFrame:
        ids, terms, weights = zip(*held, strict=True)
        held.clear()
        sizes = np.array([len(t) for t in terms], np.int64)
        out = io.BytesIO()
        every, which = np.unique(np.concatenate(terms), return_inverse=True)
        np.savez(out, ids=np.array(ids, np.int64), sizes=sizes, terms=every, which=which.astype(np.int32), weights=np.concatenate(weights))
        return pd.DataFrame({"asks": [out.getvalue()]})

    size = 0
    for batch in batches:
        for q, terms, weights in zip(batch["query_id"].tolist(), batch["terms"], batch["weights"], strict=True):
            if held and (len(held) >= together or size + len(terms) > PACK_TERMS):
                yield full()
                size = 0
            held.append((int(q), np.asarray(terms, np.int64), np.asarray(weights, float)))
            size += len(terms)
    if held:
        yield full()


def _searched(batches: Iterator[pd.DataFrame], average: float, k: int, k1: float, b: float) -> Iterator[pd.DataFrame]:
    """Rows are the documents of a shard, then packs of queries, and so on for each shard of the task: an index is built once for
    all packs. A query's best go on from shard to shard, so that later ones are pruned by the score it takes to be among them."""
    at, rows, shard, best = None, [], None, {}
    for batch in batches:
        edges = [0, *(np.flatnonzero(np.diff(batch["shard"].to_numpy())) + 1).tolist(), len(batch)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            part = batch.iloc[x:y]
            if not len(part):
                continue
            if part["shard"].iloc[0] != at:
                at, rows, shard = part["shard"].iloc[0], [], None
            texts = part[~part["last"]]
            if len(texts):
                ids = [None if pd.isna(d) else int(d) for d in texts["doc_id"].tolist()]
                rows += [(d, t, c.astype(np.int32), n) for d, (t, c, n) in zip(ids, term_counts(utf8(texts["text"])), strict=True)]
            for pack in part["asks"][part["last"]]:
                if shard is None:
                    shard = Shard(rows, average, k1, b)
                with np.load(io.BytesIO(pack), allow_pickle=False) as z:
                    queries, sizes, terms, which, weights = (z[c] for c in ("ids", "sizes", "terms", "which", "weights"))
                queries, ends = queries.tolist(), np.cumsum(sizes).tolist()
                leasts = [had[-1][0] if len(had := best.get(q, [])) == k else 0.0 for q in queries]
                asks = [(which[end - size : end], weights[end - size : end], least) for end, size, least in zip(ends, sizes.tolist(), leasts, strict=True)]
                for q, new in zip(queries, shard.search_all(terms, asks, k), strict=True):
                    if new:
                        best[q] = sorted([*best.get(q, []), *new], key=lambda v: (-v[0], v[1] is None, v[1]))[:k]
    shard, found = None, iter(best.items())
    while some := list(islice(found, 8192)):
        out = [(q, d, s) for q, mine in some for s, d in mine]
        yield pd.DataFrame({"query_id": pd.array([r[0] for r in out], "Int64"), "doc_id": pd.array([r[1] for r in out], "Int64"), "score": [float(r[2]) for r in out]})


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shard_docs: int = 16384, query_block: int = 1 << 14) -> DataFrame:
    """The k documents of highest BM25 score for each query, exactly.

    docs: doc_id long, text string. queries: query_id long (unique), text string, used whole. Other columns are ignored.
    Document frequencies and average length are those of all docs. Documents are dealt by hash into shards of about `shard_docs`
    documents, or fewer where they are long, in one shuffle. Queries are written to the shared folder once, in files of
    `query_block` at most, and are never shuffled to shards: a task is a pair of a shard (of several beyond MERGED) and a
    partition of these files. It indexes the shard, lets the queries pass by it in packs, answers them by block-max WAND and
    keeps the best; the tasks' best are merged. So disk grows with documents and queries, not with their product; what tasks
    read grows with the product, and a shard is read and indexed again for each further partition of queries.

    Returns query_id, rank (1 to k), doc_id, score (9 decimals); ties go to the smaller doc_id. Documents without a query
    term are no results, so queries without words, and all queries of an empty table, have none. Null texts are empty;
    repeated rows are results each; a null doc_id sorts last among ties; queries with a null id are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text")
    frequency = rows.mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).alias("w")).first()
    n, average = total["n"], (total["w"] or 0) / max(1, total["n"])
    asked = queries.where("query_id is not null").select("query_id", "text").mapInPandas(_queries, "query_id long, term array<long>, count array<long>")
    exploded = asked.select("query_id", F.explode(F.arrays_zip("term", "count")).alias("x")).select("query_id", "x.term", "x.count")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = exploded.join(frequency, "term").select("query_id", F.struct("term", (idf * F.col("count")).alias("w")).alias("x"))
    grouped = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # bounded by one query's terms
    grouped = written(grouped.select("query_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), "bm25-queries")
    blocks, together = max(1, -(-grouped.count() // query_block)), min(PACK, query_block)
    packs = written(grouped.coalesce(blocks).mapInPandas(partial(_packed, together=together), "asks binary"), "bm25-packs", query_block // together)
    dropped(grouped)
    # about SHARD_WORDS words at most, so that long texts make more shards, not larger ones
    shards = max(1, -(-n // shard_docs), -(-(total["w"] or 0) // SHARD_WORDS))
    shard_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    ends = spark.range(shards).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("id").cast("int").alias("shard"), F.lit(True).alias("last"))
    dealt = rows.select("doc_id", "text", shard_of.alias("shard"), F.lit(False).alias("last")).unionByName(ends).repartitionById(shards, F.col("shard")).sortWithinPartitions("last")
    # the optimizer drops sorts below joins unless something between depends on the partition
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard"), "last").coalesce(MERGED)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # in each partition of packs a null comes first, which documents meet; the end of a shard meets the packs
    null_first = F.explode(F.when(place == 0, F.array(F.lit(None).cast("binary"), "asks")).otherwise(F.array("asks")))
    passing = packs.select(null_first.alias("asks")).select("asks", F.col("asks").isNotNull().alias("pack")).hint("shuffle_replicate_nl")
    meet = (F.col("last") & F.col("pack")) | (~F.col("last") & ~F.col("pack"))  # of flags alone: a test of `asks` would copy it for each document
    got = dealt.join(passing, meet).drop("pack").mapInPandas(partial(_searched, average=average, k=k, k1=k1, b=b), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return got.select("query_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
