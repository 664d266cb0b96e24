"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm._ship import ship
from cachelens.llm._store import fresh, prefix, written

WEIGHTS = (5, 2, 1)
N_WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies")
#: Sources whose rates, some hundred bytes each, are broadcast; more are joined.
BROADCAST = 50_000
UNIT = "source string, doc_id long, size long, times long, block long, p double"


def n_words(text) -> F.Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(N_WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Target of each source: `share` of all sizes by weight, no more than `most` times its own size, the excess reshared.

    Sources by code point, null last, take the weights in turn. Exact fractions: no order of summation matters.
    """
    ranked = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size = dict(ranked)
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * size[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = Fraction(most * size[s])
            left -= out[s]
        free -= over
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: probabilities move along null vectors of the constraints x (units by constraints) until at most
    as many as there are constraints stay fractional. Each step uses the first constraints + 1 fractional units."""
    p, eps = p.copy(), 1e-9
    c = x.shape[1]
    order = [int(i) for i in np.flatnonzero((p > eps) & (p < 1 - eps))]
    order.reverse()
    hold: list[int] = []
    draws = iter(rng.random(len(order) + 8))
    while True:
        while len(hold) <= c and order:
            hold.append(order.pop())
        if len(hold) <= c:
            return p
        if c == 2:  # the null vector of a 2 x 3 system is a cross product
            (a0, a1), (b0, b1), (d0, d1) = x[hold].tolist()
            u = [b0 * d1 - b1 * d0, d0 * a1 - d1 * a0, a0 * b1 - a1 * b0]
            if max(map(abs, u)) < 1e-12:
                u = [1.0, -1.0, 0.0]
        else:
            u = np.linalg.svd(x[hold].T)[2][-1].tolist()
        up = down = np.inf
        q = [float(p[i]) for i in hold]
        for v, w in zip(q, u, strict=True):
            if w > 1e-12:
                up, down = min(up, (1 - v) / w), min(down, v / w)
            elif w < -1e-12:
                up, down = min(up, v / -w), min(down, (1 - v) / -w)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        keep = []
        for i, v, w in zip(hold, q, u, strict=True):
            v += step * w
            v = 0.0 if v < eps else 1.0 if v > 1 - eps else v
            p[i] = v
            if 0 < v < 1:
                keep.append(i)
        if len(keep) == len(hold):  # rounding: settle the closest one
            i = min(keep, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = round(p[i])
            keep.remove(i)
        hold = keep


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Landing: of all ways to settle the few units left, the one whose totals are nearest to the expected ones."""
    p = p.copy()
    left = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(left):
        want, scale = p[left] @ x[left], np.maximum(np.abs(x[left]).sum(0), 1e-12)
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        p[left] = ways[np.argmin((((ways @ x[left] - want) / scale) ** 2 * ([1] + [4] * (x.shape[1] - 1))).sum(1))]
    return np.round(p)


def repaired(p: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where a large unit left no good landing: single units are flipped while that brings the words nearer to what was expected."""
    gap, p = float((p - want) @ size), p.copy()
    for _ in range(len(p)):
        after = np.abs(gap + size * (1 - 2 * p))
        i = int(np.argmin(after)) if len(p) else 0
        if not len(p) or after[i] >= abs(gap) - 1e-9:
            return p
        gap += size[i] * (1 - 2 * p[i])
        p[i] = 1 - p[i]
    return p


def _block(units: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    units = units.sort_values(["doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
    times = units["times"].to_numpy(float)
    x = np.column_stack((times, units["size"].to_numpy(float) * times))
    x /= np.maximum(x.mean(0), 1e-9)
    rng = np.random.default_rng([seed, int(units["block"].iloc[0]), len(units)])
    order = rng.permutation(len(units))
    order = order[np.argsort(-x[order, 1], kind="stable")]  # the largest are settled first, so small ones are left to land
    p = flight(units["p"].to_numpy(float)[order], x[order], rng)
    if last:
        p = repaired(land(p, x[order]), units["p"].to_numpy(float)[order], x[order, 1])
    back = np.empty(len(p))
    back[order] = p
    return units.assign(p=back)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, block: int = 2000, seed: int = 7) -> DataFrame:
    """How often each document is taken so that each source's words come near its target.

    docs: doc_id long, text string, source string (null is a source); other columns stay. A document of a source with
    rate r = target / size is taken floor(r) times and once more with probability r - floor(r). Which ones is drawn by
    the cube method: units are dealt by hash into blocks of about `block`, in each block the flight phase keeps the count
    and the words balanced, the two or fewer units that each block leaves are gathered and flown again, a hundred blocks
    in one, and so on until one block of each source lands. Only those units travel between rounds, and no task holds
    more than a block, however large a source is. The draw depends on ids, sizes and `seed` alone, so reruns agree.

    Empty and null texts have size 0 and weigh nothing; a source of size 0 has target 0 and takes none; repeated rows
    (same source, id and size) are one unit and taken together; an empty table gives an empty result; null ids are ids.
    Returns the columns of docs with size, source_size, target (double) and copies, which replace columns of that name.
    Targets are worked out on the driver from a row for each source; that table is broadcast up to BROADCAST sources.
    """
    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    ship(spark)
    slim = written(docs.select("source", "doc_id", n_words(F.col("text")).alias("size")), "mix-sizes")
    per = [(r["source"], int(r["n"]), int(r["c"])) for r in slim.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).collect()]
    goal = targets([(s, n) for s, n, _ in per], weights, share, most)
    rate = {s: goal[s] / n if n else Fraction(0) for s, n, _ in per}
    rows = [(s, n, float(goal[s]), int(rate[s]), float(rate[s] - int(rate[s])), -(-c // block)) for s, n, c in per]
    names = docs.columns
    own = prefix(docs)  # of helper columns that stand beside those of docs
    rates = spark.createDataFrame(rows, f"{own}source string, source_size long, target double, {own}whole long, {own}part double, {own}blocks long")
    rates = F.broadcast(rates) if len(rows) <= BROADCAST else rates
    units = slim.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    units = units.join(rates, units["source"].eqNullSafe(rates[f"{own}source"])).where(F.col(f"{own}part") > 0)
    units = units.select("source", "doc_id", "size", "times", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), f"{own}blocks").alias("block"), F.col(f"{own}part").alias("p"))
    blocks, settled = max([r[5] for r in rows], default=1), []
    while blocks > 1:
        flown = written(units.groupBy("source", "block").applyInPandas(partial(_block, seed=seed, last=False), UNIT), "mix-flown")
        settled.append(flown.where("p = 1"))
        units = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / 100).cast("long"))
        blocks = -(-blocks // 100)
    settled.append(units.groupBy("source", "block").applyInPandas(partial(_block, seed=seed, last=True), UNIT).where("p = 1"))
    more = settled[0]
    for x in settled[1:]:
        more = more.unionByName(x)
    more = more.select(F.col("source").alias(f"{own}s"), F.col("doc_id").alias(f"{own}d"), F.col("size").alias(f"{own}z"), F.lit(1).alias(f"{own}more"))
    known = docs.withColumn(f"{own}size", n_words(F.col("text")))
    known = known.join(rates, known["source"].eqNullSafe(F.col(f"{own}source")))
    same = F.col("source").eqNullSafe(F.col(f"{own}s")) & F.col("doc_id").eqNullSafe(F.col(f"{own}d")) & (F.col(f"{own}size") == F.col(f"{own}z"))
    joined = known.join(more, same, "left")
    copies = (F.col(f"{own}whole") + F.coalesce(f"{own}more", F.lit(0))).cast("long")
    return joined.select(*names, F.col(f"{own}size").alias("size"), "source_size", "target", copies.alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, with the columns of docs, those of clashing names too."""
    names, own = docs.columns, prefix(docs)
    clash = {c: f"{own}own_{c}" for c in names if c.lower() in ADDED}
    mixed = mix(docs.withColumnsRenamed(clash), **options).where("copies > 0")
    each = mixed.withColumn(fresh(mixed, "_i"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(*[F.col(clash.get(c, c)).alias(c) for c in names])
