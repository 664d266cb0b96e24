"""Weighted slot table: every peer owns one contiguous range of the hash space, as wide as its weight.

A table of weights is (ord long, peer string, weight long): ord is the order in which peers were added. A ring is
(slot long, peer string), slots numbered from 0. Fleets are small; key tables are not, so only weights pass through
windows without a partition, and keys are routed by one expression and one join on the slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.hashing import slot_of, xxh64

#: Slots up to which the ring is sent to all executors; a row takes about 50 bytes. Beyond it the join shuffles.
BROADCAST_SLOTS = 200_000


def build(weights: DataFrame) -> DataFrame:
    """Ring of the peers in their order. Peers of weight 0 or less own no slots; slots of a repeated peer all join where it came first."""
    before = Window.orderBy("ord", "peer").rowsBetween(Window.unboundedPreceding, -1)
    once = weights.where("weight > 0").groupBy("peer").agg(F.min("ord").alias("ord"), F.sum("weight").alias("weight"))
    placed = once.select("peer", "weight", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("first"))
    return placed.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("weight") - 1)).alias("slot"), "peer")


def from_members(members: DataFrame) -> DataFrame:
    """Weights of members (host, port, weight) in peer order: host by bytes, then port by number."""
    order = F.row_number().over(Window.orderBy("host", "port")).cast("long")
    return members.select(order.alias("ord"), F.concat("host", F.lit(":"), F.col("port").cast("string")).alias("peer"), F.col("weight").cast("long").alias("weight"))


def _edited(weights: DataFrame, edits: DataFrame, weight: Column) -> DataFrame:
    """edits: (ord, peer, vnodes), one row a peer. New peers go behind all others; those at 0 disappear and lose their place."""
    new = edits.select(F.col("ord").alias("_o"), F.col("peer").alias("_p"), "vnodes")
    last = weights.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    both = weights.join(new, weights["peer"] == new["_p"], "full_outer").crossJoin(F.broadcast(last))
    out = both.select(F.coalesce("ord", F.col("last") + 1 + F.col("_o")).alias("ord"), F.coalesce("peer", "_p").alias("peer"), weight.alias("weight"))
    return out.where("weight > 0")


def add(weights: DataFrame, edits: DataFrame) -> DataFrame:
    """Slots join at the peer's left edge; a new peer is appended."""
    return _edited(weights, edits, F.coalesce("weight", F.lit(0)) + F.coalesce("vnodes", F.lit(0)))


def sub(weights: DataFrame, edits: DataFrame) -> DataFrame:
    """Slots leave, at most all; unknown peers stay unknown."""
    return _edited(weights, edits, F.greatest(F.coalesce("weight", F.lit(0)) - F.coalesce("vnodes", F.lit(0)), F.lit(0)))


def insert(weights: DataFrame, edits: DataFrame) -> DataFrame:
    """The peer's slots are replaced in place; a new peer is appended."""
    return _edited(weights, edits, F.coalesce("vnodes", "weight"))


update = insert


def remove(weights: DataFrame, peers: DataFrame) -> DataFrame:
    return weights.join(peers.select("peer"), "peer", "left_anti").select("ord", "peer", "weight")


def nodes(ring: DataFrame) -> DataFrame:
    """n: runs of equal neighbours. Slots meet the one before by a join, so a large ring is not one task's work."""
    before = ring.select((F.col("slot") + 1).alias("_next"), F.col("peer").alias("_before"))
    pairs = ring.join(before, ring["slot"] == before["_next"], "left")
    return pairs.agg(F.count_if(~F.col("peer").eqNullSafe(F.col("_before")) | F.col("_next").isNull()).alias("n"))


def vnodes(ring: DataFrame) -> DataFrame:
    return ring.agg(F.count(F.lit(1)).alias("n"))


def vnodes_by(ring: DataFrame, peers: DataFrame) -> DataFrame:
    """n for each of the given peers, 0 where it has no slots."""
    return peers.select("peer").join(ring.groupBy("peer").agg(F.count(F.lit(1)).alias("n")), "peer", "left").select("peer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bounds(ring: DataFrame) -> DataFrame:
    """First and last slot of each peer."""
    return ring.groupBy("peer").agg(F.min("slot").alias("lpos"), F.max("slot").alias("rpos"))


def locate(keys: DataFrame, ring: DataFrame, key: Column, name: str = "peer") -> DataFrame:
    """keys with the peer that owns each key; null for null keys and on an empty ring.

    key: a long or binary column. The ring's size is read once, so the slot is an expression over literals.
    """
    slots = ring.count()
    if slots == 0:
        return keys.withColumn(name, F.lit(None).cast("string"))
    side = ring.select(F.col("slot").alias("_slot"), F.col("peer").alias(name))
    routed = keys.withColumn("_at", slot_of(xxh64(key), slots))
    side = F.broadcast(side) if slots <= BROADCAST_SLOTS else side
    return routed.join(side, F.col("_at") == F.col("_slot"), "left").drop("_at", "_slot")


def movement(keys: DataFrame, before: DataFrame, after: DataFrame, key: Column) -> DataFrame:
    """Keys that each pair of peers exchanges when the ring changes: from_peer, to_peer, n."""
    both = locate(locate(keys, before, key, "from_peer"), after, key, "to_peer")
    return both.groupBy("from_peer", "to_peer").agg(F.count(F.lit(1)).alias("n"))
