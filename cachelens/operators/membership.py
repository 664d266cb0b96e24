"""Membership views: last writer wins, and members expire.

A view is (host string, port int, last_seen timestamp, weight long), unique by host and port. Times are passed in, never
taken from a clock; sampling is by hash, so results can be checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEER = ("host", "port")
VIEW = (*PEER, "last_seen", "weight")
WIRE = "struct<caches:map<string,struct<last_seen:struct<secs_since_epoch:bigint,nanos_since_epoch:bigint>,weight:bigint>>>"


def _seconds(s: float) -> Column:
    return F.make_dt_interval(secs=F.lit(s).cast("decimal(18,6)"))


def self_row(like: DataFrame, host: str, port: int, now: Column, weight: int) -> DataFrame:
    spark = like.sparkSession
    kind = dict(like.dtypes)["last_seen"]
    return spark.range(1).select(F.lit(host).alias("host"), F.lit(port).cast("int").alias("port"), now.cast(kind).alias("last_seen"), F.lit(weight).cast("long").alias("weight"))


def upsert(view: DataFrame, own: DataFrame) -> DataFrame:
    """own's rows replace those of the same peers."""
    return view.select(*VIEW).join(own.select(*PEER), list(PEER), "left_anti").select(*VIEW).unionByName(own.select(*VIEW))


def bootstrap(peers: DataFrame, now: Column, own: DataFrame | None = None) -> DataFrame:
    """Peers (host, port) enter with weight 0, so they own no slots until they are synced; a cache adds itself."""
    view = peers.select(*PEER).distinct().select(*PEER, now.alias("last_seen"), F.lit(0).cast("long").alias("weight"))
    return upsert(view, own) if own is not None else view


def merge(views: list[DataFrame], now: Column, timeout_s: float, own: DataFrame | None = None) -> DataFrame:
    """Of each peer the row seen last among those no older than the timeout; ties go to the earlier view in the list.

    A time ahead of now counts as age 0. A cache then sets its own row.
    """
    every = reduce(DataFrame.unionByName, [v.select(*VIEW, F.lit(i).alias("side")) for i, v in enumerate(views)])
    best = F.max_by(F.struct("last_seen", "weight"), F.struct("last_seen", -F.col("side")))
    alive = every.where(F.col("last_seen") >= now - _seconds(timeout_s))
    merged = alive.groupBy(*PEER).agg(best.alias("b")).select(*PEER, "b.last_seen", "b.weight")
    return upsert(merged, own) if own is not None else merged


def evicted(view: DataFrame, now: Column, timeout_s: float) -> DataFrame:
    return view.where(F.col("last_seen") < now - _seconds(timeout_s)).select(*VIEW)


def sampled(view: DataFrame, n: int, round_: int = 0) -> DataFrame:
    """At most n members, by a hash of peer and round: without replacement, and the same on every run."""
    rank = F.md5(F.concat(F.col("host"), F.lit(":"), F.col("port").cast("string"), F.lit(f"#{round_}")))
    return view.orderBy(rank, *PEER).limit(n)


def others(view: DataFrame, host: str, port: int) -> DataFrame:
    return view.where(~((F.col("host") == host) & (F.col("port") == port)))


def sync_candidates(view: DataFrame, host: str, port: int, now: Column, timeout_s: float) -> DataFrame:
    """Other members younger than the timeout; at exactly the timeout a member is not asked, though merge still keeps it."""
    return others(view, host, port).where(F.col("last_seen") > now - _seconds(timeout_s))


def health_check(view: DataFrame, responders: DataFrame, now: Column, own: DataFrame | None = None) -> DataFrame:
    """Responders (host, port) are seen now, with the weight known here; no one is evicted. A cache sees itself too."""
    seen = responders.select(*PEER, F.lit(True).alias("_up")).distinct()
    fresh = view.select(*VIEW).join(seen, list(PEER), "left").select(*PEER, F.when(F.col("_up"), now).otherwise(F.col("last_seen")).alias("last_seen"), "weight")
    return upsert(fresh, own) if own is not None else fresh


def sync(view: DataFrame, responses: list[DataFrame], now: Column, timeout_s: float, own: DataFrame | None = None) -> DataFrame:
    """The view merged with all responses in order; without a response it stays as it is, and no one expires."""
    return merge([view, *responses], now, timeout_s, own) if responses else view.select(*VIEW)


def observe(view: DataFrame, answer: DataFrame | None) -> DataFrame:
    """An agent takes over the answer of one member as it is, or keeps its view."""
    return (view if answer is None else answer).select(*VIEW)


def asked(view: DataFrame, turn: int) -> DataFrame:
    """host, port: the member that an agent asks in a turn, drawn by the hash of peer and turn; one row, of nulls for an empty view."""
    draw = F.md5(F.concat(F.col("host"), F.lit(":"), F.col("port").cast("string"), F.lit(f":{turn}")).cast("binary"))
    return view.agg(F.min_by(F.struct(*PEER), draw).alias("asked")).select("asked.*")


def observed(view: DataFrame, answer: DataFrame, heard: DataFrame) -> DataFrame:
    """One turn of an agent: it takes over the answer of the member it asked, even an empty one, or keeps its view.

    heard: one row with a boolean `heard`, whether that member answered; null, which gives no rows, if there was no one to ask.
    """
    sides = view.select(*VIEW, F.lit(False).alias("heard")).unionByName(answer.select(*VIEW, F.lit(True).alias("heard")))
    return sides.join(F.broadcast(heard), "heard").select(*VIEW)


def diff_gauge(old: DataFrame, new: DataFrame) -> DataFrame:
    """host, port, value: the weight of each member of new, -1 for those that only old has."""
    a, b = old.select(*PEER, F.lit(1).alias("_a")), new.select(*PEER, F.col("weight").alias("_w"), F.lit(1).alias("_b"))
    return a.join(b, list(PEER), "full_outer").select(*PEER, F.when(F.col("_b").isNull(), F.lit(-1)).otherwise(F.col("_w")).cast("long").alias("value"))


def shutdown_gauge(view: DataFrame) -> DataFrame:
    return diff_gauge(view, view.limit(0))


def to_wire(view: DataFrame) -> DataFrame:
    """One row: caches, the JSON text {"caches": {"host:port": {last_seen, weight}}} of a view, sorted by peer text."""
    micros = F.unix_micros(F.col("last_seen").cast("timestamp"))
    seen = F.struct(F.floor(micros / 1_000_000).cast("long").alias("secs_since_epoch"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("long").alias("nanos_since_epoch"))
    entry = F.struct(F.concat("host", F.lit(":"), F.col("port").cast("string")).alias("k"), F.struct(seen.alias("last_seen"), F.col("weight").cast("long").alias("weight")).alias("v"))
    return view.agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("caches"))).alias("json"))


def from_wire(rows: DataFrame, column: str = "json") -> DataFrame:
    """The view of each JSON text; peers that can't be read are left out."""
    from cachelens.functions.scalars import parse_peer

    found = rows.select(F.explode(F.from_json(column, WIRE)["caches"]).alias("k", "v")).select(parse_peer(F.col("k")).alias("p"), "v")
    at = F.timestamp_micros(F.col("v.last_seen.secs_since_epoch") * 1_000_000 + F.floor(F.col("v.last_seen.nanos_since_epoch") / 1000))
    return found.where("p.host is not null").select("p.host", "p.port", at.cast("timestamp_ntz").alias("last_seen"), F.col("v.weight").alias("weight"))


def latest(rows: DataFrame, by: list[str]) -> DataFrame:
    """A view from sightings: of each peer (within `by`) the last one."""
    rest = [c for c in rows.columns if c not in (*by, *PEER, "seq")]
    last = rows.groupBy(*by, *PEER).agg(F.max_by(F.struct(*rest), F.struct("last_seen", "seq")).alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns if c != "seq"])
