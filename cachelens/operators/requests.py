"""Object requests: classification, routing, cache outcomes, upstreams and redirect hints.

A request has method, path and query (strings), a range header (null without one) and, once classified, bucket and key.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.ranges import valid_range
from cachelens.functions.scalars import bucket_and_key, endpoint, is_api, query_pairs

OUTCOMES = ("none", "cached", "fetched", "proxied", "s3")


def classify(requests: DataFrame, prefix: str = "/api") -> DataFrame:
    """Adds category (api, get_object, other or error), bucket, key and range_spec.

    In order: paths of the control API; GETs of more than one character, where a partNumber parameter makes the request
    'other', a range that can't be read an 'error', and two path parts an object; everything else is 'other'.
    """
    parts = bucket_and_key(F.col("path"))
    get = (F.col("method") == "GET") & (F.length("path") > 1)
    part_number = F.exists(query_pairs(F.col("query")), lambda p: p["key"] == "partNumber")
    category = (
        F.when(is_api(F.col("path"), prefix), "api")
        .when(get & part_number, "other")
        .when(get & ~valid_range(F.col("range_spec")), "error")
        .when(get & parts["bucket"].isNotNull(), "get_object")
        .otherwise("other")
    )
    known = requests.withColumn("category", category)
    is_object = F.col("category") == "get_object"
    return known.withColumn("bucket", F.when(is_object, parts["bucket"])).withColumn("key", F.when(is_object, parts["key"])).withColumn("range_spec", F.when(is_object, F.col("range_spec")))


def handled(requests: DataFrame, bucket: str) -> DataFrame:
    """Adds handled: whether the cache serves the request; objects of other buckets and other requests pass through."""
    return requests.withColumn("handled", (F.col("category") == "get_object") & (F.col("bucket") == bucket))


def decision(peer: Column, own: Column, role: Column) -> Column:
    """Where a GET goes: s3 without an owner, proxied to another peer, s3 from an agent that owns it, else the cache."""
    return F.when(peer.isNull(), "s3").when(peer != own, "proxied").when(role == "agent", "s3").otherwise("cache")


def outcomes(requests: DataFrame, by: list[str], order: list[str], cache: Column | None = None, warm: DataFrame | None = None) -> DataFrame:
    """Adds outcome for a cache without eviction: fetched for the first request of each peer and key, cached for later ones.

    order: columns that number the requests, the last one unique. cache: where false, the outcome is the route itself.
    warm: keys (columns `by`) that were fetched ahead, so that all their requests are cached. The first request is found by
    aggregation and joined back, so a hot key is not one sorted run.
    """
    firsts = requests.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first")).select(F.struct(*by).alias("_by"), "_first")
    if warm is not None:
        ahead = warm.select(F.struct(*by).alias("_by")).distinct().withColumn("_warm", F.lit(True))
        firsts = firsts.join(ahead, firsts["_by"].eqNullSafe(ahead["_by"]), "left").select(firsts["_by"], "_first", "_warm")
        firsts = firsts.select("_by", F.when(F.col("_warm").isNull(), F.col("_first")).alias("_first"))
    names = requests.columns
    requests = requests.join(firsts, F.struct(*[requests[c].alias(c) for c in by]).eqNullSafe(F.col("_by")), "left").select(*[requests[c] for c in names], "_first")
    first = F.when(F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False)), "fetched").otherwise("cached")
    requests = requests.withColumn("_kind", first).drop("_first")
    first = F.col("_kind")
    return requests.withColumn("outcome", first if cache is None else F.when(cache, first).otherwise(F.col("route"))).drop("_kind")


def facts(requests: DataFrame) -> DataFrame:
    """Metric facts of classified requests (req_id, category, failed, outcome, bytes, duration_s): a row for each object GET.

    operation is GetObject, status err where the request failed in the proxy and else ok, extra the outcome, none where the
    cache did not handle the request. Calls of the control API and other requests give no facts.
    """
    got = requests.where("category = 'get_object'")
    status = F.when(F.coalesce("failed", F.lit(False)), "err").otherwise("ok")
    return got.select("req_id", F.lit("GetObject").alias("operation"), status.alias("status"), F.coalesce("outcome", F.lit("none")).alias("extra"), "bytes", "duration_s")


def api_calls(requests: DataFrame, prefix: str = "/api") -> DataFrame:
    """api, method, status, count of calls of the control API (method, path); of these only answers to members are counted."""
    members = requests.where((F.col("method") == "GET") & (F.col("path") == f"{prefix}/members"))
    return members.groupBy(F.lit("members").alias("api"), F.lit("get").alias("method"), F.lit("ok").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def health(asked: DataFrame, reachable: DataFrame) -> DataFrame:
    """asked (with peer, null to ask for the node itself) with status and message: 400 for a peer not among `reachable`."""
    up = reachable.select(F.col("peer").alias("_p")).distinct()
    found = asked.join(up, asked["peer"] == up["_p"], "left")
    bad = F.col("peer").isNotNull() & F.col("_p").isNull()
    return found.withColumn("status", F.when(bad, 400).otherwise(200)).withColumn("message", F.when(bad, F.concat(F.lit("cannot reach peer "), "peer")).otherwise("")).drop("_p")


def _lru(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "req_id"], kind="stable")
    held: OrderedDict = OrderedDict()
    used, out = 0, []
    for key, weight in zip(rows["key"], rows["weight"], strict=True):
        if key in held:
            held.move_to_end(key)
            out.append("cached")
            continue
        out.append("fetched")
        if weight <= capacity:
            held[key] = weight
            used += weight
            while used > capacity:
                used -= held.popitem(last=False)[1]
    return pd.DataFrame({"peer": rows["peer"], "req_id": rows["req_id"], "outcome": out})


def bounded_outcomes(requests: DataFrame, capacity: int) -> DataFrame:
    """peer, req_id, outcome of a least-recently-used cache of `capacity` bytes on each peer.

    requests: peer string, req_id long, ts, key string, weight long. Each peer is replayed in time order, so it is one
    task; a fleet has as many as peers.
    """
    rows = requests.select("peer", "req_id", "ts", "key", "weight")
    return rows.groupBy("peer").applyInPandas(partial(_lru, capacity=capacity), "peer string, req_id long, outcome string")


def upstream(route: Column, peer: Column, url: str, tls: bool = False) -> Column:
    """struct(address, tls, error) that a request is forwarded to."""
    to = endpoint(F.lit(url))
    s3, is_peer = route == "s3", route == "proxied"
    address = F.when(s3, F.concat(to["host"], F.lit(":"), to["port"].cast("string"))).when(is_peer, peer)
    return F.struct(address.alias("address"), F.when(s3, to["tls"]).when(is_peer, F.lit(tls)).alias("tls"), F.when(~(s3 | is_peer), "no upstream").alias("error"))


def stale_routes(requests: DataFrame, agent_peer: str = "agent_peer", cache_peer: str = "cache_peer") -> DataFrame:
    """Requests that an agent sent to a peer which, by its own ring, forwards them: these carry a redirect hint."""
    return requests.where(F.col(agent_peer).isNotNull() & F.col(cache_peer).isNotNull() & (F.col(agent_peer) != F.col(cache_peer)))


def stale_reads(requests: DataFrame) -> DataFrame:
    """Cached GETs (key, ts, req_id, method, outcome) that were fetched before a later PUT or DELETE of the key."""
    w = Window.partitionBy("key").orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = requests.withColumn("_put", F.max(F.when(F.col("method").isin("PUT", "DELETE"), F.col("ts"))).over(w)).withColumn("_got", F.max(F.when(F.col("outcome") == "fetched", F.col("ts"))).over(w))
    return seen.where((F.col("method") == "GET") & (F.col("outcome") == "cached") & (F.col("_put") > F.col("_got"))).drop("_put", "_got")


def response(content_length: Column) -> Column:
    """struct(status, content_type, content_length): always 200, whole or ranged."""
    return F.struct(F.lit(200).alias("status"), F.lit("application/octet-stream").alias("content_type"), content_length.cast("long").alias("content_length"))
