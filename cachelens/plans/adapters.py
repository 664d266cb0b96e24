"""The driver's tables as fleets, requests, views, samples and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.operators import membership, ring

TIMEOUT_S = 12 * 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fleet(spark: SparkSession, sf_dir: str, modulus: int = 4) -> DataFrame:
    """host, port, weight: a cache for each supplier, weights 0 to modulus - 1."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("cache-"), key).alias("host"), (23456 + key).cast("int").alias("port"), (F.col("s_nationkey") % modulus).cast("long").alias("weight"))


def weights(spark: SparkSession, sf_dir: str, modulus: int = 4) -> DataFrame:
    return ring.from_members(fleet(spark, sf_dir, modulus))


def slots(spark: SparkSession, sf_dir: str, modulus: int = 4) -> DataFrame:
    return ring.build(weights(spark, sf_dir, modulus))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, peer, vnodes: every third cache, and three new ones."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0 or s_suppkey <= 3")
    new = F.col("s_suppkey") <= 3
    peer = F.when(new, F.concat(F.lit("new-"), F.col("s_suppkey"), F.lit(":1"))).otherwise(F.concat(F.lit("cache-"), F.col("s_suppkey"), F.lit(":"), 23456 + F.col("s_suppkey")))
    return rows.select(F.col("s_suppkey").alias("ord"), peer.alias("peer"), (F.col("s_suppkey") % 5).cast("long").alias("vnodes"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, ts, key, status, bytes, duration_s, extra of each event."""
    kind = F.col("event_type")
    extra = F.when(kind == "view", "cached").when(kind == "click", "fetched").when(kind == "purchase", "proxied").when(kind == "error", "s3").otherwise("none")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), "ts", F.col("user_id").alias("key"), F.concat(F.lit("node-"), F.col("user_id") % 8).alias("node"), F.lit("GetObject").alias("operation"),
        F.when(kind == "error", "err").otherwise("ok").alias("status"), extra.alias("extra"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("value") / 50).alias("duration_s"),
    )


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, method, path, query, range_spec of each page's URL."""
    n = F.col("page_id")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    spec = F.when(n % 8 == 3, "bytes=abc").when(n % 4 == 1, "bytes=0-99").when(n % 4 == 2, "bytes=-50").when(n % 4 == 3, "bytes=10-,20-30")
    return table(spark, sf_dir, "pages").select(
        n.alias("req_id"), F.when(n % 5 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.when(n % 11 == 0, "/api").otherwise(""), path).alias("path"),
        F.when(n % 7 == 0, F.concat(query, F.lit("&partNumber=1"))).otherwise(query).alias("query"), spec.alias("range_spec"),
    )


def ranged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content and a range header of each document."""
    n = F.col("doc_id")
    spec = F.when(n % 5 == 1, "bytes=4-13").when(n % 5 == 2, "bytes=-20").when(n % 5 == 3, "bytes=100000-,0-9").when(n % 5 == 4, "bytes=5-")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", n.cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), spec.alias("range_spec"))


def now(spark: SparkSession, sf_dir: str) -> Column:
    """Time of the last event, read once."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts").alias("t")).first()["t"]).cast("timestamp_ntz")


def view(spark: SparkSession, sf_dir: str, side: int, sides: int = 2) -> DataFrame:
    """The view that every `sides`-th event gives: a member for each user, last seen at its last event."""
    rows = table(spark, sf_dir, "events").where(F.col("event_id") % sides == side)
    sightings = rows.select(F.concat(F.lit("node-"), "user_id").alias("host"), F.lit(23456).alias("port"), F.col("ts").alias("last_seen"), F.floor("value").cast("long").alias("weight"), F.col("event_id").alias("seq"))
    return membership.latest(sightings, [])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: events so far of (user_id % 8, event_type), from 0 again every 1,000 event ids."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("peer"), "event_type", F.floor(F.col("event_id") / 1000).alias("era"), "ts", F.col("event_id").alias("seq"))
    from pyspark.sql import Window

    so_far = F.count(F.lit(1)).over(Window.partitionBy("peer", "event_type", "era").orderBy("ts", "seq"))
    return rows.select("peer", "event_type", "ts", "seq", so_far.cast("double").alias("value"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that peers report of each other; every seventh report is an eviction."""
    value = F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.floor("value")).cast("long")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("peer"), F.concat(F.lit("node-"), "user_id").alias("target"), "ts", F.col("event_id").alias("seq"), value.alias("value"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("timestamp_ntz")
    level = F.when(F.col("role") == "user", "info").when(F.col("role") == "assistant", "warn").otherwise("error")
    return table(spark, sf_dir, "conversations").select(at.alias("ts"), F.lit("fleet").alias("service_name"), F.concat(F.lit("node-"), F.col("conv_id") % 8).alias("peer"), level.alias("detected_level"), F.col("text").alias("message"))
