"""WARC: resolution of not-modified revisits against earlier captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and a leading www. dropped, host in lower case, default ports, fragment and trailing slash dropped. Null stays null."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def resolve_revisits(records: DataFrame, slots: int = 64) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    records: record_id long, url string, ts long, kind string ('response' or 'revisit'), etag string, last_modified
    string, headers map<string,string> (lower-case names); other columns are ignored. A response is earlier if its
    (ts, record_id) is smaller. Returns for each revisit record_id, url_key, ts, status, source_id and headers:
    status 'resolved' if a validator that both carry agrees and none differs; 'mismatch' if one differs, 'unchecked' if
    they share none, 'unresolved' without an earlier response. Merged headers are those of the response, updated by the
    permitted ones of the revisit, only where resolved; else the revisit's own.

    The as-of join has two levels, so a URL with a third of all records is not one task's work: time is cut at quantiles
    into `slots` slots; within a slot a window finds the latest response, and the last response of each slot (one row a
    URL and slot) is carried over to later slots. Records without url or ts are 'unresolved' revisits; other kinds are
    left out; repeated rows each get a row; an empty table gives no rows; null headers are no headers.
    """
    base = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    found = base.where("ts is not null").agg(F.percentile_approx("ts", [i / slots for i in range(1, slots)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    slot = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    placed = base.withColumn("slot", slot)
    body = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    # responses come after revisits of the same (ts, record_id), so these are not their own source
    order = [F.col("ts"), F.col("record_id"), F.col("kind").desc()]
    usable = placed.where("url_key is not null and ts is not null")
    inner = Window.partitionBy("url_key", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = usable.withColumn("near", F.last(body, ignorenulls=True).over(inner)).where("kind = 'revisit'")
    ends = usable.where("kind = 'response'").groupBy("url_key", "slot").agg(F.max_by(F.struct("record_id", "etag", "last_modified", "headers"), F.struct("ts", "record_id")).alias("end"))
    asked = near.where("near is null").select("url_key", "slot").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    outer = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.unionByName(asked).groupBy("url_key", "slot").agg(F.first("end", ignorenulls=True).alias("end"))
    carried = both.withColumn("before", F.last("end", ignorenulls=True).over(outer)).select("url_key", "slot", "before")
    joined = near.join(carried, ["url_key", "slot"], "left").withColumn("src", F.coalesce("near", "before"))
    lost = placed.where("kind = 'revisit' and (url_key is null or ts is null)").withColumn("src", F.lit(None).cast(joined.schema["src"].dataType))
    columns = ["record_id", "url_key", "ts", "etag", "last_modified", "headers", "src"]
    every = joined.select(*columns).unionByName(lost.select(*columns))
    differs = F.coalesce(F.col("etag") != F.col("src.etag"), F.lit(False)) | F.coalesce(F.col("last_modified") != F.col("src.last_modified"), F.lit(False))
    agrees = F.coalesce(F.col("etag") == F.col("src.etag"), F.lit(False)) | F.coalesce(F.col("last_modified") == F.col("src.last_modified"), F.lit(False))
    status = F.when(F.col("src").isNull(), "unresolved").when(differs, "mismatch").when(agrees, "resolved").otherwise("unchecked")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("src.headers", lambda k, v: ~F.map_contains_key(allowed, k))
    merged = F.when(status == "resolved", F.map_concat(kept, allowed)).otherwise(F.col("headers"))
    return every.select("record_id", "url_key", "ts", status.alias("status"), F.col("src.record_id").alias("source_id"), merged.alias("headers"))
