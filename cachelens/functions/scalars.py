"""Peers, URLs, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$"


def parse_peer(text: Column) -> Column:
    """struct(host, port, error). 'host:port' after trimming; exactly two parts and a port of 0-65535."""
    trimmed = F.regexp_replace(text, _TRIM, "")
    parts = F.split(trimmed, ":", -1)
    digits = F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"^\+?0*([0-9]{1,5})$", 1)
    port = F.when(digits != "", digits.cast("int"))
    two = F.size(parts) == 2
    good = two & (port <= 65535)
    error = F.when(text.isNull(), F.lit(None)).when(~two, F.concat(F.lit("invalid format: "), text)).when(port.isNull() | (port > 65535), F.concat(F.lit("invalid port: "), F.try_element_at(parts, F.lit(2))))
    return F.struct(F.when(good, parts[0]).alias("host"), F.when(good, port).cast("int").alias("port"), error.cast("string").alias("error"))


def format_peer(host: Column, port: Column) -> Column:
    return F.concat(host, F.lit(":"), port.cast("string"))


def role(text: Column) -> Column:
    """'agent' or 'cache' in lower case; null for anything else."""
    low = F.lower(text)
    return F.when(low.isin("agent", "cache"), low)


def form_encode(text: Column) -> Column:
    """application/x-www-form-urlencoded: blanks as +, unchanged A-Z a-z 0-9 * - . _"""
    return F.url_encode(text)


def form_decode(text: Column) -> Column:
    """+ as blank and %XX; a text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def query_pairs(query: Column) -> Column:
    """array<struct<key, value>> of a query string in order; empty for null."""
    items = F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda x: x != "")

    def pair(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        return F.struct(form_decode(key).alias("key"), F.when(F.contains(x, F.lit("=")), form_decode(F.substring(x, F.length(key) + 2, F.length(x)))).otherwise(F.lit("")).alias("value"))

    return F.transform(items, pair)


def bucket_and_key(path: Column) -> Column:
    """struct(bucket, key) of '/bucket/key'; both null if there is no second slash. The key may be empty or hold slashes."""
    whole = r"(?s)^/([^/]*)/(.*)$"
    fits = path.rlike(whole)
    return F.struct(F.when(fits, F.regexp_extract(path, whole, 1)).alias("bucket"), F.when(fits, F.regexp_extract(path, whole, 2)).alias("key"))


def is_api(path: Column, prefix: str = "/api") -> Column:
    return (path == prefix) | F.startswith(path, F.lit(f"{prefix}/"))


def compact_time(ts: Column) -> Column:
    """yyyyMMdd'T'HHmmss'Z' of a UTC time."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def entry_weight(path: Column, content: Column) -> Column:
    """Bytes that a cache entry counts for."""
    return (F.octet_length(path) + F.octet_length(content)).cast("long")


def parse_duration_s(text: Column) -> Column:
    """'1h 30m', '500ms' as seconds; null if it can't be read. Seconds of each unit."""
    units = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0, "hr": 3600.0, "d": 86400.0, "day": 86400.0, "days": 86400.0}
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+) *([a-z]+)"), 0)

    def seconds(x: Column) -> Column:
        unit = F.regexp_extract(x, r"([a-z]+)$", 1)
        factor = F.lit(None).cast("double")
        for name, value in units.items():
            factor = F.when(unit == name, F.lit(value)).otherwise(factor)
        return F.regexp_extract(x, r"^([0-9]+)", 1).cast("double") * factor

    total = F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda a, b: a + b)
    return F.when(text.rlike(r"^ *([0-9]+ *[a-z]+ *)+$"), total)


def parse_bytes(text: Column) -> Column:
    """'64MiB', '1 GB' as bytes; null if it can't be read. Powers of 1000 and 1024."""
    number = F.regexp_extract(text, r"^ *([0-9]+(?:\.[0-9]+)?) *[A-Za-z]* *$", 1)
    unit = F.lower(F.regexp_extract(text, r"^ *[0-9.]+ *([A-Za-z]*) *$", 1))
    units = {"": 1, "b": 1} | {f"{p}{s}": base**n for n, p in enumerate("kmgtp", 1) for s, base in (("", 1000), ("b", 1000), ("ib", 1024), ("i", 1024))}
    factor = F.lit(None).cast("double")
    for name, value in units.items():
        factor = F.when(unit == name, F.lit(float(value))).otherwise(factor)
    return F.when(number != "", F.floor(number.cast("double") * factor)).cast("long")


def endpoint(url: Column) -> Column:
    """struct(host, port, tls) of an endpoint: host 'localhost' and port 443 (https) or 80 unless given."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)", 1)
    host, port = F.regexp_extract(rest, r"^(.*?)(?::[0-9]*)?$", 1), F.regexp_extract(rest, r":([0-9]+)$", 1)
    tls = scheme == "https"
    return F.struct(F.when(host == "", "localhost").otherwise(host).alias("host"), F.when(port != "", port.cast("int")).otherwise(F.when(tls, 443).otherwise(80)).alias("port"), tls.alias("tls"))


def rotated(ts: Column, rotation: str) -> Column:
    """Start of the log file that a line belongs to; null if files are never rotated."""
    unit = {"minutely": "minute", "hourly": "hour", "daily": "day", "never": None}[rotation]
    return F.date_trunc(unit, ts) if unit else F.lit(None).cast("timestamp_ntz")


def payload(n: Column) -> Column:
    """0, 1, ... n-1 as 16 hex digits each, joined."""
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: F.lpad(F.lower(F.hex(i)), 16, "0")), ""))
