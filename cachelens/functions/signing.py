"""Request signatures (version 4) as column expressions. Payloads are unsigned; times are given, not taken from a clock."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from cachelens.functions.scalars import form_encode, query_pairs

ALGORITHM, SERVICE, UNSIGNED = "AWS4-HMAC-SHA256", "s3", "UNSIGNED-PAYLOAD"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a message under a key that is known when the plan is made."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signing_key(secret: str, date: str, region: str) -> bytes:
    key = f"AWS4{secret}".encode()
    for part in (date, region, SERVICE, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def canonical_query(query: Column) -> Column:
    """Decoded, encoded again, of equal keys the last, sorted by encoded key."""
    pairs = F.transform(query_pairs(query), lambda p: F.struct(form_encode(p["key"]).alias("k"), form_encode(p["value"]).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.array_join(F.transform(F.array_sort(last), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def canonical_uri(path: Column) -> Column:
    """Each segment of the raw path encoded, so escapes in it are encoded twice."""
    return F.array_join(F.transform(F.split(path, "/", -1), form_encode), "/")


def signed_headers(headers: Column, host: Column, stamp: Column) -> Column:
    """Sorted array<struct<name, value>>: host, content-type and x-amz-* in lower case and trimmed, the mandatory ones set."""
    given = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), F.trim(e["value"]).alias("value")))
    fixed = F.array(F.struct(F.lit("host").alias("name"), host.alias("value")), F.struct(F.lit("x-amz-content-sha256").alias("name"), F.lit(UNSIGNED).alias("value")), F.struct(F.lit("x-amz-date").alias("name"), stamp.alias("value")))
    other = F.filter(given, lambda e: ((e["name"] == "content-type") | F.startswith(e["name"], F.lit("x-amz-"))) & ~e["name"].isin("x-amz-content-sha256", "x-amz-date"))
    return F.array_sort(F.concat(other, fixed))


def canonical_request(method: Column, path: Column, query: Column, entries: Column) -> Column:
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit(":"), e["value"], F.lit("\n"))), "")
    names = F.array_join(F.transform(entries, lambda e: e["name"]), ";")
    return F.concat_ws("\n", method, canonical_uri(path), canonical_query(query), lines, names, F.lit(UNSIGNED))


def authorization(request: Column, entries: Column, stamp: Column, dates: list[str], key_id: str, secret: str, region: str) -> Column:
    """Authorization header. dates: the distinct days (yyyyMMdd) of stamp; each has its own key, derived on the driver."""
    day = F.substring(stamp, 1, 8)
    scope = F.concat(day, F.lit(f"/{region}/{SERVICE}/aws4_request"))
    message = F.concat_ws("\n", F.lit(ALGORITHM), stamp, scope, F.sha2(request.cast("binary"), 256))
    signature = F.lit(None).cast("string")
    for d in dates:
        signature = F.when(day == d, hmac_sha256(signing_key(secret, d, region), message)).otherwise(signature)
    names = F.array_join(F.transform(entries, lambda e: e["name"]), ";")
    return F.concat(F.lit(f"{ALGORITHM} Credential={key_id}/"), scope, F.lit(", SignedHeaders="), names, F.lit(", Signature="), signature)
