"""XXH64 with seed 0, and the slot that an unsigned 64-bit hash falls into. Bigint expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's xxhash64 starts from 42 and chains its columns; this long brings the state to 0.
SEED_ZERO = -365884300664092260
MAX_U64 = 2**64 - 1


def xxh64(key: Column) -> Column:
    """Seed-0 hash of a long's 8 little-endian bytes or of a binary; null for null."""
    return F.when(key.isNotNull(), F.xxhash64(F.lit(SEED_ZERO).cast("long"), key))


def string_key(path: Column) -> Column:
    """The bytes that a string is hashed as: UTF-8 and 0xFF."""
    return F.concat(path.cast("binary"), F.unhex(F.lit("FF")))


def bytes_key(body: Column) -> Column:
    """The bytes that a byte buffer is hashed as: its length as 8 little-endian bytes, and the bytes."""
    big = F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0")
    little = F.concat(*[F.substring(big, i, 2) for i in range(15, 0, -2)])
    return F.concat(F.unhex(little), body.cast("binary"))


def slot_of(hashed: Column, slots: int) -> Column:
    """min(hash / step, slots - 1), unsigned, with step = (2^64 - 1) / slots; null without slots.

    hash = 2h + b, so hash / step is 2 (h / step), and one more if 2 (h % step) + b reaches step.
    """
    if slots < 1:
        return F.lit(None).cast("long")
    if slots == 1:
        return F.when(hashed.isNotNull(), F.lit(0).cast("long"))
    step = MAX_U64 // slots
    half = F.shiftrightunsigned(hashed, 1)
    bit = hashed.bitwiseAND(F.lit(1).cast("long"))
    whole = F.call_function("div", half, F.lit(step).cast("long"))
    rest = half % F.lit(step).cast("long")
    more = rest >= F.when(bit == 1, F.lit(step // 2)).otherwise(F.lit(step - step // 2)).cast("long")
    return F.least(whole * 2 + more.cast("long"), F.lit(slots - 1).cast("long"))
