"""Byte ranges of 'Range' headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = r"^bytes=[ \t]*(?:[0-9]+-[0-9]*|-[0-9]+)(?:[ \t]*,[ \t]*(?:[0-9]+-[0-9]*|-[0-9]+))*[ \t]*$"


def valid_range(header: Column) -> Column:
    """True without a header, and for bytes=a-b, a-, -n and lists of these."""
    return header.isNull() | header.rlike(_SPEC)


def satisfiable(header: Column, length: Column) -> Column:
    """struct(start, stop), half-open, of the first satisfiable range of an object of `length` bytes; null if none is.

    An end past the object is cut to its length, and a suffix longer than it is the whole object.
    """
    items = F.transform(F.split(F.regexp_replace(header, r"^bytes=", ""), ","), lambda x: F.trim(x))
    size = length.cast("long")

    def bounds(x: Column) -> Column:
        a, b = F.substring_index(x, "-", 1), F.substring_index(x, "-", -1)
        start = F.when(a == "", F.greatest(size - b.try_cast("long"), F.lit(0).cast("long"))).otherwise(a.try_cast("long"))
        stop = F.when((a == "") | (b == ""), size).otherwise(F.least(b.try_cast("long") + 1, size))
        return F.struct(start.alias("start"), stop.alias("stop"))

    fits = F.filter(F.transform(items, bounds), lambda r: r["start"] < r["stop"])
    return F.when(header.rlike(_SPEC), F.try_element_at(fits, F.lit(1)))


def sliced(content: Column, header: Column) -> Column:
    """The whole content without a header, the first satisfiable range, or nothing."""
    r = satisfiable(header, F.octet_length(content))
    return F.when(header.isNull(), content).when(r.isNotNull(), F.substring(content, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int"))).otherwise(F.substring(content, 1, 0))
