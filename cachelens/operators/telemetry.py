"""Counters, histograms and gauges, and the dashboard's queries over them.

A request fact has ts, peer, operation, status (ok, err), extra, bytes and duration_s. Samples are (ts, labels..., value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in seconds.
BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 5.0, 10.0)
LABELS = ("peer", "operation", "extra", "status")


def _by_time(rows: DataFrame, ts: str, seconds: int, by: tuple[str, ...] | list[str], value: Column) -> DataFrame:
    """start of the time bucket, labels and value. Grouped by the window itself, as streams with a watermark need it."""
    found = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(value)
    return found.withColumn("start", F.col("w.start")).select("start", *[c for c in found.columns if c != "w"])


def counters(facts: DataFrame, by: tuple[str, ...] = ("operation", "status", "extra")) -> DataFrame:
    """count, bytes and seconds of each label set."""
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes"), F.sum("duration_s").alias("seconds"))


def qps(facts: DataFrame, seconds: int, by: tuple[str, ...] = LABELS, ts: str = "ts") -> DataFrame:
    return _by_time(facts, ts, seconds, by, (F.count(F.lit(1)) / seconds).alias("qps"))


def throughput(facts: DataFrame, seconds: int, by: tuple[str, ...] = LABELS, ts: str = "ts") -> DataFrame:
    return _by_time(facts, ts, seconds, by, (F.sum("bytes") / seconds).alias("bytes_per_s"))


def histogram(facts: DataFrame, by: list[str | Column]) -> DataFrame:
    """le and cumulative_count of each label set; le is infinite in the last row. One pass: a count a bound, then rows."""
    counts = [F.count_if(F.col("duration_s") <= b) for b in BOUNDS] + [F.count(F.lit(1))]
    wide = facts.groupBy(*by).agg(F.arrays_zip(F.array(*[F.lit(b) for b in (*BOUNDS, float("inf"))]).alias("le"), F.array(*counts).alias("n")).alias("h"))
    names = [c for c in wide.columns if c != "h"]
    return wide.select(*names, F.explode("h").alias("x")).select(*names, F.col("x.le").alias("le"), F.col("x.n").alias("cumulative_count"))


def quantiles(facts: DataFrame, by: list[str | Column], wanted: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """Bucket-interpolated quantiles: in the first bucket that reaches q * total, linear; in the infinite one its lower bound."""
    hist = histogram(facts, by)
    names = [c for c in hist.columns if c not in ("le", "cumulative_count")]
    w = Window.partitionBy(*names).orderBy("le")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = hist.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("cumulative_count").over(w), F.lit(0)).cast("long")).withColumn("total", F.max("cumulative_count").over(full))
    asked = steps.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in wanted]))).withColumn("rank", F.col("q") * F.col("total"))
    hit = asked.where((F.col("cumulative_count") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("below") == 0)) & (F.col("cumulative_count") > F.col("below")))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / (F.col("cumulative_count") - F.col("below"))
    return hit.select(*names, "q", F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside).alias("seconds"))


def rate_from_samples(samples: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """Increase a second of counter samples in each time bucket; a fall is a reset, after which the value itself is the increase.

    No extrapolation to the edges of a bucket; a series' first sample has no increase.
    """
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    last = F.lag("value").over(w)
    grown = F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last)
    return _by_time(samples.withColumn("_up", grown), "ts", seconds, by, (F.sum("_up") / seconds).alias("rate"))


def members_panel(gauges: DataFrame) -> DataFrame:
    """peer, target, weight: the latest gauge of each pair where it is not negative."""
    last = gauges.groupBy("peer", "target").agg(F.max_by("value", F.struct("ts", "seq")).alias("weight"))
    return last.where(F.col("weight") >= 0)


def up(gauges: DataFrame) -> DataFrame:
    return gauges.groupBy("peer").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def logs_panel(logs: DataFrame, service: str, peer: str) -> DataFrame:
    """A service's log lines of one peer, newest first, the detected level as level."""
    return logs.where((F.col("service_name") == service) & (F.col("peer") == peer)).withColumnRenamed("detected_level", "level").orderBy(F.col("ts").desc())


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(label).distinct()


def matching(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """Rows whose label matches the whole pattern."""
    return samples.where(F.col(label).rlike(f"^(?:{pattern})$"))


def series_mean(series: DataFrame, by: list[str], value: str) -> DataFrame:
    return series.groupBy(*by).agg(F.avg(value).alias("mean"))


def relabelled(panel: DataFrame) -> DataFrame:
    """Table panel: Value shown as weight, of the labels only the target."""
    return panel.select("target", "weight")
