"""Rates over a stream of request facts, and a membership view over a stream of sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cachelens.operators import telemetry

#: Samples may come this late.
LATE = "5 minutes"


def _timed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def qps(facts: DataFrame, seconds: int) -> DataFrame:
    return telemetry.qps(_timed(facts), seconds)


def throughput(facts: DataFrame, seconds: int) -> DataFrame:
    return telemetry.throughput(_timed(facts), seconds)


def members(sightings: DataFrame, timeout_s: float) -> DataFrame:
    """Changes of a membership view: host, port, weight, value (the weight, or -1 once a member has expired).

    sightings: host, port, last_seen timestamp, weight. The last sighting of a peer wins, ties keep the one held; a
    member expires when event time passes its last sighting by the timeout.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        host, port = key
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"host": [host], "port": [port], "weight": [0], "value": [-1]})
            return
        seen, weight = state.get if state.exists else (-1, 0)
        for batch in batches:
            for t, w in zip((batch["last_seen"].astype("datetime64[us]").astype("int64") // 1000).tolist(), batch["weight"].tolist(), strict=True):
                if t > seen:
                    seen, weight = t, w
        state.update((seen, weight))
        due = max(seen + int(timeout_s * 1000), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"host": [host], "port": [port], "weight": [weight], "value": [weight]})

    timed = sightings.withColumn("last_seen", F.col("last_seen").cast("timestamp")).withWatermark("last_seen", LATE)
    return timed.groupBy("host", "port").applyInPandasWithState(step, "host string, port int, weight long, value long", "seen long, weight long", "update", GroupStateTimeout.EventTimeTimeout)
