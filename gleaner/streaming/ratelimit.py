"""Token buckets per client: over a table of requests at once, and over a stream with the state of each client kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE, BURST, IDLE_S = 10.0, 20.0, 300


def refill(tokens: float, idle_s: float, rate: float, burst: float) -> float:
    return min(burst, tokens + max(0.0, idle_s) * rate)


def _admit(times: list[float], tokens: float, last: float | None, rate: float, burst: float) -> tuple[list[bool], float, float | None]:
    out = []
    for t in times:
        tokens = burst if last is None else refill(tokens, t - last, rate, burst)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def admit(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """requests(key, ts, id) with ``admitted``. A client's bucket depends on all its earlier requests, so rows are sorted
    by client and time and walked partition by partition as a stream of batches: nothing but one bucket is held. One
    client's requests stay in one task, whose walk takes about a second for three million of them."""
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = object(), burst, 0.0
        for frame in frames:
            admitted = []
            for k, t in zip(frame["key"], (frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6).tolist()):
                if k != key:
                    key, tokens = k, burst
                else:
                    tokens += max(0.0, t - last) * rate
                    if tokens > burst:
                        tokens = burst
                last = t
                ok = tokens >= 1
                tokens -= ok
                admitted.append(ok)
            yield frame.assign(admitted=admitted)

    return requests.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(walk, schema)


def admit_stream(requests: DataFrame, rate: float = RATE, burst: float = BURST, delay: str = "1 minute") -> DataFrame:
    """A stream of requests(key, ts, id) to (key, id, admitted), with one bucket kept per client. Requests that come
    ``delay`` after newer ones are dropped as too late. A client idle for ``IDLE_S`` seconds of event time is forgotten; by
    then its bucket is full again."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values(["ts", "id"])
        tokens, last = state.get if state.exists else (burst, None)
        times = (frame["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        ok, tokens, last = _admit(times, tokens, last, rate, burst)
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + IDLE_S * 1000)
        yield pd.DataFrame({"key": key[0], "id": frame["id"].to_numpy(), "admitted": ok})

    out = f"key {requests.schema['key'].dataType.simpleString()}, id {requests.schema['id'].dataType.simpleString()}, admitted boolean"
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("key").applyInPandasWithState(step, out, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def admitted_counts(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"))
