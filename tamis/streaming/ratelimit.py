"""Sliding-log rate limiting: a request is accepted if fewer than ``limit`` accepted ones lie within the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Requests per window.
LIMIT, WINDOW_SECONDS = 100, 60


class SlidingLog:
    """Accepted times of the last window: at most ``limit`` of them."""

    def __init__(self, limit: int, window_us: int, times: list[int] | None = None):
        self.limit, self.window, self.times = limit, window_us, deque(times or [])

    def admit(self, at: int) -> bool:
        while self.times and at - self.times[0] >= self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def admit(requests: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Adds accepted to every request.

    A verdict depends on the ones before it, so a key's requests are walked in order, holding ``limit`` times only.
    After a pause of a whole window nothing is remembered: a key is cut there, and its stretches run in parallel.
    """
    window_us = int(window_seconds * 1e6)
    w = Window.partitionBy(key).orderBy("__us", order)
    rows = requests.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    pause = F.when(F.col("__us") - F.lag("__us").over(w) >= window_us, 1).otherwise(0)
    rows = rows.withColumn("__pause", pause).withColumn("__stretch", F.sum("__pause").over(w)).drop("__pause")
    rows = rows.repartition(key, "__stretch").sortWithinPartitions(key, "__stretch", "__us", order)
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, log = None, None
        for b in batches:
            out = []
            for k, s, us in zip(b[key], b["__stretch"], b["__us"]):
                if (k, s) != open_:
                    open_, log = (k, s), SlidingLog(limit, window_us)
                out.append(log.admit(int(us)))
            yield b[names].assign(accepted=out)

    return rows.mapInPandas(run, requests.withColumn("accepted", F.lit(True)).schema)


def admit_stream(requests: DataFrame, key: str, ts: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Streaming form: the accepted times of a key are its state, dropped when event time has passed a window.

    ``requests`` needs a watermark on ``ts``. Emits key, ts and accepted.
    """
    window_us = int(window_seconds * 1e6)

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, window_us, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("us", ignore_index=True)
        yield pd.DataFrame({key: k[0], "us": rows["us"], "accepted": [log.admit(int(u)) for u in rows["us"]]})
        state.update((list(log.times),))
        state.setTimeoutTimestamp(max(int(rows["us"].max() // 1000) + window_us // 1000, state.getCurrentWatermarkMs() + 1))

    rows = requests.select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    kind = dict(requests.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, us long, accepted boolean", "times array<long>", "append", "EventTimeTimeout")
