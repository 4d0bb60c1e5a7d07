"""Event streams: windowed counts, quiet sessions, first-wins requests and throttling, as Structured Streaming jobs.

Streams have ``key, ts`` (a timestamp).  Late rows are dropped by the watermark, which also bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, by: list[str], size: str = "5 minutes", slide: str | None = None, late: str = "15 minutes") -> DataFrame:
    """``by, start, end, n``: rows in tumbling windows, or sliding ones if ``slide`` is given."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = stream.withWatermark("ts", late).groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quiet_sessions(stream: DataFrame, by: list[str], gap: str = "1 hour", late: str = "15 minutes") -> DataFrame:
    """``by, start, end, n``: runs of rows without a pause of ``gap``; a session is told once nothing can join it any more."""
    counts = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_requests(stream: DataFrame, by: list[str], late: str = "15 minutes") -> DataFrame:
    """The first row of each request id; replays inside the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(by)


def throttled(failures: DataFrame, limit: int = 10, window_s: float = 900.0, late: str = "15 minutes") -> DataFrame:
    """``key, ts, failures, refused`` from ``key, ts`` (seconds), as the batch operator ``ledger.throttle``.

    A window opens with a key's first failure and closes ``window_s`` later.  A batch's rows are taken in order of time;
    the state of a key, two numbers, ends when the watermark passes its window's end: a later row opens a new one anyway.
    Spark's watermark begins at 1970, so times up to 0 count as late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (float("-inf"), 0)
        times = sorted(t for pdf in batches for t in pdf["ts"])
        out = []
        for ts in times:
            if ts >= opened + window_s:
                opened, n = ts, 0
            n += 1
            out.append((key[0], ts, n, n > limit))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int((opened + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "failures", "refused"])

    rows = failures.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("double").alias("ts")).where("key is not null and ts is not null")
    rows = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts double, failures int, refused boolean", "opened double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: Column, removed: str = "removed", generation: str = "generation", least: int = 0) -> DataFrame:
    """The table after a batch of provisional and final records: the last change of a key wins, removed keys go.

    Changes of a generation before ``least`` are refused.  For ``foreachBatch``: write what it returns as the next table.
    """
    last = changes.where(F.col(generation) >= least).groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")
    kept = current.join(last, key, "left_anti")
    return kept.unionByName(last.where(~F.coalesce(F.col(removed), F.lit(False))).select(*current.columns))
