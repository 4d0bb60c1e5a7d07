"""Quotas, usage, streaks and throttles over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_summary(rows: DataFrame, by: list[str], price_in: float, price_out: float) -> DataFrame:
    """Token sums of positive counts, cost, rounded seconds and average latency per call (halves to even).

    Expects ``input_tokens, output_tokens, latency_ms, model_calls``; a missing number of calls is one.
    """
    pos = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0)).cast("long")
    calls = F.sum(F.coalesce("model_calls", F.lit(1))).cast("long")
    latency = F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("double")
    t = rows.groupBy(*by).agg(calls.alias("calls"), pos("input_tokens").alias("input_tokens"), pos("output_tokens").alias("output_tokens"), latency.alias("latency"))
    cost = F.col("input_tokens") / F.lit(1e6) * price_in + F.col("output_tokens") / F.lit(1e6) * price_out
    return t.select(*by, "calls", "input_tokens", "output_tokens", F.round(cost, 9).alias("cost_usd"), F.bround(F.col("latency") / 1000, 1).alias("seconds"), F.when(F.col("calls") > 0, F.bround(F.col("latency") / F.col("calls"), 0)).otherwise(0.0).alias("avg_ms"))


def admitted(rows: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """Adds ``n`` and ``ok``: a key's first ``limit`` uses are admitted, all later ones refused."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("n", n).withColumn("ok", n <= limit)


def streaks(rows: DataFrame, by: list[str], order: list[Column], same: list[str]) -> DataFrame:
    """Adds ``island`` and ``streak``: the length so far of the run of rows that agree in ``same``."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = rows.withColumn("_new", F.when(changed | (F.row_number().over(w) == 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("streak", F.row_number().over(Window.partitionBy(*by, "island").orderBy(*order))).drop("_new")


def stalled(rows: DataFrame, by: list[str], order: list[Column], unchanged: Column, last: int = 3) -> DataFrame:
    """Adds ``stalled``: the last ``last`` rows up to this one all made no progress."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)
    return rows.withColumn("stalled", (F.count("*").over(w) == last) & (F.min(unchanged.cast("int")).over(w) == 1))


def trailing_choice(rows: DataFrame, by: list[str], order: Column, value: str, cap: int = 99) -> DataFrame:
    """A key's last choice and how often in a row it was made, up to ``cap``."""
    runs = streaks(rows, by, [order], [value])
    return runs.groupBy(*by).agg(F.max_by(value, order).alias(value), F.least(F.max_by("streak", order), F.lit(cap)).alias("times"))


def replays(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``replayed``: not the first row with its request; replays are answered but not counted."""
    return rows.withColumn("replayed", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


THROTTLED = "key string, ts double, failures int, refused boolean"


def throttle(failures: DataFrame, limit: int = 10, window_s: float = 900.0) -> DataFrame:
    """Refusals by a window that opens with a key's first failure and closes ``window_s`` later, whatever comes between.

    Expects ``key, ts`` (seconds).  The next window begins with the first failure after the last has closed, which no window
    function expresses; rows are sorted inside their partition and read as a stream with one counter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, n = None, 0.0, 0
        for pdf in batches:
            out = []
            for k, ts in zip(pdf["key"], pdf["ts"]):
                if k != key or ts >= opened + window_s:
                    key, opened, n = k, ts, 0
                n += 1
                out.append((k, ts, n, n > limit))
            yield pd.DataFrame(out, columns=["key", "ts", "failures", "refused"])

    rows = failures.select(F.col("key").cast("string"), F.col("ts").cast("double")).where("key is not null and ts is not null")
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, THROTTLED)


def quiet_sessions(rows: DataFrame, by: list[str], order: list[Column], at: Column, gap: int) -> DataFrame:
    """Adds ``session``, numbered from 1 in each group: rows in order, until one comes ``gap`` or more after the one before it (``at`` is a number)."""
    w = Window.partitionBy(*by).orderBy(*order)
    timed = rows.withColumn("_at", at)
    quiet = F.col("_at") - F.lag("_at").over(w)
    marked = timed.withColumn("_new", F.when(quiet.isNull() | (quiet >= gap), 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(w)).drop("_at", "_new")


def first_records(rows: DataFrame, by: list[str], value: str, order: Column, flag: Column, flagged: str) -> DataFrame:
    """``by``, the first ``value`` of each list in order, and whether any row of it has the flag, as ``flagged``."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(value), F.bool_or(F.coalesce(flag, F.lit(False))).alias(flagged))
