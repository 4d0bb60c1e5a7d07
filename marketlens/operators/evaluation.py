"""Accuracy of reads against what they should have been, floors that it must not fall below, tables' ages, work that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that a floor may be set for.
FLOORED = ("top1", "top3", "asked_top3", "asked_top5", "auto_right")


def accuracy(cases: DataFrame, by: list[str]) -> DataFrame:
    """Hits and times of each group of ``cases``: ``skip, unsure, top1, ok, ok5, phone`` (booleans; null: false, ``ok5``: as ``ok``), ``seconds, head_seconds``.

    Skipped cases are not scored, but their times count; times that are null or 0 do not.  An unsure case asks the user, any other
    fills in its first name by itself, rightly or wrongly.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    scored, unsure, top1, ok, phone = ~is_("skip"), is_("unsure"), is_("top1"), is_("ok"), is_("phone")
    five = F.coalesce(F.col("ok5"), ok)
    mean = lambda c, where: F.round(F.avg(F.when(where & (F.col(c) > 0), F.col(c))), 1)
    return cases.groupBy(*by).agg(
        F.count_if(scored).alias("scored"), F.count_if(scored & top1).alias("top1"), F.count_if(scored & ok).alias("top3"),
        F.count_if(scored & ~phone & ok).alias("screenshots_top3"), F.count_if(scored & ~phone).alias("screenshots_scored"),
        F.count_if(scored & phone & ok).alias("phone_top3"), F.count_if(scored & phone).alias("phone_scored"),
        F.count_if(scored & unsure & ok).alias("asked_top3"), F.count_if(scored & unsure & five).alias("asked_top5"), F.count_if(scored & unsure).alias("asked"),
        F.count_if(scored & ~unsure & top1).alias("auto_right"), F.count_if(scored & ~unsure & ~top1).alias("auto_wrong"),
        mean("seconds", ~phone).alias("avg_seconds_screenshot"), mean("seconds", phone).alias("avg_seconds_photo"), mean("head_seconds", ~phone).alias("avg_head_seconds"),
        F.max(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("max_seconds"),
    )


def floor_failures(now: DataFrame, floors: DataFrame, by: list[str], counts: tuple[str, ...] = FLOORED) -> DataFrame:
    """``by, metric, got, floor``: counts of ``now`` below those of an accepted run; groups that were scored on another number of cases are not compared."""
    metrics = lambda: F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in counts])).alias("m")
    a = now.select(*by, "scored", metrics()).select(*by, "scored", "m.metric", F.col("m.value").alias("got"))
    b = floors.select(*by, "scored", metrics()).select(*by, "scored", "m.metric", F.col("m.value").alias("floor"))
    return a.join(b, [*by, "scored", "metric"]).where("got < floor").select(*by, "metric", "got", "floor")


def table_age(made: Column, now: Column, stale_days: int = 90) -> tuple[Column, Column]:
    """Whole days since a table was made, from two times in seconds, 0 at least, and whether it is stale."""
    days = F.floor((now - made) / 86400)
    return F.greatest(F.lit(0).cast("long"), days), days > stale_days


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items that no earlier run has finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")
