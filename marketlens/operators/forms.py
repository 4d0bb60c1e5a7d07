"""Search and listing forms: merging read conditions into chosen ones, what blocks a start, own listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a player must do first.
FIX_LIMITS, NEED_VALUES, NEED_BASE = "limits", "values: ", "base"


def merge_conditions(chosen: DataFrame, read: DataFrame, unavailable: Column, limit: int = 8) -> DataFrame:
    """``form_id, key, min, max, on, kept``: read conditions beside those that were switched on.

    Both sides have ``form_id, key, pos, min, max``, one row for each key of a form.  What was switched on keeps its own
    numbers and stays even if it is not read.  Other read conditions are switched on in reading order up to
    ``limit`` per form, but for ``unavailable`` keys; their numbers start empty.
    """
    c = chosen.select("form_id", "key", F.col("min").alias("cmin"), F.col("max").alias("cmax"), F.lit(True).alias("kept"))
    rows = read.select("form_id", "key", "pos").join(c, ["form_id", "key"], "full").withColumn("kept", F.coalesce("kept", F.lit(False)))
    free = ~F.col("kept") & ~unavailable
    form = Window.partitionBy("form_id")
    nth = F.sum(free.cast("int")).over(form.orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("free", free).withColumn("nth", nth).withColumn("room", limit - F.sum(F.col("kept").cast("int")).over(form))
    on = F.col("kept") | (F.col("free") & (F.col("nth") <= F.col("room")))
    return rows.select("form_id", "key", F.col("cmin").alias("min"), F.col("cmax").alias("max"), on.alias("on"), "kept")


def start_blockers(conditions: DataFrame, base: str = "base") -> DataFrame:
    """``form_id, blocker``: the first rule that keeps a form from starting, empty for none.

    Limits that cross come first, then ticked conditions without a value (their labels in order), then a blank base.  Rows have
    ``form_id, pos, label, kind, on, min, max`` and the form's base; a form has a handful of conditions.
    """
    crossed = F.bool_or(F.coalesce(F.col("max") < F.col("min"), F.lit(False)))
    blank = F.col("on") & (F.col("kind") != "bool") & F.col("min").isNull() & F.col("max").isNull()
    labels = F.array_sort(F.collect_list(F.when(blank, F.struct("pos", "label"))))
    g = conditions.groupBy("form_id").agg(crossed.alias("crossed"), labels.alias("blank"), F.max(F.trim(F.coalesce(base, F.lit("")))).alias("base"))
    names = F.concat(F.lit(NEED_VALUES), F.array_join(F.transform("blank", lambda x: x["label"]), "、"))
    return g.select("form_id", F.when(F.col("crossed"), FIX_LIMITS).when(F.size("blank") > 0, names).when(F.col("base") == "", NEED_BASE).otherwise("").alias("blocker"))


def newest_listing(listings: DataFrame, group: str, id_col: str) -> DataFrame:
    """The largest id of each group, compared as numbers; ids that are none do not count."""
    return listings.groupBy(group).agg(F.max(F.col(id_col).try_cast("decimal(38,0)")).alias("newest"))


def already_listed(items: DataFrame, listings: DataFrame, key: str, own_key: str) -> DataFrame:
    """Items that an own listing has."""
    return items.join(listings.select(F.col(own_key).alias(key)), key, "left_semi")
