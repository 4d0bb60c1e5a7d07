"""A bounded memory of choices, as a log leaves it: the least recently used keys are pushed out while the log is read, by many tasks.

The log is sorted over all partitions.  What was used last before a partition, at most as many keys as the memory holds, follows from what was used last in
each partition before it; with that, each partition is replayed by itself.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.storage import Scratch


def _use(memory: OrderedDict, key, name, most: int) -> bool:
    """Whether a choice begins a new count: the key is not remembered, or with another name."""
    new = key not in memory or memory[key] != name
    memory[key] = name
    memory.move_to_end(key)
    if len(memory) > most:
        memory.popitem(last=False)
    return new


def remembered(choices: DataFrame, key: str, order: Column, most: int = 500, cap: int = 99) -> DataFrame:
    """``key, name, count``: the ``most`` keys that the log ``key, name`` used last, their last names, and how often in a row each was chosen, ``cap`` at most.

    A key that was pushed out, because ``most`` others were used since, begins anew.  ``order`` should differ from row to row; where it does not, key and
    name decide.  Rows without a key are left out.
    """
    scratch = Scratch(choices.sparkSession, "memory")
    rows = choices.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("name").cast("string").alias("name"), order.alias("_at"))
    ordered = rows.repartitionByRange("_at", "_key", "name").sortWithinPartitions("_at", "_key", "name")
    log = scratch.table(ordered.select("_key", "name", F.spark_partition_id().cast("long").alias("_part"), F.monotonically_increasing_id().alias("_seq")), "log")
    kind = log.schema["_key"].dataType.simpleString()
    uses = log.groupBy("_part", "_key").agg(F.max(F.struct("_seq", "name")).alias("u")).select("_part", "_key", "u.name", "u._seq")
    # The last uses of a partition: its rows are bounded, and so are these, by the size of the memory.
    last = uses.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_seq")))).where(F.col("_n") <= most).drop("_n")

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: OrderedDict = OrderedDict()
        part = None
        for pdf in batches:
            out = []
            for p, k, name, seq in zip(pdf["_part"].tolist(), pdf["_key"].tolist(), pdf["name"].tolist(), pdf["_seq"].tolist()):
                if p != part:
                    part = p
                    out += [(p, k2, n2, s2, True) for k2, (n2, s2) in memory.items()]
                _use(memory, k, (name, seq), most)
            yield pd.DataFrame(out, columns=["_part", "_key", "name", "_seq", "old"])

    # One task, but of as many rows for each partition of the log as the memory has, and with no more than the memory held.
    states = last.repartition(1).sortWithinPartitions("_part", "_seq").mapInPandas(carried, f"_part long, _key {kind}, name string, _seq long, old boolean")

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: OrderedDict = OrderedDict()
        seen: dict = {}
        part = None

        def told() -> pd.DataFrame:
            return pd.DataFrame([(part, k, *v) for k, v in seen.items()], columns=["_part", "_key", "n", "anew", "name", "_seq"])

        for pdf in batches:
            for p, k, name, seq, old in zip(*(pdf[c].tolist() for c in ("_part", "_key", "name", "_seq", "old"))):
                if p != part:
                    if seen:
                        yield told()
                    part, memory, seen = p, OrderedDict(), {}
                anew = _use(memory, k, name, most)
                if not old:
                    n, before = seen[k][:2] if k in seen else (0, False)
                    seen[k] = (1 if anew else n + 1, anew or before, name, seq)
        if seen:
            yield told()

    both = log.withColumn("old", F.lit(False)).unionByName(states).repartition("_part").sortWithinPartitions("_part", "_seq")
    counted = both.mapInPandas(replayed, f"_part long, _key {kind}, n long, anew boolean, name string, _seq long")
    # A key has at most one row for each partition of the log.
    begun = counted.withColumn("_from", F.max(F.when(F.col("anew"), F.col("_part"))).over(Window.partitionBy("_key"))).where(F.col("_part") >= F.col("_from"))
    found = begun.groupBy("_key").agg(F.max_by("name", "_seq").alias("name"), F.least(F.sum("n"), F.lit(cap)).cast("int").alias("count"), F.max("_seq").alias("_used"))
    return found.orderBy(F.desc("_used")).limit(most).select(F.col("_key").alias(key), "name", "count")
