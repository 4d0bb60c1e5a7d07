"""Values at exact ranks of groups of any size: medians and quartiles without a group in one task or one buffer.

Equal values of a group are counted together first.  The counts are sorted over all partitions by range; a small table of how many rows each partition has of each
group says in which partition a rank lies, and only the rows of that group and partition are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.storage import Scratch


def nearest(share: float, n: Column) -> Column:
    """The rank, from 1, of a quantile as the nearest rank gives it."""
    return F.greatest(F.lit(1), F.ceil(F.lit(share) * n)).cast("long")


def upper_median(n: Column) -> Column:
    """The rank, from 1, of the middle value, the upper one of two."""
    return (F.floor(n / 2) + 1).cast("long")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``by, n`` and, for each name of ``ranks``, the value at that rank (from 1, over the group's number of values, ``n``) among the group's values in order.

    Null values do not count; groups without values are not there; ranks outside 1 to ``n`` and null ranks give null.  Null keys are a group.  Names of ``ranks`` and ``n`` must
    not be those of ``by``.
    """
    scratch = Scratch(rows.sparkSession, "ranks")
    keys = [f"_k{i}" for i in range(len(by))]
    counted = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    order = [F.col(k) for k in keys] + [F.col("_v")]
    stored = scratch.table(counted.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "counts")
    totals = stored.groupBy(*keys, "_p").agg(F.sum("_c").alias("_t"))
    # A group has at most as many rows here as there are partitions.
    w = Window.partitionBy(*keys)
    placed = totals.withColumn("n", F.sum("_t").over(w)).withColumn("_before", F.sum("_t").over(w.orderBy("_p")) - F.col("_t"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    here = F.filter(wanted, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_before") + F.col("_t")))
    placed = scratch.table(placed.withColumn("_here", here).drop("_t"), "places")
    hit = placed.where(F.size("_here") > 0)
    part = stored.join(hit, (stored["_p"] == hit["_p"]) & _same(stored, hit, keys)).select(*[stored[k] for k in keys], stored["_p"], "_v", "_c", "_before", "_here")
    # Of a group and partition, the rows are one partition of the range sort at most.
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v")) + F.col("_before")
    found = part.withColumn("_to", cum).withColumn("_r", F.explode("_here")).where((F.col("_r.rank") > F.col("_to") - F.col("_c")) & (F.col("_r.rank") <= F.col("_to")))
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_r.name") == name, F.col("_v"))).alias(name) for name in ranks])
    sizes = placed.groupBy(*keys).agg(F.max("n").alias("n"))
    out = sizes.join(values, _same(sizes, values, keys), "left")
    return out.select(*[sizes[k].alias(c) for k, c in zip(keys, by)], "n", *ranks)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by, n`` and, for each name of ``shares``, that quantile of the group, interpolated between the two values beside it."""
    ranks = {}
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("n") - 1)
        ranks |= {f"_lo_{name}": F.floor(place) + 1, f"_hi_{name}": F.ceil(place) + 1}
    found = at_ranks(rows, by, value, ranks)
    mixed = []
    for name, share in shares.items():
        part = F.lit(float(share)) * (F.col("n") - 1) % 1
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        mixed.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return found.select(*by, "n", *mixed)
