"""Best-fit packing of documents into fixed-length sequences, in bulk-synchronous rounds.

A document's token ids end with ``end_id``.  Only documents longer than a sequence are cut, into full pieces;
the first piece takes what is left over.  Full pieces are sequences of their own.  The others are
range-sorted by length, with a rank inside each length.  Pieces longer than half a sequence open one each; after
that every round matches unplaced pieces with the gaps of open sequences:

* sweep: going up over the at most ``capacity`` lengths, each gap takes the longest piece that fits (the
  successor of a piece among the gaps, of a gap among the pieces);
* conflicts go by rank: the i-th piece of a length meets the gap of that rank;
* matched gaps shrink and take a new rank behind those of their new length; the next round begins.

Where no gap takes anything, as many of the longest pieces as the rest must need at least open sequences.
A sweep needs only how many pieces and gaps there are of each length, a table bounded by ``capacity``;
pieces and gaps themselves are matched by equi-joins on (length, rank), which is unique on either side.
Very short pieces of equal length are first bundled, so that rounds stay few.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tokens import default_path, encoder
from marketlens.storage import Scratch


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) for each piece of each document."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                bounds = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[a:b]
                    out.append((doc_id, k, a, b - a, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def sweep_rounds(counts: dict[int, int], capacity: int) -> list[tuple]:
    """All matches as ``(round, size, first_rank, count, gap, gap_rank, new_rank)``; gap is null for opening ones.

    ``new_rank`` is the first rank, among gaps of what is left, of the gaps that the matches leave.
    """
    first = [0] * (capacity + 1)
    left = [counts.get(s, 0) for s in range(capacity + 1)]
    gap_first, gap_end = [0] * (capacity + 1), [0] * (capacity + 1)
    found: list[tuple] = []

    def place(rnd: int, size: int, n: int, gap: int | None) -> tuple[int, int, int]:
        rest = (capacity if gap is None else gap) - size
        found.append((rnd, size, first[size], n, gap, None if gap is None else gap_first[gap], gap_end[rest] + grown[rest]))
        grown[rest] += n
        first[size] += n
        left[size] -= n
        if gap is not None:
            gap_first[gap] += n
        return found[-1]

    rnd = 0
    grown = [0] * (capacity + 1)
    for size in range(capacity // 2 + 1, capacity + 1):
        if left[size]:
            place(rnd, size, left[size], None)
    while True:
        for rest, n in enumerate(grown):
            gap_end[rest] += n
        grown = [0] * (capacity + 1)
        if not any(left):
            return found
        rnd += 1
        total, moved = sum(left), 0
        waiting: list[int] = []
        for size in range(1, capacity + 1):
            if left[size]:
                waiting.append(size)
            free = gap_end[size] - gap_first[size]
            while free and waiting:
                n = min(free, left[waiting[-1]])
                moved += n
                free -= n
                place(rnd, waiting[-1], n, size)
                if not left[waiting[-1]]:
                    waiting.pop()
        if moved * 50 < total:
            # The rest needs at least this many sequences beyond what open gaps hold.
            room = sum(g * (gap_end[g] - gap_first[g] + grown[g]) for g in range(1, capacity + 1)) if moved else 0
            n = max(1, -(-(sum(s * c for s, c in enumerate(left)) - room) // capacity))
            for size in range(capacity, 0, -1):
                if n > 0 and left[size]:
                    k = min(n, left[size])
                    place(rnd, size, k, None)
                    n -= k


def _ranked(df: DataFrame, scratch: Scratch, lanes: int) -> DataFrame:
    """Adds ``rank``, from 0, among rows of the same ``size``; a size that most rows have is dealt to lanes."""
    df = df.withColumn("lane", F.pmod(F.xxhash64("uid"), F.lit(lanes)))
    per = df.groupBy("size", "lane").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("size", "lane").orderBy("uid")) - 1
    at = scratch.table(per.select("size", "lane", before.alias("before")), "ranks")
    return df.withColumn("inside", inside).join(at, ["size", "lane"]).withColumn("rank", F.col("inside") + F.col("before")).drop("lane", "inside", "before")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).
    Sequences hold at most ``capacity`` tokens, without gaps from 0.  Null and empty texts are documents of
    the end id alone.  Rows with repeated or null ids are documents of their own.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = cut_pieces(docs, id_col, text_col, capacity, end_id, vocabulary, with_ids)
    pieces = scratch.table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("size"))
    lanes = max(1, short.count() // 100_000)
    ranked = _ranked(short, scratch, lanes)

    each = F.when(F.col("size") <= capacity // 16, F.floor(F.lit(capacity // 8) / F.col("size"))).otherwise(1).cast("long")
    members = scratch.table(ranked.select("uid", F.col("size").alias("own"), each.alias("each"), "rank").withColumn("bundle", F.floor(F.col("rank") / F.col("each"))), "members")
    bundles = members.groupBy("own", "bundle").agg(F.min("uid").alias("uid"), F.sum("own").cast("int").alias("size"))
    items = scratch.table(_ranked(bundles, scratch, lanes), "items")

    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    matches = sweep_rounds(counts, capacity)
    plan = spark.createDataFrame(matches, "rnd int, size int, first long, n long, gap int, gap_rank long, new_rank long")
    use = plan.where("gap is not null").select(F.col("gap").alias("rest"), F.col("gap_rank").alias("u0"), F.col("n").alias("un"), F.col("rnd").alias("used"))
    rest = F.coalesce("gap", F.lit(capacity)) - F.col("size")
    drawn = items.join(F.broadcast(plan), "size").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    drawn = drawn.select(
        "uid", "own", "bundle", "rnd", "gap", (F.col("gap_rank") + F.col("rank") - F.col("first")).alias("gap_rank"), rest.alias("rest"), (F.col("new_rank") + F.col("rank") - F.col("first")).alias("rest_rank")
    )
    follows = (F.col("d.rest") == F.col("u.rest")) & (F.col("rest_rank") >= F.col("u0")) & (F.col("rest_rank") < F.col("u0") + F.col("un"))
    drawn = drawn.alias("d").join(F.broadcast(use).alias("u"), follows, "left").select("d.*", "used")
    drawn = scratch.table(drawn.repartition("rnd", F.coalesce("gap_rank", "uid")).sortWithinPartitions("rnd"), "drawn")

    opened = drawn.where("gap is null")
    placed = [opened.select("own", "bundle", F.col("uid").alias("sequence_id"), F.lit(0).alias("at"))]
    still = lambda df: df.where("used is not null").select(F.col("rest").alias("gap"), F.col("rest_rank").alias("gap_rank"), "sequence_id", "used")
    gaps = still(opened.withColumn("sequence_id", F.col("uid")))
    rounds = sorted({m[0] for m in matches if m[4] is not None})
    for k, rnd in enumerate(rounds):
        met = drawn.where((F.col("rnd") == rnd) & F.col("gap").isNotNull()).join(gaps.where(F.col("used") == rnd).drop("used"), ["gap", "gap_rank"])
        met = scratch.table(met, f"round{rnd}")
        placed.append(met.select("own", "bundle", "sequence_id", (F.lit(capacity) - F.col("gap")).alias("at")))
        if k + 1 < len(rounds):
            gaps = gaps.where(F.col("used") > rnd).unionByName(still(met))
            if k % 8 == 7:
                gaps = scratch.table(gaps, "gaps")
    all_placed = placed[0]
    for p in placed[1:]:
        all_placed = all_placed.unionByName(p)
    where = members.join(all_placed, ["own", "bundle"]).select("uid", "sequence_id", (F.col("at") + F.pmod("rank", "each") * F.col("own")).cast("long").alias("offset"))
    where = scratch.table(where, "placed")
    scratch.keep(pieces, where)
    full = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(where.unionByName(full), "uid").drop("uid").select(*[c for c in pieces.columns if c not in ("uid", "ids")], "sequence_id", "offset", *["ids"] * with_ids)
