"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, in code point order with null last, take the weights in turn and share a budget of words
in proportion; a source's share stops at a multiple of its size and the excess is shared again.

Blocks: inside a source, documents stand in the order of a keyed hash, and their words, one after another,
are cut into blocks of equal length.  A source's quota is a number of blocks; a second round over the source
begins only when the first is used up, so no document is taken more than twice.  The blocks of a round
are permuted by an affine bijection, and the quota takes them in that order; the last one is cut so
that the words taken are the target, rounded.

Tree: the quotas of all sources are split between the two halves of the output shards by a multivariate
hypergeometric draw, and so on down to single shards.  Each shard thereby knows how many blocks of each source
it holds, draws the next ones of the permuted order, disjoint from all others, and shuffles them locally.
All randomness comes from the seed and from keys, so reruns and repeated tasks agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.storage import Scratch, numbered

WORD = r"[^\x20\x09-\x0D]+"
_LEVELS = 6
#: Primes above any block count; reduced modulo the count they are units, so i -> a * i + b is a bijection.
_PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Adds the global rank, from 0, under ``order``: range partitions, places inside them, offsets before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    parts = scratch.table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, size in sizes:
        starts.append((p, before))
        before += size
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    return parts.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + place).drop("_p", "_at", "_before")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, ordinal, target`` from ``source, source_size``, one row per source."""
    order = [F.col("source").isNull(), F.col("source")]
    table = ranked(sizes, order, scratch, "ordinal")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    table = scratch.table(table.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "sources")
    total, all_weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, full = share * float(total or 0), 0.0, -1
    if all_weights:
        level = budget / all_weights
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        n, held, open_weight = table.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        full, level = n, (budget - held) / open_weight
    return table.select("source", "source_size", "ordinal", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, ordinal, n``: the blocks of each source in each shard, from ``ordinal, quota``.

    A group holds one row per source.  Six levels of the tree are split at a time.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        todo, done = [(int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["n"].to_numpy(np.int64), 0)], []
        while todo:
            lo, hi, n, depth = todo.pop()
            if hi - lo == 1 or depth == _LEVELS:
                done.append(pd.DataFrame({"lo": lo, "hi": hi, "ordinal": pdf["ordinal"].to_numpy(), "n": n}))
                continue
            mid = (lo + hi) // 2
            draws = int(n.sum()) * (mid - lo) // (hi - lo)
            left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(n, draws, method="marginals")
            todo += [(lo, mid, left, depth + 1), (mid, hi, n - left, depth + 1)]
        return pd.concat(done)

    schema = "lo int, hi int, ordinal long, n long"
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "ordinal", F.col("quota").alias("n"))
    width = shards
    while width > 1:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(split, schema)
        width = -(-width >> _LEVELS) if width > (1 << _LEVELS) else 1
    return nodes.where("n > 0").select(F.col("lo").alias("shard"), "ordinal", "n")


def mix_segments(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 4096, shard_blocks: int = 1024, seed: int = 17, row_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(rows, segments)``.

    ``rows`` has one row per input row: ``uid, doc_id, size, source_size, target``; ``uid`` is ``row_col``, a number of each
    row, or one that is given here.  ``segments`` are the runs of words that the mix takes: ``uid, shard, place, pass,
    first_word, n_words``, in each shard in the order of ``place``.

    Null texts and texts without words have size 0 and are in no segment; a null source is a source of its
    own, the last one.  Rows with repeated or null ids are documents of their own.  An empty table, or one
    without words, gives no segments.  ``most`` is at most 2.
    """
    if not 0 <= most <= 2:
        raise ValueError("most must be between 0 and 2")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("uid"))
    sized = scratch.table(sized, "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, share, most)

    n_docs = sized.count()
    block = block_words
    largest = targets.agg(F.coalesce(F.max("source_size"), F.lit(0))).first()[0]
    if largest // block >= 1 << 31:  # places are multiplied by a unit below the number of blocks, in 64 bits
        raise ValueError(f"a source of {largest} words has too many blocks of {block}; ask for larger blocks")
    count = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    want = F.round("target").cast("long")
    whole = F.when(want >= F.col("source_size"), 1).otherwise(0)
    key = F.xxhash64("ordinal", F.lit(seed))
    unit = F.element_at(F.array(*[F.lit(p) for p in _PRIMES]), (F.pmod(key, F.lit(len(_PRIMES))) + 1).cast("int"))
    table = targets.withColumn("blocks", count).withColumn("whole", whole).withColumn("rest", want - F.col("whole") * F.col("source_size"))
    table = table.withColumn("a", F.pmod(unit, F.greatest("blocks", F.lit(1)))).withColumn("b", F.pmod(F.shiftright(key, 8), F.greatest("blocks", F.lit(1))))
    lacking = F.col("blocks") * block - F.col("source_size")
    last = F.pmod(F.col("a") * (F.col("blocks") - 1) + F.col("b"), F.greatest("blocks", F.lit(1)))
    table = table.withColumn("lacking", lacking).withColumn("last", last)
    plain = F.ceil(F.col("rest") / F.lit(block)).cast("long")
    drawn = F.when((F.col("last") < plain) & (plain * block - F.col("lacking") < F.col("rest")), F.ceil((F.col("rest") + F.col("lacking")) / F.lit(block)).cast("long")).otherwise(plain)
    table = scratch.table(table.withColumn("quota", F.col("whole") * F.col("blocks") + drawn), "targets")

    # Where each document begins in its source's order: sums per hash lane, then inside a lane.
    lane_bits = max(0, int(np.ceil(np.log2(max(1, n_docs / 20_000)))))
    key = F.xxhash64("doc_id", "size", F.lit(seed))
    filled = sized.where("size > 0").select("uid", "source", "size", key.alias("key"), F.pmod(key, F.lit(1 << lane_bits)).alias("lane"))
    lanes = filled.groupBy("source", "lane").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = scratch.table(lanes.select(F.col("source").alias("l_source"), F.col("lane").alias("l_lane"), before.alias("before")), "lanes")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "lane").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = filled.withColumn("inside", inside).join(lanes, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("lane") == F.col("l_lane")))
    placed = placed.select("uid", "source", "size", (F.col("before") + F.col("inside")).alias("start"))

    joined = placed.join(table.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).where("target > 0")
    cut = joined.withColumn("i", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)))))
    cut = cut.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))).where("pass = 1 or whole = 1")
    perm = F.pmod(F.col("a") * F.col("i") + F.col("b"), F.col("blocks"))
    used = F.col("perm") * block - F.when(F.col("perm") > F.col("last"), F.col("lacking")).otherwise(0)
    drawing = F.col("pass") == F.col("whole") + 1
    room = F.when(drawing, F.least(F.lit(block), F.greatest(F.lit(0), F.col("rest") - used))).otherwise(block)
    cut = cut.withColumn("perm", perm).withColumn("room", room).where("room > 0")
    lo = F.greatest(F.col("start"), F.col("i") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("i") * block + F.col("room"))
    cut = cut.select("uid", "ordinal", "quota", "pass", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"), F.when(drawing, F.col("whole") * F.col("blocks") + F.col("perm")).otherwise(F.col("perm")).alias("draw")).where("n_words > 0")

    n_blocks = table.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = max(1, -(-n_blocks // shard_blocks))
    quotas = scratch.table(shard_quotas(table.where("quota > 0").select("ordinal", "quota"), shards, seed), "quotas")
    end = F.sum("n").over(Window.partitionBy("ordinal").orderBy("shard"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("quota") / F.lit(shards)))
    ranges = quotas.join(table.select("ordinal", "quota"), "ordinal").withColumn("end", end).withColumn("begin", F.col("end") - F.col("n")).withColumn("step", step)
    ranges = ranges.select("ordinal", "shard", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / F.col("step")), F.floor((F.col("end") - 1) / F.col("step")))).alias("slot"))
    dealt = cut.withColumn("slot", F.floor(F.col("draw") / step)).join(ranges, ["ordinal", "slot"]).where("draw >= begin and draw < end")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("uid", "pass", "first_word", F.lit(seed)), "uid", "pass", "first_word"))
    segments = scratch.table(dealt.select("uid", "shard", place.alias("place"), "pass", "first_word", "n_words"), "segments")
    scratch.keep(sized, table, segments)
    rows = sized.join(table.select(F.col("source").alias("t_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t_source")))
    return rows.select("uid", "doc_id", "size", "source_size", "target"), segments


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per input row: the words that the mix takes of each."""
    rows, segments = mix_segments(docs, **options)
    taken = segments.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_runs(segments: DataFrame) -> DataFrame:
    """Adjacent segments of a row and pass as one: ``uid, pass, first_word, n_words`` and the shard and place of the first."""
    order = Window.partitionBy("uid", "pass").orderBy("first_word")
    begins = F.col("first_word") != F.coalesce(F.lag(F.col("first_word") + F.col("n_words")).over(order), F.lit(-1))
    # Hashed by uid alone: the join of the texts needs no further shuffle.
    marked = segments.repartition("uid").withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    head = F.min(F.struct("first_word", "shard", "place")).alias("head")
    runs = marked.groupBy("uid", "pass", "run").agg(head, F.sum("n_words").alias("n_words"))
    return runs.select("uid", "pass", "head.first_word", "n_words", "head.shard", "head.place")


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: one row per document, pass and run of words that the mix takes.

    Blocks that meet inside a document are one run; only where a block between them is not taken does a document give
    more than one row of a pass.  A document that is taken whole keeps its text as it is; of others, the text runs from the
    first to the last taken word of a run.  A column ``n_chars`` is counted anew.  Rows lie by shard, each
    shard in one partition and in the order of ``place``; a run stands where its first segment does.
    """
    import re

    word = re.compile(WORD)

    @F.pandas_udf("string")
    def words(text: pd.Series, first: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for t, a, k in zip(text, first, n):
            spans = [m.span() for m in word.finditer(t)][a : a + k]
            out.append(t[spans[0][0] : spans[-1][1]])
        return pd.Series(out, dtype=object)

    text_col = options.get("text_col", "text")
    given = numbered(docs, Scratch(docs.sparkSession, "mixed-rows"))
    rows, segments = mix_segments(given, row_col="_row", **options)
    texts = given.select(F.col("_row").alias("uid"), *[F.col(c).alias(f"c_{c}") for c in docs.columns])
    joined = taken_runs(segments).join(rows.select("uid", "size"), "uid").join(texts, "uid")
    text = F.col(f"c_{text_col}")
    joined = joined.withColumn("taken", F.when(F.col("n_words") == F.col("size"), text).otherwise(words(text, F.col("first_word"), F.col("n_words"))))
    of = lambda c: F.col("taken") if c == text_col else F.length("taken").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"c_{c}")
    mixed = joined.select(F.col("shard").alias("_shard"), F.col("place").alias("_place"), *[of(c).alias(c) for c in docs.columns])
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_place").select(*docs.columns)
