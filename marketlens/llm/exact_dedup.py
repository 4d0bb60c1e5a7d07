"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into blocks of a fixed number of code points.  Equal blocks get one integer
name (the smallest occurrence number among them), then adjacent names of a document are paired and the
pairs named in the same way, until one name per document is left.  Names are equal exactly if the texts
are: nothing is hashed to decide equality, so nothing can collide.

Each naming sorts by content twice.  Occurrences are first spread by a salt, so a block that a third of
all rows hold is cut into as many groups as there are shuffle partitions; only one representative of each
group meets the others in the second sort.  Block text is shuffled twice, everything else is integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.storage import Scratch

#: White space that equality ignores: [\x20\x09-\x0D].
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without ``IGNORED`` characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def name_content(df: DataFrame, content: list[str], salts: int) -> DataFrame:
    """Replaces the ``content`` columns by ``name``: the least ``occ`` of the rows with equal content."""
    by_salt = df.withColumn("_local", F.min("occ").over(Window.partitionBy(*content, F.pmod("row", F.lit(salts)))))
    stands = F.col("occ") == F.col("_local")
    split = by_salt.select(
        *[c for c in df.columns if c not in content], "_local", stands.alias("_stands"), *[F.when(stands, F.col(c)).alias(c) for c in content]
    )
    spread = F.when(~F.col("_stands"), F.col("_local"))
    met = split.withColumn("_met", F.min("_local").over(Window.partitionBy(*content, "_stands", spread))).drop(*content)
    return met.withColumn("name", F.min("_met").over(Window.partitionBy("_local"))).drop("_local", "_stands", "_met")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8192, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row with its group of equal texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` and the columns named in ``carry``.  Texts are equal when identical after
    deleting ``IGNORED``; null, empty and blank texts are equal to each other.  Of a group, the row with the
    most code points in its original text stays, then the one with the smallest id (null ids last), then
    the first as read.  Repeated rows, also with the same id, are members of their group each; exactly one
    stays.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    The input must give the same rows in the same order when read again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    carried = [f"c_{c}" for c in carry]
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"), normalised(F.col(text_col)).alias("clean"), *[F.col(c).alias(f"c_{c}") for c in carry])
    cut = F.when(F.length("clean") <= block_chars, F.array("clean")).otherwise(F.regexp_extract_all("clean", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)))
    blocks = (
        texts.select("doc_id", "chars", *carried, F.sha2("clean", 256).alias("sha"), cut.alias("blocks"))
        .select("doc_id", "chars", *carried, "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
        .withColumn("occ", F.monotonically_increasing_id())
        .withColumn("row", F.col("occ") - F.col("pos"))
    )
    first = F.col("pos") == 0
    blocks = blocks.select("row", "occ", "pos", "n_blocks", "block", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "chars", "sha", *carried)])
    named = scratch.table(name_content(blocks, ["block"], salts), "blocks")

    whole = ["row", "n_blocks", "name"]
    done = [named.where("n_blocks = 1").select(*whole)]
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    level, rest = 0, named.where("n_blocks > 1").select("row", "pos", "n_blocks", "name")
    while (1 << level) < most:
        level += 1
        second = F.col("pos") % 2 == 1
        pairs = rest.groupBy("row", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(~second, F.col("name"))).alias("a"), F.max(F.when(second, F.col("name"))).alias("b")
        )
        pairs = pairs.withColumn("occ", F.col("row") + F.col("pos").cast("long") * (1 << level)).withColumn("size", F.col("n_blocks"))
        rest = scratch.table(name_content(pairs, ["size", "a", "b"], salts), f"pairs{level}")
        ends = F.col("n_blocks") <= (1 << level)
        done.append(rest.where(ends).select(*whole))
        rest = rest.where(~ends).select("row", "pos", "n_blocks", "name")
    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)

    heads = named.where("pos = 0").select("row", "doc_id", "chars", "sha", *carried)
    rows = scratch.table(heads.join(identity, "row"), "rows")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = scratch.table(rows.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    scratch.keep(rows, groups)
    joined = rows.join(groups, ["n_blocks", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(f"c_{c}").alias(c) for c in carry],
    )
