"""Lookups of names in an item dimension: exact, translated, by suggestion and by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.text import bigram_similarity
from marketlens.operators import name_trie


def index_names(products: DataFrame, key: Column, value: str) -> DataFrame:
    """``key, n, value``: the value of a key that only one product has, null for an ambiguous one."""
    found = products.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(value).alias("one"))
    return found.select("key", "n", F.when(F.col("n") == 1, F.col("one")).alias("value"))


def look_up(names: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Adds ``value`` and ``status``: found, ambiguous or unknown.  The side that is small enough is broadcast by Spark."""
    joined = names.join(index.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn("status", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found")).drop("n")


def cascade(names: DataFrame, key: str, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first of several indexes that knows a key, and its name as ``layer``."""
    out = names
    for k, (_, index) in enumerate(layers):
        out = out.join(index.select(F.col("key").alias(f"_k{k}"), F.col("value").alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    layer = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(n)) for k, (n, _) in enumerate(layers)])
    return out.select(*names.columns, F.coalesce(*[F.col(f"_v{k}") for k in range(len(layers))]).alias("value"), layer.alias("layer"))


def suggestions(typed: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """The names that begin with, or have a word that begins with, each typed key; shorter first.

    Both sides have ``key``; ``names`` also ``name`` and ``at``, its place in the dimension.  They meet on the whole typed key: a name
    offers what begins at each of its words, in the lengths that were typed.
    """
    t = typed.where(F.length("key") >= 2).select(F.col("key").alias("typed")).distinct()
    lengths = F.array(*[F.lit(r[0]) for r in t.select(F.length("typed")).distinct().collect()]).cast("array<int>")
    w = F.split("key", " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))
    heads = F.flatten(F.transform(tails, lambda x: F.transform(F.filter(lengths, lambda n: n <= F.length(x)), lambda n: F.substring(x, F.lit(1), n))))
    words = names.select("key", "name", "at", F.explode(F.array_distinct(heads)).alias("typed"))
    met = t.join(words, "typed").where(F.col("key") != F.col("typed"))
    rank = F.when(F.startswith("key", F.col("typed")), 0).when(F.contains(F.concat(F.lit(" "), "key"), F.concat(F.lit(" "), "typed")), 1)
    met = met.withColumn("rank", rank).where("rank is not null").select("typed", "name", "rank", "at").distinct()
    n = F.row_number().over(Window.partitionBy("typed").orderBy("rank", F.length("name"), "at"))
    return met.withColumn("rn", n).where(F.col("rn") <= limit)


def fuzzy(pieces: DataFrame, names: DataFrame, allowed: Column, limit: int = 3) -> DataFrame:
    """The closest names to each text piece, with ``distance`` within ``allowed`` (over the name's length, ``size``); see ``name_trie``."""
    near = name_trie.near_names(pieces, names, allowed, limit)
    near = near.withColumn("score", F.col("distance") * 100 - F.least("size", F.lit(40)))
    n = F.row_number().over(Window.partitionBy("piece").orderBy("score", "name"))
    return near.withColumn("rn", n).where(F.col("rn") <= limit).select("piece", "name", "distance", "score", "rn")


def strip_to_base(queries: DataFrame, bases: DataFrame) -> DataFrame:
    """The longest remainder of each ``query``, leading words dropped, that is a ``base``."""
    w = F.split("query", " ")
    rest = queries.select("query", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))).alias("dropped", "rest"))
    hit = rest.join(bases.select(F.col("base").alias("rest")).distinct(), "rest")
    return hit.groupBy("query").agg(F.min_by("rest", "dropped").alias("base"))


def same_reading(a: Column, b: Column, least: float = 0.6, least_chars: int = 40) -> Column:
    """Whether two readings (``text.reading``, made once for each text) are of one record: equal, or both long and alike in their bigrams."""
    same = a["digest"] == b["digest"]
    asked = ~same & (a["size"] >= least_chars) & (b["size"] >= least_chars)
    return same | (asked & (bigram_similarity(F.when(asked, a["grams"]), F.when(asked, b["grams"])) >= least))


def first_with_text(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``first_id``, the smallest id of any record with the same text without blanks, and ``again``: whether that is another one.

    Null texts count as empty.  Texts meet by their digest, counted map-side first, so a text that many records share sends one row a task.
    A null id comes first only where all of its text's ids are null; such rows are not ``again``.
    Columns of these names, and ``_key``, are replaced.
    """
    key = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\r\f\x0b]+", ""), 256)
    keyed = records.drop("first_id", "again", "_key").withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(id_col).alias("first_id"))
    met = keyed.join(first, "_key").drop("_key")
    return met.withColumn("again", F.coalesce(F.col("first_id") != F.col(id_col), F.lit(False)))


def name_status(queries: DataFrame, key: str, listed: DataFrame, game_only: DataFrame) -> DataFrame:
    """Adds ``status``: ``listed``, else ``game_only``, else ``unknown``, by the keys (``key``) of the two tables."""
    a = listed.select(F.col("key").alias("_a")).where("_a IS NOT NULL").distinct()
    b = game_only.select(F.col("key").alias("_b")).where("_b IS NOT NULL").distinct()
    rows = queries.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return rows.withColumn("status", F.when(F.col("_a").isNotNull(), "listed").when(F.col("_b").isNotNull(), "game_only").otherwise("unknown")).drop("_a", "_b")
