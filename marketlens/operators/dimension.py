"""Building and auditing an item dimension: translations, coverage, duplicate keys, shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text as T


def find_products(pairs: DataFrame, products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds ``product`` and ``category`` to pairs with ``english``: the product of that name, of ``name Rune``, or without `` armor``.

    The first of these keys that is a product's counts; of products with one key the smallest name.  Unknown and null
    names keep nulls.
    """
    by_key = products.groupBy(T.name_key(F.col("name"), ascii_only).alias("key")).agg(F.min(F.struct("name", "category")).alias("p"))
    key = T.name_key(F.col("english"), ascii_only)
    keys = F.array(key, F.concat(key, F.lit(" rune")), F.regexp_replace(key, " armor$", ""))
    wanted = pairs.select("english").distinct().select("english", F.posexplode(keys).alias("at", "key"))
    found = wanted.join(by_key, "key").groupBy("english").agg(F.min_by("p", "at").alias("p"))
    return pairs.join(found, "english", "left").select(*pairs.columns, F.col("p.name").alias("product"), F.col("p.category").alias("category"))


def combine_names(found: DataFrame) -> DataFrame:
    """``chinese, n_products, product``: what each translated name stands for; null where it stays ambiguous.

    A name of several products stands for the only base item if all others are uniques or sets.  Counts of distinct
    products are kept, never lists, so a heading that precedes many items costs no memory.
    """
    met = found.where("product is not null").select("chinese", "product", "category").distinct()
    base = F.col("category") == "base"
    g = met.groupBy("chinese").agg(
        F.count("*").alias("n_products"), F.count_if(base).alias("bases"), F.count_if(F.col("category").isin("uniques", "sets")).alias("others"),
        F.min("product").alias("one"), F.min(F.when(base, F.col("product"))).alias("base"),
    )
    alone = (F.col("bases") == 1) & (F.col("others") == F.col("n_products") - 1)
    return g.select("chinese", "n_products", F.when(F.col("n_products") == 1, F.col("one")).when(alone, F.col("base")).alias("product"))


def first_names(pairs: DataFrame, key: str | Column, order: Column, most: int = 2) -> DataFrame:
    """The first ``most`` rows of each key, as translation tables list them."""
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("nth") <= most)


def add_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and new ones whose key is not among them."""
    return existing.unionByName(new.join(existing, key, "left_anti"))


def coverage(products: DataFrame, category: str, key: str, named: DataFrame) -> DataFrame:
    """``category, total, named``: how many products of each category have a row in ``named``."""
    has = named.select(F.col(key).alias("_named")).distinct()
    rows = products.join(has, F.col(key) == F.col("_named"), "left")
    return rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("total"), F.count("_named").alias("named"))


def duplicate_keys(products: DataFrame, key: Column) -> DataFrame:
    """``key, n`` of keys that several products have."""
    return products.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def shrinkage(before: DataFrame, after: DataFrame, category: str, most: float = 0.1) -> DataFrame:
    """``category, was, now, problem`` of categories that are gone or lost more than a share ``most`` of their rows."""
    was = before.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("was"))
    now = after.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("now"))
    rows = was.join(now, F.col("category").eqNullSafe(F.col("_c")), "left").withColumn("now", F.coalesce("now", F.lit(0)))
    problem = F.when(F.col("now") == 0, "gone").when(F.col("now") < F.col("was") * (1 - most), "shrunk")
    return rows.select("category", "was", "now", problem.alias("problem")).where("problem is not null")


#: Characters of Chinese names, the form of Latin names, and the words of translation tables that are no names.
CJK = r"[\x{3400}-\x{9fff}]"
LATIN_NAME = r"^[A-Za-z][A-Za-z0-9'’\- .,:]*$"
ICONS = r"[\x{e000}-\x{f8ff}]"
TABLE_WORDS = ("普通", "卓越", "精英", "英文", "舊版", "新版", "級別", "新手閱讀")


def _without_icons(lines: DataFrame, key: str) -> DataFrame:
    """Lines without a site's own glyphs; those of nothing else are none."""
    return lines.select(key, "pos", F.trim(F.regexp_replace("line", ICONS, "")).alias("line")).where("line != ''")


def name_pairs(lines: DataFrame, key: str, set_list: bool = False, least_chars: int = 4, set_chars: int = 12) -> DataFrame:
    """``key, pos, chinese, english``: pairs that stand on one line as ``name (Name)``, or on two as ``name``, ``(Name)``; as ``name``, ``Name``, ``#7``
    of rune tables; in lists of sets also as a short ``name`` and ``Name``."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = _without_icons(lines, key)
    rows = lines.select(key, "pos", "line", F.lead("line").over(w).alias("n1"), F.lead("line", 2).over(w).alias("n2"))
    latin = lambda c: F.coalesce(F.rlike(c, F.lit(LATIN_NAME)), F.lit(False))
    has = F.rlike("line", F.lit(CJK))
    one, inside = F.regexp_extract("line", r"^(.+?)\s+\(([^()]+)\)$", 1), F.trim(F.regexp_extract("line", r"^(.+?)\s+\(([^()]+)\)$", 2))
    alone = F.trim(F.regexp_extract("n1", r"^\(([^()]+)\)$", 1))
    english = (
        F.when(F.rlike(one, F.lit(CJK)) & latin(inside), inside).when(~has, None).when(latin(alone), alone).when(latin(F.col("n1")) & F.coalesce(F.rlike("n2", F.lit("^#[0-9]+$")), F.lit(False)), F.col("n1"))
        .when(F.lit(set_list) & latin(F.col("n1")) & (F.length("n1") >= least_chars) & (F.length("line") <= set_chars), F.col("n1"))
    )
    same = F.rlike(one, F.lit(CJK)) & latin(inside)
    return rows.select(key, "pos", F.when(same, F.trim(one)).otherwise(F.col("line")).alias("chinese"), english.alias("english")).where("english is not null")


def table_pairs(lines: DataFrame, key: str, most: int = 2, least_chars: int = 4, most_chars: int = 20) -> DataFrame:
    """``key, pos, chinese, english``: each English name with the up to ``most`` Chinese lines that follow it; any other line ends it."""
    lines = _without_icons(lines, key)
    chinese = F.rlike("line", F.lit(CJK))
    names = ~chinese & F.rlike("line", F.lit(LATIN_NAME)) & (F.length("line") >= least_chars)
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("cjk", chinese).withColumn("block", F.sum(F.when(chinese, 0).otherwise(1)).over(w))
    head = F.min(F.when(~F.col("cjk"), F.when(names, F.col("line")))).over(Window.partitionBy(key, "block"))
    good = F.col("cjk") & ~F.col("line").isin(*TABLE_WORDS) & (F.length("line") <= most_chars)
    rows = rows.withColumn("english", head).where(good & F.col("english").isNotNull())
    return first_names(rows.withColumnRenamed("line", "chinese"), F.struct(key, "block"), F.col("pos"), most).select(key, "pos", "chinese", "english")


def only_in_game(trusted: DataFrame, products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The English names of trusted pairs that no product has."""
    keys = products.select(T.name_key(F.col("name"), ascii_only).alias("_k")).distinct()
    return trusted.select("english").distinct().withColumn("_k", T.name_key(F.col("english"), ascii_only)).join(keys, "_k", "left_anti").select("english")


#: Rules of the audit, in order.
RULES = ("missing category", "few products", "low coverage", "duplicate key", "bad slug", "repeated slug", "noise key", "generic word", "no such product", "footer noise", "no such base", "not a base")


def audit(products: DataFrame, names: DataFrame, bases: DataFrame, game_only: DataFrame, minimums: DataFrame, floors: DataFrame, base_categories: tuple[str, ...], generic: tuple[str, ...] = (), allowed: tuple[str, ...] = (), footer: tuple[str, ...] = (), ascii_only: bool = False) -> DataFrame:
    """``rule, what`` of every violation.  ``products`` have ``name, slug, category``, ``names`` ``chinese, english``, ``bases`` and ``game_only``
    ``name``, ``minimums`` and ``floors`` ``category, least``."""
    key = T.name_key(F.col("name"), ascii_only)
    keyed = products.withColumn("key", key)
    told = names.select(T.name_key(F.col("english"), ascii_only).alias("_named")).distinct()
    counts = keyed.join(told, F.col("key") == F.col("_named"), "left").groupBy("category").agg(F.count("*").alias("total"), F.count("_named").alias("named"))
    said = lambda df, rule, what: df.select(F.lit(rule).alias("rule"), what.cast("string").alias("what"))
    at_least = minimums.join(counts, "category", "left")
    floor = floors.join(counts, "category")
    by_name = products.select(F.col("name").alias("_name"), F.col("category").alias("_category")).dropDuplicates(["_name"])
    met = names.join(by_name, F.col("english") == F.col("_name"), "left")
    base = bases.join(by_name, F.col("name") == F.col("_name"), "left")
    dup = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).where(~F.col("key").isin(*allowed) if allowed else F.lit(True))
    parts = [
        said(at_least.where("total is null"), RULES[0], F.col("category")), said(at_least.where("total < least"), RULES[1], F.col("category")),
        said(floor.where("named / total < least"), RULES[2], F.col("category")), said(dup, RULES[3], F.col("key")),
        said(products.where(~F.rlike("slug", F.lit("^[a-z0-9]+(?:-[a-z0-9]+)*$"))), RULES[4], F.col("slug")),
        said(products.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1"), RULES[5], F.col("slug")),
        said(names.where(F.rlike("chinese", F.lit(r"\s|[0-9]|發表於|評論"))), RULES[6], F.col("chinese")),
        said(met.where(F.col("chinese").isin(*generic or ("",)) & F.col("_category").isin("uniques", "sets")), RULES[7], F.col("chinese")),
        said(met.where("_name is null"), RULES[8], F.col("chinese")),
        said(game_only.where(F.lower("name").isin(*footer or ("",)) | F.rlike("name", F.lit("[0-9]"))), RULES[9], F.col("name")),
        said(base.where("_name is null"), RULES[10], F.col("name")), said(base.where(F.col("_name").isNotNull() & ~F.col("_category").isin(*base_categories)), RULES[11], F.col("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stamped(content: DataFrame, before: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Rows of ``content`` with ``generated_at``: the former stamp where nothing in ``columns`` has changed, else ``now``."""
    print_of = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    old = before.select(F.col(key).alias("_k"), print_of.alias("_old"), F.col("generated_at").alias("_at"))
    rows = content.withColumn("_new", print_of).join(old, F.col(key) == F.col("_k"), "left")
    return rows.select(*content.columns, F.when(F.col("_new") == F.col("_old"), F.col("_at")).otherwise(now).alias("generated_at"))


def cross_named(products: DataFrame, category: str, key: str, named: DataFrame) -> DataFrame:
    """``category, total, named, missing``: as ``coverage``, with the first twenty names that lack one, in order."""
    has = named.select(F.col(key).alias("_named")).distinct()
    rows = products.join(has, F.col(key) == F.col("_named"), "left")
    lacking = rows.where("_named is null").select(F.col(category).alias("category"), F.col(key).alias("what")).distinct()
    first = first_names(lacking, "category", F.col("what"), 20).groupBy("category").agg(F.array_sort(F.collect_list("what")).alias("missing"))
    return coverage(products, category, key, named).join(first, "category", "left")
