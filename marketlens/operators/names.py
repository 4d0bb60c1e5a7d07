"""Names read from pictures: pieces of lines, their keys, and candidates from an item dimension.

A dimension's ``entries`` have ``kind`` (item or base), ``name`` and ``key``; a key with a Chinese character is matched as
Chinese, others as Latin.  Text pieces come from ``name_pieces``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marketlens.functions import text as T
from marketlens.operators import name_trie

CJK = r"[\x{3400}-\x{9fff}]"
CJK_RUN = r"[\x{3400}-\x{9fff}][\x{3400}-\x{9fff}\-·‧・.]*"
LATIN_RUN = r"[A-Za-z][A-Za-z'’\- ]{2,}"
#: Where a tag starts that is no part of a name, what marks a line of numbers, and how many characters stand before it at least.
TAG_START = r"[\[［].*$|【(?=精英|卓越|普通|[A-Za-z0-9]).*$"
STAT_MARK = r"[%+:：]|[(（][A-Za-z]"
MIN_BEFORE_STAT = 4
MIN_LATIN, WINDOW_FROM, WEAK_ITEM, CANDIDATES, POSSIBLE, SURE = 6, 5, 3, 3, 5, 2
#: Glyphs that are often misread, and what they stand for; pairs of the game's and the table's spelling.
REPAIRS = (
    ("長虹指走|長虹指", "戒指"), ("長虹", "戒"), ("康賣", "寶"), ("(寶|康|賣|三重|日冕之|皇|權)她", "$1冠"), ("(頭|盔|發|發頭)炙", "$1盔"), ("(頭|盔|發|發頭|輕鋼|鋼)葷", "$1盔"),
    ("煙宁", "煙霧"), ("珠喜", "珠寶"), ("夜視之盔|和卻視之有禹只|卻視之有禹", "暗視之盔"),
)
ALIASES = (("註", "注"), ("安達莉爾的面容", "安達莉爾的面貌"))


def name_line(line: Column) -> tuple[Column, Column]:
    """What of a line may be a name, and whether it is the front of a line of numbers; null where too little stands before the mark."""
    # Each pattern is tried only where a cheaper one lets it matter.
    bare = F.when(F.rlike(line, F.lit("[\\[［【]")), F.regexp_replace(line, TAG_START, "")).otherwise(line)
    marked = F.rlike(bare, F.lit("[0-9]")) & F.rlike(bare, F.lit(rf"(?:{STAT_MARK}).*[0-9]"))
    front = F.regexp_extract(bare, rf"^(.*?)(?:{STAT_MARK}).*$", 1)
    short = F.length(F.regexp_replace(front, r"\s+", "")) < MIN_BEFORE_STAT
    return F.when(~marked, bare).when(~short, front), marked


def cjk_text(text: Column, traditional: tuple[str, str] = ("", "")) -> Column:
    """A line's Chinese in the table's spelling: no blanks, misread glyphs repaired, simplified characters (a pair of equally long
    strings, a parameter) replaced, aliases applied."""
    out = F.regexp_replace(text, r"\s+", "")
    for pattern, to in REPAIRS:
        out = F.regexp_replace(out, pattern, to)
    if traditional[0]:
        out = F.translate(out, *traditional)
    for a, b in ALIASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_NO_LATIN, _LATIN, _QUOTES, _GAPS = re.compile(r"[^A-Za-z'’\- ]+"), re.compile(LATIN_RUN), re.compile("['’‘`]"), re.compile("[^a-z0-9]+")


@F.pandas_udf(ArrayType(StringType()))
def _latin_keys(line: pd.Series) -> pd.Series:
    """The runs of Latin letters of each line as ``text.name_key`` gives them; such runs have no accents."""

    def key(run: str) -> str:
        return _GAPS.sub(" ", _QUOTES.sub("", run.lower())).strip(" ").removeprefix("the ")

    return line.map(lambda x: None if x is None else [key(r) for r in _LATIN.findall(_NO_LATIN.sub("", x))])


def name_pieces(lines: DataFrame, key: str, traditional: tuple[str, str] = ("", ""), ascii_only: bool = False) -> DataFrame:
    """``key, at, cjk, piece, stat_prefix``: the runs of Chinese and of Latin letters of each line that may be names.

    Expects ``key, pos, line``.  Pieces of fewer than two Chinese or six Latin characters are none.
    """
    name, front = name_line(F.col("line"))
    rows = lines.select(key, F.col("pos").alias("at"), name.alias("_name"), front.alias("front"))
    strip = lambda x: T.without_separators(x)
    none = F.array().cast("array<struct<cjk:boolean,piece:string,least:int>>")
    chinese = F.transform(F.regexp_extract_all(cjk_text(F.col("_name"), traditional), F.lit(CJK_RUN), F.lit(0)), lambda x: F.struct(F.lit(True).alias("cjk"), strip(x).alias("piece"), F.lit(2).alias("least")))
    if not traditional[0]:  # else a text without Chinese may get some
        chinese = F.when(F.octet_length("_name") > F.length("_name"), chinese).otherwise(none)
    latin = F.transform(F.coalesce(_latin_keys("_name"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(False).alias("cjk"), x.alias("piece"), F.lit(MIN_LATIN).alias("least")))
    # Lines without a name or a run are left out after the explosion: before it, all of this would be done twice.
    found = rows.select(key, "at", "front", F.explode_outer(F.when(F.col("_name").isNotNull(), F.concat(chinese, latin))).alias("r")).where("r IS NOT NULL")
    runs = found.select(key, "at", "r.cjk", "r.piece", "r.least", (F.col("front") & F.col("r.cjk")).alias("stat_prefix"))
    return runs.where(F.length("piece") >= F.col("least")).drop("least")


def comparison_key(raw: Column, traditional: tuple[str, str] = ("", ""), ascii_only: bool = False) -> Column:
    """What a name line is remembered by."""
    return F.when(F.rlike(raw, F.lit(CJK)), T.without_separators(cjk_text(raw, traditional))).otherwise(T.name_key(raw, ascii_only))


def name_keys(pieces: DataFrame, key: str) -> DataFrame:
    """``key, keys``: a text's name pieces in reading order, Chinese before Latin in a line; fronts of number lines are none."""
    rows = pieces.where("not stat_prefix").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (~F.col("cjk")).alias("latin"), "piece"))).alias("ps"))
    return rows.select(key, F.transform("ps", lambda p: p["piece"]).alias("keys"))


def _distance(piece: Column, name: Column, limit: Column, cjk: Column, suffix: Column) -> Column:
    """Edits from a piece, from the windows of a long Chinese piece, from its end for a short type word; 0 where the name
    stands in the piece with little around it.  Null beyond ``limit``."""
    near = lambda a: F.when(F.levenshtein(a, name) <= limit, F.levenshtein(a, name))
    size, n = F.length(name), F.length(piece)
    whole = F.when(n <= size + limit, near(piece))
    windows = F.when(cjk & (size >= WINDOW_FROM) & (n > size), F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: near(F.substring(piece, i, size)))))
    end = F.when(cjk & suffix & (size < WINDOW_FROM) & (n > size), near(F.right(piece, size)))
    glued = F.when(cjk & (n <= size + F.when(suffix, 6).otherwise(3)) & F.contains(piece, name), 0)
    return F.least(whole, windows, end, glued)


def closest_names(pieces: DataFrame, entries: DataFrame, key: str, wide: bool = False, loose: bool = False) -> DataFrame:
    """``key, kind, name, distance, score, matched, size, at``: for each text, each name within its allowed edits, in its best line.

    Bases allow one edit more than items, ends of longer runs, and fronts of number lines.  A line that is exactly a type word
    is no misspelt item.  Pieces are distinct before they meet the dimension.  Latin pieces are walked through tries of its names (``name_trie``).  A Chinese
    name that allows ``k`` edits is cut into ``k + 1`` parts, one of which a piece has as it is, or is too far; both meet on that part.
    """
    kinds = entries.select("kind", "name", F.col("key").alias("own"), F.length("key").alias("size"), F.rlike("key", F.lit(CJK)).alias("cjk"))
    base = F.col("kind") == "base"
    edits = lambda c, w: T.allowed_edits(F.col("size"), c, w, loose)
    limit = F.when(F.col("cjk"), F.when(base | F.lit(wide), edits(True, True)).otherwise(edits(True, False))).otherwise(F.when(base | F.lit(wide), edits(False, True)).otherwise(edits(False, False)))
    kinds = kinds.where((F.col("cjk")) | (F.col("size") >= MIN_LATIN)).withColumn("limit", limit)
    types = entries.where("kind = 'base'").select(F.col("key").alias("piece"), F.lit(True).alias("is_type")).distinct()
    own = pieces.select("cjk", "piece").distinct().join(types, "piece", "left")
    n = F.length("piece")
    latin = None
    for which, far in (("base", edits(False, True)), ("item", edits(False, wide))):
        listed = kinds.where(~F.col("cjk") & (base if which == "base" else ~base))
        near = name_trie.near_names(own.where("not cjk"), listed.select(F.col("own").alias("name")), far, 2**31 - 1)
        rows = near.select("piece", F.col("name").alias("own"), "distance").join(listed, "own").join(own.where("not cjk").drop("cjk"), "piece")
        latin = rows if latin is None else latin.unionByName(rows)
    cut = lambda i: F.floor(F.col("size") * i / (F.col("limit") + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("limit")), lambda i: F.substring(F.col("own"), cut(i) + 1, cut(i + 1) - cut(i)))
    listed = kinds.where("cjk").withColumn("meet", F.explode(F.array_distinct(F.filter(parts, lambda x: x != ""))))
    # Lengths of parts: a few, whatever the number of names.
    lengths = [r[0] for r in listed.select(F.length("meet")).distinct().collect()]
    runs = F.array_distinct(F.flatten(F.array(*[_grams(F.col("piece"), k) for k in lengths]))) if lengths else F.array().cast("array<string>")
    chinese = own.where("cjk").withColumn("meet", F.explode(runs)).join(listed.drop("cjk"), "meet").drop("meet").distinct()
    distance = F.when(n >= F.col("size") - F.col("limit"), _distance(F.col("piece"), F.col("own"), F.col("limit"), F.lit(True), base))
    columns = ["piece", "cjk", "is_type", "kind", "name", "own", "size", "limit", "distance"]
    met = latin.select(*columns).unionByName(chinese.withColumn("distance", distance).select(*columns))
    met = met.where("distance is not null").where(base | F.col("is_type").isNull() | (F.col("distance") == 0))
    found = pieces.select(key, "at", "piece", "cjk", "stat_prefix").join(met, ["piece", "cjk"]).where(~F.col("stat_prefix") | base)
    found = found.withColumn("score", F.col("distance") * 100 - F.least("size", F.lit(40)))
    best = F.row_number().over(Window.partitionBy(key, "kind", "name").orderBy("score", "at", "piece"))
    return found.withColumn("_n", best).where("_n = 1").select(key, "kind", "name", "distance", "score", F.col("piece").alias("matched"), "size", "at")


def _ranked(rows: DataFrame, key: str, cap: int, *first: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key, *first).orderBy("score", "at", "name"))
    return rows.withColumn("rank", n).where(F.col("rank") <= cap)


def candidates(found: DataFrame, key: str) -> DataFrame:
    """Adds ``ord``: up to three candidates of a text, best first.

    Items with a long name come first and bases after them, three in all; without any, items with a short name that are exactly a line of
    their own, and the bases; without bases, the closest items.
    """
    item = F.col("kind") == "item"
    strong = _ranked(found.where(item & (F.col("size") > WEAK_ITEM)), key, CANDIDATES).withColumn("tier", F.lit(0))
    exact = _ranked(found.where(item & (F.col("size") <= WEAK_ITEM) & (F.col("distance") == 0) & (F.length("matched") == F.col("size"))), key, CANDIDATES).withColumn("tier", F.lit(1))
    bases = _ranked(found.where(~item), key, CANDIDATES).withColumn("tier", F.lit(2))
    others = _ranked(found.where(item), key, CANDIDATES).withColumn("tier", F.lit(3))
    rows = strong.unionByName(exact).unionByName(bases).unionByName(others)
    own = Window.partitionBy(key)
    has = lambda t: F.max((F.col("tier") == t).cast("int")).over(own) == 1
    rows = rows.withColumn("s", has(0)).withColumn("b", has(2))
    rows = rows.where(F.when(F.col("s"), F.col("tier").isin(0, 2)).when(F.col("b"), F.col("tier").isin(1, 2)).otherwise(F.col("tier") == 3))
    rows = rows.withColumn("ord", F.row_number().over(own.orderBy("tier", "rank"))).where(~F.col("s") | (F.col("ord") <= CANDIDATES))
    return rows.drop("s", "b", "tier", "rank")


def extended(first: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The candidates of each text, then the closest names of a wider search that are not among them, five in all."""
    fresh = more.where((F.col("kind") == "base") | (F.col("size") > WEAK_ITEM)).join(first.select(key, "name"), [key, "name"], "left_anti")
    best = F.row_number().over(Window.partitionBy(key, "name").orderBy("score", "at"))
    fresh = fresh.withColumn("_n", best).where("_n = 1").drop("_n")
    fresh = _ranked(fresh, key, POSSIBLE).withColumn("ord", F.lit(1000) + F.col("rank")).drop("rank")
    rows = first.unionByName(fresh.select(*first.columns))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("ord") <= POSSIBLE)


def decided(rows: DataFrame, key: str, quality: Column, learned: Column | None = None, promoted: Column | None = None) -> DataFrame:
    """``key, name, kind, base, confident``: the first candidate of each text, its first base, and whether it needs no question.

    A choice that was made twice before is sure, one that was only moved up is not.  A base is sure among fewer than three candidates; an item in
    the colour of a fixed name (gold, green), or a long one without a type line.
    """
    rows = rows.withColumn("_q", quality).withColumn("_l", learned if learned is not None else F.lit(0)).withColumn("_p", promoted if promoted is not None else F.lit(False))
    g = rows.groupBy(key).agg(F.min_by(F.struct("name", "kind", "size", "_q", "_l", "_p"), "ord").alias("f"), F.count("*").alias("n"), F.min_by("name", F.when(F.col("kind") == "base", F.col("ord"))).alias("base"))
    typed, named = F.col("base").isNotNull(), F.coalesce(F.col("f._q").isin("gold", "green"), F.lit(False))
    sure = (
        F.when(F.col("f._l") >= SURE, True).when(F.col("f._p"), False).when(F.col("f.kind") == "base", F.col("n") < CANDIDATES)
        .when(F.col("f.size") <= WEAK_ITEM, typed & named).otherwise(~typed | named)
    )
    return g.select(key, "f.name", "f.kind", "base", sure.alias("confident"))


def texts_with_translations(lines: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """``key, text``: each text's lines, those without a Chinese character followed by the translation ``zh`` of ``best`` (``key, pos, zh``), if any."""
    rows = lines.join(best, [key, "pos"], "left")
    line = F.when(F.col("zh").isNull() | F.rlike("line", F.lit(CJK)), F.col("line")).otherwise(F.concat_ws(" ", "line", "zh"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    return g.select(key, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))


def translations(pairs: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """From ``chinese, english``: ``key, english`` by the Chinese name without blanks and separators (the last spelling as sorted), and ``english_key, chinese``, the
    smallest Chinese name of each English one."""
    zh = pairs.groupBy(chinese_key(F.col("chinese")).alias("key")).agg(F.max_by("english", "chinese").alias("english"))
    back = pairs.groupBy(T.name_key(F.col("english"), ascii_only).alias("english_key")).agg(F.min("chinese").alias("chinese"))
    return zh, back


def chinese_key(name: Column) -> Column:
    return T.without_separators(F.regexp_replace(name, r"\s+", ""))


def resolved(typed: DataFrame, raw: str, zh: DataFrame, products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds ``query``, ``translated`` and ``problem`` to what was typed: Chinese is translated or refused, anything else takes the product's spelling if there is one."""
    chinese = F.rlike(raw, F.lit(CJK))
    names = products.groupBy(T.name_key(F.col("name"), ascii_only).alias("_pk")).agg(F.max("name").alias("_product"))
    rows = typed.withColumn("_zk", F.when(chinese, chinese_key(F.col(raw)))).withColumn("_clean", F.btrim(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9'’\- ]", " "), r"\s+", " ")))
    rows = rows.withColumn("_nk", F.when(~chinese, T.name_key(F.col("_clean"), ascii_only)))
    rows = rows.join(zh.select(F.col("key").alias("_zk"), F.col("english").alias("_en")), "_zk", "left").join(names, F.col("_nk") == F.col("_pk"), "left")
    blank = F.coalesce(F.btrim(F.col(raw)), F.lit("")) == ""
    problem = F.when(blank, "empty").when(chinese & F.col("_en").isNull(), "untranslated").when(~chinese & (F.col("_clean") == ""), "no letters")
    query = F.when(problem.isNull(), F.when(chinese, F.col("_en")).otherwise(F.coalesce("_product", "_clean")))
    return rows.select(*typed.columns, query.alias("query"), chinese.alias("translated"), problem.alias("problem"))


def _grams(c: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    n = F.length(c) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(typed: DataFrame, names: DataFrame) -> DataFrame:
    """``typed`` beside the columns of each of ``names`` whose ``key`` contains it; ``typed`` has distinct keys that are not empty.

    A typed key of two characters or more is looked up by the one pair of its characters that the fewest names have, so that it meets no more names than
    those; a single character by itself, where each name that it meets is an answer.
    """
    pairs = names.select("*", F.explode(_grams(F.col("key"), 2)).alias("_gram"))
    often = pairs.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = typed.where(F.length("typed") >= 2).select("typed", F.explode(_grams(F.col("typed"), 2)).alias("_gram"))
    # A pair that no name has rules the key out.
    rarest = own.join(often, "_gram", "left").groupBy("typed").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r")).where("r.n > 0")
    long = rarest.select("typed", F.col("r.gram").alias("_gram")).join(pairs, "_gram").where(F.contains("key", F.col("typed")))
    single = typed.where(F.length("typed") == 1).select("typed", F.col("typed").alias("_gram"))
    short = single.join(names.select("*", F.explode(_grams(F.col("key"), 1)).alias("_gram")), "_gram")
    return long.select("typed", *names.columns).unionByName(short.select("typed", *names.columns))


def suggested_chinese(typed: DataFrame, zh: DataFrame, limit: int = 5) -> DataFrame:
    """``typed, chinese, english, rank, rn``: Chinese names that begin with (0) or contain (1) what was typed, shorter first.

    ``typed`` has ``key``; ``zh`` has ``key, chinese, english``.  Null and empty keys find nothing, and nothing finds null keys.
    """
    t = typed.select(F.col("key").alias("typed")).where("typed != ''").distinct()
    met = containing(t, zh.where("key IS NOT NULL")).where(F.col("key") != F.col("typed"))
    met = met.withColumn("rank", F.when(F.startswith("key", F.col("typed")), 0).otherwise(1))
    n = F.row_number().over(Window.partitionBy("typed").orderBy("rank", F.length("chinese"), "chinese", "english"))
    return met.withColumn("rn", n).where(F.col("rn") <= limit).select("typed", "chinese", "english", "rank", "rn")


def learned_first(rows: DataFrame, memory: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Candidates (``key, kind, name, ord``) with what was remembered for one of the text's ``keys`` (``key, at, piece``) first, and ``learned``, ``promoted``.

    Of several remembered pieces the most repeated counts, then the first.  A remembered name that is already first is not promoted.
    """
    hit = keys.join(memory.select(F.col("piece"), F.col("name").alias("hit"), "kind", "count"), "piece")
    hit = hit.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("c"), "at", "hit", "kind")).alias("h")).select(key, "h.hit", F.col("h.kind").alias("hit_kind"), (-F.col("h.c")).alias("times"))
    own = rows.join(hit, key, "left")
    same = F.col("name") == F.col("hit")
    moved = own.withColumn("learned", F.when(same, F.col("times"))).withColumn("promoted", F.coalesce(same & (F.col("ord") > 1), F.lit(False)))
    absent = hit.join(rows.withColumnRenamed("name", "hit").select(key, "hit"), [key, "hit"], "left_anti")
    added = absent.select(key, F.col("hit_kind").alias("kind"), F.col("hit").alias("name"), F.lit(0).alias("ord"), F.col("times").alias("learned"), F.lit(True).alias("promoted"))
    both = moved.withColumn("ord", F.when(F.col("promoted"), 0).otherwise(F.col("ord"))).select(key, "kind", "name", "ord", "learned", "promoted").unionByName(added)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("ord", "name")))


def with_learned_values(conditions: DataFrame, memory: DataFrame) -> DataFrame:
    """Conditions (``line, key, kind, min``) with the remembered ``min`` where the memory knows the line as the same affix; adds ``learned``."""
    m = memory.select("line", F.col("affix").alias("key"), F.col("min").alias("_min"))
    rows = conditions.join(m, ["line", "key"], "left")
    hit = F.col("_min").isNotNull() & (F.col("kind") != "bool")
    return rows.withColumn("min", F.when(hit, F.col("_min")).otherwise(F.col("min"))).withColumn("learned", hit).drop("_min")


def pruned(memory: DataFrame, entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Remembered names that the dimension still lists, in its spelling."""
    listed = entries.groupBy(T.name_key(F.col("name"), ascii_only).alias("_k")).agg(F.min(F.struct("name", "kind")).alias("e"))
    rows = memory.withColumn("_k", T.name_key(F.col("name"), ascii_only)).join(listed, "_k")
    return rows.select(*[F.col("e")[c].alias(c) if c in ("name", "kind") else F.col(c) for c in memory.columns])


def merged(memories: dict[str, DataFrame], used: str, n: int) -> DataFrame:
    """The newest ``n`` entries of several memories, with ``store``."""
    out = None
    for store, rows in memories.items():
        rows = rows.withColumn("store", F.lit(store))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.col(used).desc(), "store").limit(n)
