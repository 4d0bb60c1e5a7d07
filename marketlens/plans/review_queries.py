"""Registered queries of accuracy, base filters, affix lines, name states, search pages, second answers and waits, applied to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import affixes, dimension, evaluation, market, matching, outcomes, runs, scan
from marketlens.plans.queries import _t, query


def _cases(spark, d, seed: int):
    """Cases of reads from the documents and their labels."""
    k = F.col("doc_id")
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    right = (F.col("quality") == 1) | (k % 7 == seed)
    return j.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.col("quality").isNull().alias("skip"), (k % 3 == 0).alias("unsure"), right.alias("top1"), (right | (k % 2 == 0)).alias("ok"),
        F.when(k % 5 != 0, True).alias("ok5"), (k % 4 == 1).alias("phone"), (F.col("n_chars") / 1000).alias("seconds"), F.when(F.col("n_chars") > 2000, F.col("n_chars") / 3000).alias("head_seconds"),
    )


def _sql_cases(name: str, seed: int) -> str:
    return f"""{name} AS (SELECT coalesce(lang, '') AS lang, quality IS NULL AS skip, doc_id % 3 = 0 AS unsure, coalesce(quality = 1, false) OR doc_id % 7 = {seed} AS top1, coalesce(quality = 1, false) OR doc_id % 7 = {seed} OR doc_id % 2 = 0 AS ok,
  doc_id % 5 != 0 OR coalesce(quality = 1, false) OR doc_id % 7 = {seed} OR doc_id % 2 = 0 AS ok5, doc_id % 4 = 1 AS phone, n_chars / 1000 AS seconds, CASE WHEN n_chars > 2000 THEN n_chars / 3000 END AS head_seconds FROM documents LEFT JOIN labels USING (doc_id)),
{name}_g AS (SELECT lang, count(*) FILTER (NOT skip) AS scored, count(*) FILTER (NOT skip AND top1) AS top1, count(*) FILTER (NOT skip AND ok) AS top3, count(*) FILTER (NOT skip AND NOT phone AND ok) AS screenshots_top3, count(*) FILTER (NOT skip AND NOT phone) AS screenshots_scored,
  count(*) FILTER (NOT skip AND phone AND ok) AS phone_top3, count(*) FILTER (NOT skip AND phone) AS phone_scored, count(*) FILTER (NOT skip AND unsure AND ok) AS asked_top3, count(*) FILTER (NOT skip AND unsure AND ok5) AS asked_top5, count(*) FILTER (NOT skip AND unsure) AS asked,
  count(*) FILTER (NOT skip AND NOT unsure AND top1) AS auto_right, count(*) FILTER (NOT skip AND NOT unsure AND NOT top1) AS auto_wrong, round(avg(seconds) FILTER (NOT phone AND seconds > 0), 1) AS avg_seconds_screenshot, round(avg(seconds) FILTER (phone AND seconds > 0), 1) AS avg_seconds_photo,
  round(avg(head_seconds) FILTER (NOT phone), 1) AS avg_head_seconds, max(seconds) FILTER (seconds > 0) AS max_seconds FROM {name} GROUP BY lang)"""


@query(f"WITH {_sql_cases('a', 1)} SELECT * FROM a_g")
def q43_accuracy(spark, d):
    """Hits and times of reads in each language."""
    return evaluation.accuracy(_cases(spark, d, 1), ["lang"])


@query(f"""WITH {_sql_cases('a', 1)}, {_sql_cases('b', 3)}, m AS (SELECT unnest(['top1', 'top3', 'asked_top3', 'asked_top5', 'auto_right']) AS metric),
v AS (SELECT a_g.lang, metric, CASE metric WHEN 'top1' THEN a_g.top1 WHEN 'top3' THEN a_g.top3 WHEN 'asked_top3' THEN a_g.asked_top3 WHEN 'asked_top5' THEN a_g.asked_top5 ELSE a_g.auto_right END AS got,
  CASE metric WHEN 'top1' THEN b_g.top1 WHEN 'top3' THEN b_g.top3 WHEN 'asked_top3' THEN b_g.asked_top3 WHEN 'asked_top5' THEN b_g.asked_top5 ELSE b_g.auto_right END AS "floor" FROM a_g JOIN b_g ON a_g.lang = b_g.lang AND a_g.scored = b_g.scored, m)
SELECT lang, metric, got, "floor" FROM v WHERE got < "floor" """)
def q43_floors(spark, d):
    """Counts that fell below those of another run over the same cases."""
    return evaluation.floor_failures(evaluation.accuracy(_cases(spark, d, 1), ["lang"]), evaluation.accuracy(_cases(spark, d, 3), ["lang"]), ["lang"])


_BASES = "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'small' WHEN p_size % 4 = 2 THEN 'Economy' ELSE 'no such base' END"


@query(f"""WITH v AS (SELECT DISTINCT p_size, {_BASES} AS base, p_size % 5 != 0 AS passed FROM part), n AS (SELECT p_size, count(*) AS n, count(*) FILTER (lower(p_type) = lower({_BASES})) AS own FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size)
SELECT p_size, base, CASE WHEN passed AND base != '' THEN coalesce(n, 0) END AS rows_before_base, CASE WHEN passed AND base != '' THEN coalesce(own, 0) ELSE coalesce(n, 0) END AS "rows",
  CASE WHEN passed AND base != '' AND n > 0 AND own = 0 THEN '網站回傳的 ' || n || ' 筆裡沒有名稱是「' || base || '」的掛單' END AS note FROM v LEFT JOIN n USING (p_size)""")
def q11_base_notes(spark, d):
    """How many rows of each view came, and how many have the name that was asked for."""
    part = _t(spark, d, "part")
    views = part.select("p_size", F.expr(_BASES).alias("base"), (F.col("p_size") % 5 != 0).alias("passed")).distinct()
    return market.base_notes(views, part.where("p_partkey % 2 = 0").withColumnRenamed("p_type", "item_name"), "p_size")


@query(f"SELECT p_partkey, p_type FROM part WHERE {_BASES} = '' OR lower(p_type) = lower({_BASES})")
def q11_rows_of_base(spark, d):
    """The rows that have the name of the base that was asked for, if one was."""
    part = _t(spark, d, "part")
    return market.rows_of_base(part, F.expr(_BASES), "p_type").select("p_partkey", "p_type")


_ENTRIES = [affixes.Affix("all", ("所有技能",), "to all skills"), affixes.Affix("ed", ("增強",), "enhanced", "percent"), affixes.Affix("cnbf", ("無法凍結",), "cannot be frozen", "bool")]


def _item_lines(spark, d):
    lines = [
        F.col("p_name"), F.lit("生命 之寶"), F.lit("需要等級: 5"), F.concat(F.lit("+"), F.col("p_size").cast("string"), F.lit("  to All Skills")), F.concat(F.col("p_size").cast("string"), F.lit("% 增強")),
        F.lit("+99 所有技能"), F.concat(F.lit("odd line "), F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, "無法凍結"), F.lit("生命之寶 2"), F.lit("  "), F.lit("enhanced look"),
    ]
    return _t(spark, d, "part").select("p_partkey", F.posexplode(F.array(*lines)).alias("pos", "line"))


@query("""SELECT p_partkey, 'all' AS key, p_size::DOUBLE AS "min", '+' || p_size || ' to All Skills' AS line, true AS confident FROM part UNION ALL
SELECT p_partkey, 'ed', p_size::DOUBLE, p_size || '% 增強', true FROM part UNION ALL SELECT p_partkey, 'cnbf', NULL, '無法凍結', true FROM part WHERE p_partkey % 3 = 0""")
def q23_affix_lines(spark, d):
    """Conditions that item texts show, from the first line of each."""
    return affixes.parse_affixes(_item_lines(spark, d), _ENTRIES, "p_partkey").select("p_partkey", "key", "min", "line", "confident")


@query("""SELECT p_partkey, 0 AS pos, p_name AS line FROM part UNION ALL SELECT p_partkey, 6, 'odd line ' || p_brand FROM part UNION ALL SELECT p_partkey, 8, '生命之寶 2' FROM part""")
def q23_unmapped_lines(spark, d):
    """Lines that look like affixes but are none that is known; names of items are left out."""
    return affixes.unmapped_lines(_item_lines(spark, d), _ENTRIES, "p_partkey")


@query("""WITH a AS (SELECT DISTINCT p_name AS key FROM part WHERE p_partkey % 40 = 0), b AS (SELECT DISTINCT p_name AS key FROM part WHERE p_partkey % 9 = 0)
SELECT p_partkey, CASE WHEN p_name IN (SELECT key FROM a) THEN 'listed' WHEN p_name IN (SELECT key FROM b) THEN 'game_only' ELSE 'unknown' END AS status FROM part""")
def q21_name_status(spark, d):
    """Whether a name is listed, only known to the game, or unknown."""
    part = _t(spark, d, "part").withColumnRenamed("p_name", "key")
    return matching.name_status(part, "key", part.where("p_partkey % 40 = 0"), part.where("p_partkey % 9 = 0")).select("p_partkey", "status")


@query(r"""WITH p AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '&search=x' ELSE '' END AS url, CASE WHEN page_id % 5 = 0 THEN 'Sorry: No Results were found.' ELSE html END AS text, regexp_extract(url, '://([a-z]*)', 1) AS item FROM pages)
SELECT page_id, coalesce(regexp_matches(text, '(?i)no results (could be|were) found'), false) AS nothing, item != '' AND coalesce(regexp_matches(url, '[?&]search='), false) AND NOT coalesce(regexp_matches(text, '(?i)no results (could be|were) found'), false) AND page_id % 3 != 0 AS listed,
  coalesce(item != '' AND page_id % 4 < 2, false) AS formed FROM p WHERE item IS NOT NULL""")
def q30_search_pages(spark, d):
    """Whether search pages found nothing, list the item, and were asked for with a plain text."""
    k, item = F.col("page_id"), F.regexp_extract("url", "://([a-z]*)", 1)
    url = F.concat("url", F.when(k % 2 == 0, "&search=x").otherwise(""))
    text = F.when(k % 5 == 0, "Sorry: No Results were found.").otherwise(F.col("html"))
    p = _t(spark, d, "pages").select("page_id", url.alias("url"), text.alias("text"), item.alias("item")).where("item IS NOT NULL")
    links = F.when(k % 3 != 0, F.array(F.lit("home"), F.col("item"))).otherwise(F.array(F.lit("home")))
    typed = F.when(k % 4 == 0, F.col("item")).when(k % 4 == 1, F.concat("item", F.lit(" 2-x"))).when(k % 4 == 2, F.concat("item", F.lit("  x"))).otherwise(F.concat("item", F.lit("é")))
    return p.select("page_id", outcomes.found_nothing(F.col("text")).alias("nothing"), outcomes.search_shows_item(F.col("url"), F.col("text"), links, F.col("item")).alias("listed"), (outcomes.well_formed(typed) & (F.col("item") != "")).alias("formed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 AND o_orderkey % 3 != 0 THEN o_orderstatus ELSE o_orderpriority END AS choice, o_orderkey % 10 < 5 AND o_orderkey % 3 != 0 AS asked_again,
10 + CASE WHEN o_orderkey % 10 < 5 AND o_orderkey % 3 != 0 THEN o_orderkey % 7 ELSE 0 END AS tokens FROM orders""")
def q39_reasked(spark, d):
    """Decisions that were not likely enough and asked a second time, with the usage of both."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    usage = lambda n: F.create_map(F.lit("tokens"), n.cast("long"))
    first = o.select("o_orderkey", F.col("o_orderpriority").alias("choice"), (k % 10 / 10).alias("probability"), usage(F.lit(10)).alias("usage"))
    second = o.where(k % 3 != 0).select("o_orderkey", F.col("o_orderstatus").alias("choice"), usage(k % 7).alias("usage"))
    return runs.reasked(first, second, ["o_orderkey"]).select("o_orderkey", "choice", "asked_again", F.col("usage")["tokens"].alias("tokens"))


@query("""SELECT o_orderkey, round(least(0.5 * 2 ** (o_orderkey % 6), 8) * (1 + 0.1 * (o_orderkey % 11) / 10.0), 9) AS pause FROM orders""")
def q48_jittered_waits(spark, d):
    """Waits before retries, made a little longer by chance; here the chance is the key's."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", F.round(runs.backoff(k % 6, 0.5, 8, k % 11 / F.lit(10.0)), 9).alias("pause"))


@query("""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS g FROM embeddings) SELECT vec_id, array_to_string(list_transform(g, lambda x: CASE WHEN x >= list_sum(g) / len(g) THEN '1' ELSE '0' END), '') AS digits FROM c""")
def q40_grid_hashes(spark, d):
    """A digit for each cell of a grid: whether it is at least the mean of all."""
    return _t(spark, d, "embeddings").select("vec_id", scan.grid_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("digits"))


@query("""SELECT DISTINCT p_name || ' ' || p_brand AS english FROM part WHERE p_partkey % 3 = 0 AND p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_partkey % 2 = 0)""")
def q27_only_in_game(spark, d):
    """Names of trusted pairs that no product has."""
    named = _t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return dimension.only_in_game(named.where("p_partkey % 3 = 0").withColumnRenamed("name", "english"), named.where("p_partkey % 2 = 0"), ascii_only=True)
