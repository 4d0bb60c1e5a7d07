"""Registered queries of names and candidates: names of parts as the dimension, misread ones as the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import ledger, lru, names, pages
from marketlens.plans.queries import _SQL_LINES, _t, query

_LATIN = r"[A-Za-z][A-Za-z''’\- ]{2,}"


@query(rf"""WITH {_SQL_LINES}, b AS (SELECT doc_id, pos, regexp_replace(line, '[\[［].*$', '') AS bare FROM lines),
m AS (SELECT *, regexp_extract(bare, '^(.*?)(?:[%+:：]|[(（][A-Za-z]).*$', 1) AS front, regexp_matches(bare, '^.*?(?:[%+:：]|[(（][A-Za-z]).*[0-9]') AS marked FROM b),
n AS (SELECT doc_id, pos, marked, CASE WHEN NOT marked THEN bare WHEN length(regexp_replace(front, '\s+', '', 'g')) >= 4 THEN front END AS name FROM m),
r AS (SELECT doc_id, pos, regexp_extract_all(regexp_replace(name, '[^A-Za-z''’\- ]+', '', 'g'), '{_LATIN}') AS runs FROM n WHERE name IS NOT NULL),
k AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(lower(run), '[''’‘`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS piece FROM (SELECT doc_id, pos, unnest(runs) AS run FROM r))
SELECT doc_id, pos::INTEGER AS "at", piece, count(*) AS n FROM k WHERE length(piece) >= 6 GROUP BY ALL""")
def q24_name_pieces(spark, d):
    """Runs of letters of each line that may be names."""
    found = names.name_pieces(pages.page_lines(_t(spark, d, "documents"), "doc_id"), "doc_id", ascii_only=True)
    return found.where("not cjk").groupBy("doc_id", "at", "piece").agg(F.count("*").alias("n"))


_SQL_NAMES = r"""e AS (SELECT CASE WHEN min(p_partkey) % 5 = 0 THEN 'base' ELSE 'item' END AS kind, lower(p_type) AS name, trim(lower(p_type)) AS key FROM part GROUP BY p_type),
x AS (SELECT kind, name, key, length(key) AS size, CASE WHEN length(key) <= 5 THEN 1 ELSE 2 END + CASE WHEN kind = 'base' THEN 1 ELSE 0 END AS lim FROM e WHERE length(key) >= 6),
l AS (SELECT p_partkey AS id, 0 AS pos, replace(replace(lower(p_type), 'a', 'e'), 'o', 'u') AS piece FROM part UNION ALL SELECT p_partkey, 1, trim(lower(split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2))) FROM part WHERE p_partkey % 2 = 0),
p AS (SELECT id, pos, piece FROM l WHERE length(piece) >= 6),
d AS (SELECT DISTINCT piece FROM p), m AS (SELECT piece, kind, name, size, levenshtein(piece, key) AS distance FROM d, x WHERE abs(length(piece) - size) <= lim AND levenshtein(piece, key) <= lim AND (kind = 'base' OR levenshtein(piece, key) = 0 OR piece NOT IN (SELECT key FROM e WHERE kind = 'base'))),
f AS (SELECT id, kind, name, distance, distance * 100 - least(size, 40) AS score, piece AS matched, size, pos, row_number() OVER (PARTITION BY id, kind, name ORDER BY distance * 100 - least(size, 40), pos, piece) AS k FROM p JOIN m USING (piece)),
c0 AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY score, pos, name) AS rank FROM f WHERE k = 1),
c1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'item' THEN 0 ELSE 2 END, rank) AS ord FROM c0 WHERE rank <= 3),
c AS (SELECT *, bool_or(kind = 'item') OVER (PARTITION BY id) AS strong FROM c1)"""


def _found(spark, d, loose: bool = False):
    part = _t(spark, d, "part")
    entries = part.groupBy("p_type").agg(F.min("p_partkey").alias("k")).select(F.when(F.col("k") % 5 == 0, "base").otherwise("item").alias("kind"), F.lower("p_type").alias("name"), F.trim(F.lower("p_type")).alias("key"))
    first = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("pos"), F.translate(F.lower("p_type"), "ao", "eu").alias("line"))
    w = F.split(F.concat("p_type", F.lit("  ")), " ")
    more = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("pos"), F.lower(F.concat_ws(" ", w[0], w[1])).alias("line"))
    pieces = names.name_pieces(first.unionByName(more), "id", ascii_only=True)
    return pieces, names.closest_names(pieces, entries, "id", wide=loose, loose=loose)


@query(f"""WITH {_SQL_NAMES} SELECT id, ord::INTEGER AS ord, kind, name, distance::INTEGER AS distance, score::INTEGER AS score, matched, pos::INTEGER AS "at" FROM c WHERE NOT strong OR ord <= 3""")
def q22_candidates(spark, d):
    """Items and bases that misread names may be, three at most."""
    return names.candidates(_found(spark, d)[1], "id").select("id", "ord", "kind", "name", "distance", "score", "matched", "at")


@query(f"""WITH {_SQL_NAMES}, q AS (SELECT id, ord, kind, name, size, CASE id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'blue' END AS quality FROM c WHERE NOT strong OR ord <= 3),
g AS (SELECT id, arg_min(name, ord) AS name, arg_min(kind, ord) AS kind, arg_min(quality, ord) AS quality, count(*) AS n, arg_min(name, ord) FILTER (WHERE kind = 'base') AS base FROM q GROUP BY id)
SELECT id, name, kind, base, CASE WHEN kind = 'base' THEN n < 3 ELSE base IS NULL OR coalesce(quality = 'gold', false) END AS confident FROM g""")
def q25_decisions(spark, d):
    """Which first candidates need no question."""
    k = F.col("id")
    return names.decided(names.candidates(_found(spark, d)[1], "id"), "id", F.when(k % 3 == 0, "gold").when(k % 3 == 1, "blue"))


@query(f"""WITH {_SQL_NAMES}, x2 AS (SELECT kind, name, key, size, greatest(CASE WHEN size <= 5 THEN 1 ELSE 2 END + 1, round(size * 0.4)) AS lim FROM x),
m2 AS (SELECT piece, kind, name, size, levenshtein(piece, key) AS distance FROM d, x2 WHERE abs(length(piece) - size) <= lim AND levenshtein(piece, key) <= lim AND (kind = 'base' OR levenshtein(piece, key) = 0 OR piece NOT IN (SELECT key FROM e WHERE kind = 'base'))),
f2 AS (SELECT id, kind, name, distance, distance * 100 - least(size, 40) AS score, piece AS matched, size, pos, row_number() OVER (PARTITION BY id, kind, name ORDER BY distance * 100 - least(size, 40), pos, piece) AS k FROM p JOIN m2 USING (piece)),
u1 AS (SELECT id, kind, name, distance, score, matched, size, pos, ord FROM c WHERE NOT strong OR ord <= 3),
u2 AS (SELECT id, kind, name, distance, score, matched, size, pos, 1000 + row_number() OVER (PARTITION BY id ORDER BY score, pos, name) AS ord FROM f2 WHERE k = 1 AND (id, name) NOT IN (SELECT (id, name) FROM u1)),
u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS ord FROM (SELECT * EXCLUDE ord, ord AS o FROM u1 UNION ALL SELECT * EXCLUDE ord, ord AS o FROM u2 WHERE ord <= 1005))
SELECT id, kind, name, distance::INTEGER AS distance, score::INTEGER AS score, matched, size::INTEGER AS size, pos::INTEGER AS "at", ord::INTEGER AS ord FROM u WHERE ord <= 5""")
def q22_possible_names(spark, d):
    """Up to five possible names, the last of them from a wider search."""
    first = names.candidates(_found(spark, d)[1], "id")
    return names.extended(first, _found(spark, d, loose=True)[1], "id")


@query("""WITH e AS (SELECT user_id, event_type AS name, row_number() OVER (ORDER BY ts, event_id) AS p FROM events),
u AS (SELECT *, lag(p) OVER w AS before, lag(name) OVER w AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p)),
d AS (SELECT u.p, count(DISTINCT x.user_id) AS others FROM u LEFT JOIN e x ON x.p > u.before AND x.p < u.p GROUP BY u.p),
i AS (SELECT u.*, sum(CASE WHEN before IS NULL OR prev != name OR others >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p) AS island FROM u JOIN d USING (p)),
g AS (SELECT user_id, island, count(*) AS n, max(p) AS used, arg_max(name, p) AS name FROM i GROUP BY user_id, island),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY island DESC) = 1)
SELECT user_id, name, least(n, 99)::INTEGER AS count FROM l QUALIFY row_number() OVER (ORDER BY used DESC) <= 10""")
def q29_memory(spark, d):
    """A memory of ten users: their last choices, and how often in a row each was made since the user was last pushed out."""
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("at"))
    return lru.remembered(e, "user_id", F.col("at"), most=10)


@query("""WITH z AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS key, p_brand || p_size AS chinese, p_name AS english FROM part),
t AS (SELECT DISTINCT substr(lower(p_type) || ' ' || p_name, 1 + p_partkey % 5, 1 + p_partkey % 4) AS typed FROM part),
m AS (SELECT typed, chinese, english, CASE WHEN starts_with(key, typed) THEN 0 ELSE 1 END AS rank FROM t JOIN z ON contains(key, typed) AND key != typed WHERE typed != ''),
r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY rank, length(chinese), chinese, english) AS rn FROM m) SELECT typed, chinese, english, rank, rn::INTEGER AS rn FROM r WHERE rn <= 5""")
def q22_suggested_by_part(spark, d):
    """Five names that begin with or contain what was typed."""
    key = F.concat(F.lower("p_type"), F.lit(" "), "p_name")
    part = _t(spark, d, "part")
    zh = part.select(key.alias("key"), F.concat("p_brand", F.col("p_size").cast("string")).alias("chinese"), F.col("p_name").alias("english")).distinct()
    typed = part.select(F.substr(key, (1 + F.col("p_partkey") % 5).cast("int"), (1 + F.col("p_partkey") % 4).cast("int")).alias("key"))
    return names.suggested_chinese(typed, zh)


@query("""WITH c AS (SELECT o_custkey, 'n' || o_orderkey % 7 AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'item' END AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey) AS ord FROM orders),
u AS (SELECT o_custkey, name, min(kind) AS kind, min(ord) AS ord FROM c GROUP BY ALL), o AS (SELECT o_custkey, name, kind, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS ord FROM u),
h AS (SELECT c_custkey AS o_custkey, 'n' || c_custkey % 9 AS hit, c_custkey % 4 + 1 AS times FROM customer WHERE c_custkey % 3 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)),
m AS (SELECT o.o_custkey, o.name, CASE WHEN name = hit AND ord > 1 THEN 0 ELSE ord END AS ord, CASE WHEN name = hit THEN times END AS learned, coalesce(name = hit AND ord > 1, false) AS promoted FROM o LEFT JOIN h USING (o_custkey)
  UNION ALL SELECT o_custkey, hit, 0, times, true FROM h WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = h.o_custkey AND o.name = h.hit))
SELECT o_custkey, name, learned::BIGINT AS learned, promoted, row_number() OVER (PARTITION BY o_custkey ORDER BY ord, name)::INTEGER AS ord FROM m""")
def q29_learned_first(spark, d):
    """Candidates with the remembered choice in front."""
    k = F.col("o_orderkey")
    c = _t(spark, d, "orders").groupBy("o_custkey", F.concat(F.lit("n"), (k % 7).cast("string")).alias("name")).agg(F.min(F.when(k % 2 == 0, "base").otherwise("item")).alias("kind"))
    rows = c.withColumn("ord", F.row_number().over(ledger.Window.partitionBy("o_custkey").orderBy("name")))
    asked = _t(spark, d, "customer").where("c_custkey % 3 = 0").join(rows.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).alias("at"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("piece"))
    memory = asked.select("piece", F.concat(F.lit("n"), (F.col("o_custkey") % 9).cast("string")).alias("name"), F.lit("item").alias("kind"), (F.col("o_custkey") % 4 + 1).alias("count"))
    return names.learned_first(rows, memory, asked, "o_custkey").drop("kind")


@query("""WITH z AS (SELECT n_nationkey, '名 ' || chr(19968 + n_nationkey) || '·' || chr(19968 + n_nationkey % 5) AS chinese, lower(n_name) AS english FROM nation),
t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '名' || chr(19968 + c_nationkey) || chr(19968 + c_nationkey % 5) WHEN 1 THEN '無' || c_nationkey WHEN 2 THEN upper(n_name) || '!' ELSE ' ' END AS typed, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 2 THEN n_name END AS query, c_custkey % 4 IN (0, 1) AS translated, CASE c_custkey % 4 WHEN 1 THEN 'untranslated' WHEN 3 THEN 'empty' END AS problem FROM t""")
def q20_translated(spark, d):
    """What was typed, translated or in the product's spelling, or why not."""
    nation = _t(spark, d, "nation")
    glyph = lambda c: F.concat(*[F.decode(F.unhex(F.upper(F.lpad(F.hex(c + 19968), 4, "0"))), "UTF-16BE")])
    k = F.col("n_nationkey")
    zh, _ = names.translations(nation.select(F.concat(F.lit("名 "), glyph(k), F.lit("·"), glyph(k % 5)).alias("chinese"), F.lower("n_name").alias("english")), True)
    c = F.col("c_custkey")
    typed = F.when(c % 4 == 0, F.concat(F.lit("名"), glyph(k), glyph(k % 5))).when(c % 4 == 1, F.concat(F.lit("無"), k.cast("string"))).when(c % 4 == 2, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(" ")
    rows = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == k).select("c_custkey", typed.alias("typed"))
    return names.resolved(rows, "typed", zh, nation.select(F.col("n_name").alias("name")), True).drop("typed")
