"""Registered queries of listings and of the item dimension, applied to columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import dimension, listing
from marketlens.plans.queries import _t, query
from marketlens.sources import publish

_RUNES = ["Ist", "Ber Rune", "El", "Zod", "Um Rune", "Nope", "Lem"]
_SQL_RUNES = "[" + ", ".join(f"'{r}'" for r in _RUNES) + "]"
_ORDER = "[" + ", ".join(f"'{r}'" for r in listing.RUNES) + "]"


@query(f"""SELECT l_orderkey, l_linenumber, {_SQL_RUNES}[(l_partkey % 7 + 1)::INT] AS rune, coalesce(list_position({_ORDER}, regexp_replace({_SQL_RUNES}[(l_partkey % 7 + 1)::INT], ' Rune$', '')) - 1, 33)::INTEGER AS place FROM lineitem""")
def q35_rune_order(spark, d):
    """Runes in the game's order."""
    rune = F.element_at(F.array(*[F.lit(r) for r in _RUNES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rune.alias("rune")).withColumn("place", listing.rune_rank(F.col("rune")))


def _forms(spark, d):
    k = F.col("o_orderkey")
    group = lambda i: F.struct(F.when((k + i) % 5 != 0, F.concat(F.lit("r"), ((k + i) % (3 + i)).cast("string"))).alias("rune"), F.when((k + i) % 7 != 0, ((k + i) % 4).cast("string")).otherwise("1.5").alias("quantity"))
    prices = F.slice(F.array(*[group(i) for i in range(4)]), 1, (k % 5).cast("int"))
    return _t(spark, d, "orders").select(k.alias("form_id"), (k % 6 == 0).alias("make_offer"), prices.alias("prices"), "o_custkey", "o_orderpriority")


_SQL_FORMS = """g AS (SELECT o_orderkey AS form_id, o_custkey, o_orderpriority, o_orderkey % 6 = 0 AS make_offer, i, CASE WHEN (o_orderkey + i) % 5 != 0 THEN 'r' || (o_orderkey + i) % (3 + i) END AS rune, CASE WHEN (o_orderkey + i) % 7 != 0 THEN ((o_orderkey + i) % 4)::VARCHAR ELSE '1.5' END AS quantity FROM orders, range(4) t(i) WHERE i < o_orderkey % 5),
v AS (SELECT *, quantity::DOUBLE >= 1 AND quantity::DOUBLE = floor(quantity::DOUBLE) AS whole, row_number() OVER (PARTITION BY form_id, rune ORDER BY i) > 1 AS again FROM g),
p AS (SELECT form_id, count(*) FILTER (WHERE rune IS NOT NULL AND whole) AS good, count(*) AS n, arg_min(CASE WHEN rune IS NULL THEN '第 ' || (i + 1) || ' 組還沒選符文（不要的話按 ✕ 刪除）' WHEN NOT whole THEN '第 ' || (i + 1) || ' 組的數量要是 1 以上的整數' WHEN again THEN '第 ' || (i + 1) || ' 組和前面的組選了同一個符文' END, i) FILTER (WHERE rune IS NULL OR NOT whole OR again) AS wrong FROM v GROUP BY form_id)"""


@query(f"""WITH {_SQL_FORMS}, o AS (SELECT o_orderkey AS form_id, o_orderkey % 6 = 0 AS make_offer, o_custkey, o_orderpriority, coalesce(good, 0) AS good, coalesce(n, 0) AS n, wrong FROM orders LEFT JOIN p ON form_id = o_orderkey),
q AS (SELECT *, CASE WHEN make_offer THEN '' WHEN good = 0 THEN '請選擇想換的符文和數量，或勾「接受出價」' ELSE coalesce(wrong, '') END AS price FROM o)
SELECT form_id, CASE WHEN o_custkey % 11 = 0 THEN '「' || o_orderpriority || '」不在 Traderie 的物品表裡，無法上架' WHEN o_custkey % 13 = 0 THEN 'Traderie 沒有這件物品的資料' WHEN o_custkey % 17 = 0 THEN '請選擇品質（黃裝／藍裝／白裝）' WHEN o_custkey % 19 = 0 THEN '這些條件還沒有數值：a、b' WHEN n > 3 THEN '最多 3 組' WHEN price != '' THEN price WHEN form_id % 10 = 0 THEN '數量要是 1 以上的整數' ELSE '' END AS blocker FROM q""")
def q35_listing_blockers(spark, d):
    """What keeps a listing form from being posted."""
    c, k = F.col("o_custkey"), F.col("form_id")
    blank = F.when(c % 19 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    found = listing.listing_blocker(F.when(c % 11 != 0, "x"), F.col("o_orderpriority"), c % 13 != 0, F.when(c % 17 == 0, "").otherwise("rare"), blank, F.col("prices"), F.col("make_offer"), (k % 10).cast("string"))
    return _forms(spark, d).select("form_id", found.alias("blocker"))


@query(f"""WITH {_SQL_FORMS} SELECT form_id, (row_number() OVER (PARTITION BY form_id ORDER BY i) - 1)::INTEGER AS "group", CASE WHEN rune != 'r3' THEN (100 + substr(rune, 2)::INT)::VARCHAR END AS id, (quantity::DOUBLE)::BIGINT::VARCHAR AS quantity FROM v WHERE NOT make_offer AND rune IS NOT NULL AND whole""")
def q35_price_items(spark, d):
    """Complete price groups as posted."""
    ids = spark.range(3).union(spark.range(4, 6)).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rune"), (F.col("id") + 100).alias("id"))
    return listing.price_items(_forms(spark, d), ids)


@query("""SELECT o_orderkey, json_extract_string(b, '$.amount') AS amount, json_extract_string(b, '$.item') AS item, json_extract_string(b, '$.makeOffer') AS offer, len(json_keys(b)) AS n_keys FROM (SELECT o_orderkey, json_object('acceptListingPrice', false, 'all', false, 'captcha', '', 'captchaManaged', false, 'currencyGroupPrices', [], 'diy', false, 'endTime', NULL, 'free', false, 'item', o_custkey::VARCHAR, 'itemMode', NULL, 'itemType', o_orderpriority, 'makeOffer', o_orderkey % 2 = 0, 'needMaterials', false, 'offerBells', false, 'offerNmt', false, 'offerWishlist', false, 'offerWishlistId', '', 'selling', true, 'standingListing', false, 'stockListing', false, 'touchTrading', false, 'wishlist', '', 'amount', (o_orderkey % 9 + 1)::VARCHAR, 'properties', [], 'items', []) AS b FROM orders)""")
def q35_listing_bodies(spark, d):
    """Listing bodies, read back."""
    none = F.array().cast("array<string>")
    body = listing.listing_body(F.col("o_custkey").cast("string"), F.lit(None).cast("string"), F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 9 + 1).cast("string"), none, none)
    rows = _t(spark, d, "orders").select("o_orderkey", body.alias("b"))
    read = lambda k: F.get_json_object("b", f"$.{k}")
    return rows.select("o_orderkey", read("amount").alias("amount"), read("item").alias("item"), read("makeOffer").alias("offer"), F.size(F.json_object_keys("b")).cast("long").alias("n_keys"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 422 WHEN 3 THEN 400 WHEN 4 THEN 500 ELSE 200 END AS status, CASE event_id % 8 WHEN 2 THEN '{"message": "Captcha needed"}' WHEN 3 THEN '{"message": "bad"}' WHEN 4 THEN 'oops' WHEN 5 THEN '{"error": "limit"}' WHEN 6 THEN '{"listing": {"id": 12}}' ELSE '{"id": "77"}' END AS body FROM events)
SELECT event_id, CASE WHEN status IS NULL THEN 'Traderie 沒有回應' WHEN status = 401 THEN 'Traderie 要求登入或拒絕了這次上架（HTTP 401）：請在 Traderie 登入後再試' WHEN status = 422 THEN 'Traderie 要求驗證碼，無法代為上架' WHEN status != 200 THEN 'Traderie 回覆 HTTP ' || status || '：' || body WHEN event_id % 8 = 5 THEN 'Traderie 拒絕了這次上架：limit' ELSE '' END AS reason,
CASE event_id % 8 WHEN 6 THEN '12' WHEN 7 THEN '77' WHEN 0 THEN '77' WHEN 1 THEN '77' END AS id, event_id % 3 = 0 AND event_id % 5 != 0 AS captcha, CASE WHEN event_id % 4 < 2 THEN CASE event_id % 4 WHEN 0 THEN 'pc' ELSE 'xbox' END ELSE 'pc' END AS platform FROM r""")
def q35_replies(spark, d):
    """What a site's replies mean."""
    k = F.col("event_id")
    status = F.when(k % 8 == 0, None).when(k % 8 == 1, 401).when(k % 8 == 2, 422).when(k % 8 == 3, 400).when(k % 8 == 4, 500).otherwise(200)
    body = F.when(k % 8 == 2, '{"message": "Captcha needed"}').when(k % 8 == 3, '{"message": "bad"}').when(k % 8 == 4, "oops").when(k % 8 == 5, '{"error": "limit"}').when(k % 8 == 6, '{"listing": {"id": 12}}').otherwise('{"id": "77"}')
    captcha = listing.captcha_required(F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("LISTINGS:CAPTCHA"))).otherwise(F.array(F.lit("a"))), k % 5 == 0)
    saved = F.element_at(F.array(F.lit("pc"), F.lit("xbox"), F.lit("wii"), F.lit("")), (k % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", listing.reply_reason(status, body).alias("reason"), listing.listing_id(body).alias("id"), captcha.alias("captcha"), listing.defaulted(saved, ("pc", "xbox", "switch"), "pc").alias("platform"))


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber) AS sent FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_filter(['one', 'three', 'five'], lambda x, i: NOT list_contains(sent, 2 * i - 1)), ',') AS missing FROM s""")
def q35_missing_required(spark, d):
    """Required properties that a listing lacks."""
    need = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in ((1, "one"), (3, "three"), (5, "five"))])
    s = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("sent"))
    return s.select("l_orderkey", F.array_join(listing.missing_required(need, F.col("sent")), ",").alias("missing"))


_SQL_BOOK = """b AS (SELECT c_custkey AS page, c_custkey % 4 AS kind, '名' || chr(19968 + (c_custkey % 900)::INT) AS zh, CASE WHEN c_custkey % 9 = 0 THEN 'X9_' ELSE 'Sword of ' || c_mktsegment END AS en FROM customer)"""


@query(f"""WITH {_SQL_BOOK} SELECT page, CASE kind WHEN 0 THEN 0 ELSE 1 END::INTEGER AS pos, zh AS chinese, en AS english FROM b WHERE kind < 3 AND en NOT LIKE 'X9%'""")
def q27_name_pairs(spark, d):
    """Name pairs of pages in three layouts; a name that is none gives no pair."""
    k = F.col("c_custkey")
    glyph = F.decode(F.unhex(F.lpad(F.hex(19968 + k % 900), 4, "0")), "UTF-16BE")
    zh, en = F.concat(F.lit("名"), glyph), F.when(k % 9 == 0, "X9_").otherwise(F.concat(F.lit("Sword of "), "c_mktsegment"))
    lines = F.when(k % 4 == 0, F.array(F.concat(zh, F.lit(" ("), en, F.lit(")")), F.lit("note"))).when(k % 4 == 1, F.array(F.lit("note"), zh, F.concat(F.lit("("), en, F.lit(")")))).when(k % 4 == 2, F.array(F.lit("note"), zh, en, F.lit("#7"))).otherwise(F.array(F.lit("note"), zh, en, F.lit("level 7!")))
    rows = _t(spark, d, "customer").select(k.alias("page"), F.posexplode(lines).alias("pos", "line"))
    return dimension.name_pairs(rows, "page")


@query("""WITH n AS (SELECT n_nationkey AS page, replace(n_name, '_', ' ') AS n_name, '甲' || chr(19968 + n_nationkey) AS a, '乙' || chr(19968 + n_nationkey) AS b FROM nation)
SELECT page, 1 AS pos, a AS chinese, n_name AS english FROM n UNION ALL SELECT page, CASE WHEN page % 2 = 0 THEN 3 ELSE 2 END, b, n_name FROM n""")
def q27_table_pairs(spark, d):
    """Old and new names of translation tables; tier words and titles are none."""
    k = F.col("n_nationkey")
    glyph = F.decode(F.unhex(F.lpad(F.hex(19968 + k), 4, "0")), "UTF-16BE")
    a, b, en = F.concat(F.lit("甲"), glyph), F.concat(F.lit("乙"), glyph), F.replace("n_name", F.lit("_"), F.lit(" "))
    lines = F.when(k % 2 == 0, F.array(en, a, F.lit("精英"), b, F.lit("套裝標題"), F.lit("#1"), F.lit("孤立"))).otherwise(F.array(en, a, b, F.lit("標題"), F.lit("12"), F.lit("孤立")))
    return dimension.table_pairs(_t(spark, d, "nation").select(k.cast("long").alias("page"), F.posexplode(lines).alias("pos", "line")), "page").withColumn("page", F.col("page").cast("int"))


_KEY = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '^the ', '')"


@query(f"""WITH p AS (SELECT p_name || ' ' || p_partkey % 40 AS name, CASE WHEN p_partkey % 50 = 0 THEN 'Bad_' || p_partkey ELSE 'slug-' || p_partkey % 190 END AS slug, p_brand AS category FROM part), n AS (SELECT '名' || CASE WHEN p_partkey % 30 = 0 THEN ' 1' ELSE '' END || p_brand AS chinese, CASE WHEN p_partkey % 20 = 0 THEN 'nothing' ELSE p_name || ' ' || p_partkey % 40 END AS english FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_name || ' ' || p_partkey % 40 AS name FROM part WHERE p_partkey % 25 = 0 UNION ALL SELECT 'no base'), k AS (SELECT *, {_KEY.format("name")} AS key FROM p), t AS (SELECT DISTINCT {_KEY.format("english")} AS key FROM n),
c AS (SELECT category, count(*) AS total, count(t.key) AS named FROM k LEFT JOIN t ON t.key = k.key GROUP BY category), bn AS (SELECT name, any_value(category) AS category FROM p GROUP BY name)
SELECT 'missing category' AS rule, 'Brand#99' AS what UNION ALL SELECT 'few products', category FROM c WHERE category IN (SELECT min(category) FROM c UNION ALL SELECT max(category) FROM c) AND total < 100000
UNION ALL SELECT 'low coverage', category FROM c WHERE named / total < 0.5 UNION ALL SELECT 'duplicate key', key FROM k GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'bad slug', slug FROM p WHERE slug LIKE 'Bad%' UNION ALL SELECT 'repeated slug', slug FROM p GROUP BY slug HAVING count(*) > 1
UNION ALL SELECT 'noise key', chinese FROM n WHERE regexp_matches(chinese, '\\s|[0-9]') UNION ALL SELECT 'no such product', chinese FROM n WHERE english = 'nothing' UNION ALL SELECT 'footer noise', n_name || CASE WHEN n_nationkey % 3 = 0 THEN '7' ELSE '' END FROM nation WHERE n_nationkey % 3 = 0 OR lower(n_name) = (SELECT min(lower(n_name)) FROM nation) OR regexp_matches(n_name, '[0-9]')
UNION ALL SELECT 'no such base', 'no base'""")
def q28_audit(spark, d):
    """All rules of the dimension audit."""
    part, nation = _t(spark, d, "part"), _t(spark, d, "nation")
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), (k % 40).cast("string"))
    products = part.select(name.alias("name"), F.when(k % 50 == 0, F.concat(F.lit("Bad_"), k.cast("string"))).otherwise(F.concat(F.lit("slug-"), (k % 190).cast("string"))).alias("slug"), F.col("p_brand").alias("category"))
    pairs = part.where(k % 2 == 0).select(F.concat(F.lit("名"), F.when(k % 30 == 0, " 1").otherwise(""), "p_brand").alias("chinese"), F.when(k % 20 == 0, "nothing").otherwise(name).alias("english"))
    bases = part.where(k % 25 == 0).select(name.alias("name")).union(spark.createDataFrame([("no base",)], "name string"))
    ends = part.agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).select(F.explode(F.array("a", "b", F.lit("Brand#99"))).alias("category"), F.lit(100000).alias("least"))
    floors = part.select(F.col("p_brand").alias("category"), F.lit(0.5).alias("least")).distinct()
    least = nation.agg(F.min(F.lower("n_name"))).first()[0]
    game_only = nation.select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "7").otherwise("")).alias("name"))
    brands = tuple(r[0] for r in part.select("p_brand").distinct().collect())
    return dimension.audit(products, pairs, bases, game_only, ends, floors, brands, footer=(least,), ascii_only=True)


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'now' ELSE 'then' END AS generated_at FROM part""")
def q28_stamps(spark, d):
    """Stamps that only changed or new content moves."""
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    before = part.where(k % 7 != 0).select("p_partkey", F.when(k % 3 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("p_name"), F.lit("then").alias("generated_at"))
    return dimension.stamped(part, before, "p_partkey", ["p_name"], F.lit("now"))


@query("""SELECT p_partkey, '| ' || p_name || ' | ' || CASE WHEN p_size % 5 = 0 THEN '—' ELSE 'a\\|b ' || p_size END || ' |' AS value FROM part""")
def q09_markdown_rows(spark, d):
    """Rows of a Markdown table."""
    part = _t(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("a|b\n"), F.col("p_size").cast("string"))).otherwise("").alias("note"))
    return part.select("p_partkey", publish.markdown_line(["p_name", "note"]).alias("value"))
