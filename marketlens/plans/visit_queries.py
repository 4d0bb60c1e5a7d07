"""Registered queries of cookies, addresses, walls, market checks, cached sources and fingerprints, applied to columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import market, visits
from marketlens.plans.queries import _t, query

_ATTRIBUTES = ", ".join(f"'{a}'" for a in visits.COOKIE_ATTRIBUTES)
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Path=/; Secure' ELSE 'Sid=' || doc_id || '; PATH=/; ' || coalesce(source, '') || ' = ' || coalesce(lang, '') || ';HttpOnly; =x;Sid=a=b; note=' || coalesce(text, '') END AS raw FROM documents),
p AS (SELECT doc_id, raw, list_filter(list_transform(list_filter(string_split(raw, ';'), lambda x: contains(x, '=')), lambda x: struct_pack(name := trim(split_part(x, '=', 1), {_WS}), value := trim(substr(x, position('=' IN x) + 1), {_WS}))), lambda p: p.name != '' AND lower(p.name) NOT IN ({_ATTRIBUTES})) AS pairs FROM h)
SELECT doc_id, CASE WHEN trim(raw, {_WS}) = '' OR len(pairs) > 0 THEN len(pairs)::INTEGER END AS n_pairs, CASE WHEN trim(raw, {_WS}) = '' OR len(pairs) > 0 THEN array_to_string(list_transform(pairs, lambda p: p.name || '=' || p.value), '|') END AS told FROM p""")
def q06_cookie_pairs(spark, d):
    """Cookies of headers; one that has none is told by nulls."""
    k, of = F.col("doc_id"), lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat(F.lit("Sid="), k.cast("string"), F.lit("; PATH=/; "), of("source"), F.lit(" = "), of("lang"), F.lit(";HttpOnly; =x;Sid=a=b; note="), of("text"))
    raw = F.when(k % 4 == 0, " ").when(k % 4 == 1, "Path=/; Secure").otherwise(whole)
    rows = _t(spark, d, "documents").select("doc_id", visits.cookie_pairs(raw, loud=False).alias("pairs"))
    told = F.array_join(F.transform("pairs", lambda p: F.concat(p["name"], F.lit("="), p["value"])), "|")
    return rows.select("doc_id", F.when(F.col("pairs").isNotNull(), F.size("pairs")).alias("n_pairs"), told.alias("told"))


@query("""WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 3 AS trades, lower(coalesce(text, '') || CASE turn % 5 WHEN 0 THEN ' Please SIGN in to view offers' WHEN 1 THEN ' Log in' WHEN 2 THEN ' LOGIN here' ELSE '' END) AS low FROM conversations),
s AS (SELECT *, contains(low, 'please sign in') AS wall, contains(low, 'sign in') OR contains(low, 'login') AS hint FROM r)
SELECT conv_id, turn, CASE WHEN wall OR trades = 0 AND hint THEN 'login_required' END AS code, CASE WHEN wall OR trades = 0 THEN 'B' ELSE 'A' END AS mode, wall OR trades = 0 AS blocked,
CASE WHEN wall THEN '需要登入 (Please sign in to view offers)' WHEN trades = 0 AND hint THEN '未偵測到成交數據或需要登入' WHEN trades = 0 THEN '無成交紀錄' END AS reason FROM s""")
def q17_recent_reads(spark, d):
    """What a view of finished trades is worth, by its words and what was read."""
    n = F.col("turn")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(n % 5 == 0, " Please SIGN in to view offers").when(n % 5 == 1, " Log in").when(n % 5 == 2, " LOGIN here").otherwise(""))
    return _t(spark, d, "conversations").select("conv_id", "turn", visits.recent_read(text, (F.col("conv_id") + n) % 3).alias("r")).select("conv_id", "turn", "r.*")


@query(r"""WITH o AS (SELECT o_orderkey, 'ring ' || o_custkey AS item, 'https://' || CASE WHEN o_orderkey % 11 = 0 THEN 'other.example' ELSE 'Shop.example' END || '/game/product/' || o_custkey || CASE WHEN o_orderkey % 6 = 1 THEN '/buying' WHEN o_orderkey % 6 = 2 THEN '/' ELSE '' END || '?p=1' AS t,
 'http://www.shop.example/game/product/' || CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END || CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/wiki' ELSE '/recent#top' END AS r,
 CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN 'the ring ' || o_custkey || ' here' ELSE 'ring' || o_custkey END AS title, 'a ring ' || o_custkey AS body,
 CASE o_orderstatus WHEN 'F' THEN 'PASSED' WHEN 'O' THEN 'BLOCKED' ELSE 'FAILED' END AS ts, CASE WHEN o_orderkey % 7 = 0 THEN 'BLOCKED' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'PASSED' END AS rs FROM orders),
u AS (SELECT *, nullif(regexp_extract(t, '^(?i:https?://(?:shop\.example|www\.shop\.example))/game/product/([^/?#]+)(?:/(recent|buying|wiki))?/?(?:[?#].*)?$', 1), '') AS tr, regexp_extract(t, '^(?i:https?://(?:shop\.example|www\.shop\.example))/game/product/([^/?#]+)(?:/(recent|buying|wiki))?/?(?:[?#].*)?$', 2) AS tx,
 nullif(regexp_extract(r, '^(?i:https?://(?:shop\.example|www\.shop\.example))/game/product/([^/?#]+)(?:/(recent|buying|wiki))?/?(?:[?#].*)?$', 1), '') AS rr, regexp_extract(r, '^(?i:https?://(?:shop\.example|www\.shop\.example))/game/product/([^/?#]+)(?:/(recent|buying|wiki))?/?(?:[?#].*)?$', 2) AS rx FROM o),
f AS (SELECT o_orderkey, '/game/product/' || rr AS root, list_filter([CASE WHEN rr IS NULL THEN 'product_page' END,
 CASE WHEN NOT (CASE WHEN title != '' THEN contains(' ' || title || ' ', ' ' || item || ' ') OR contains(' ' || item || ' ', ' ' || title || ' ') ELSE contains(' ' || body || ' ', ' ' || item || ' ') END) THEN 'item_match' END,
 CASE WHEN tr IS NULL OR rr IS NULL OR tr != rr THEN 'same_product' END, CASE WHEN tr IS NULL OR tx != '' THEN 'trading_view' END, CASE WHEN rr IS NULL OR rx != 'recent' THEN 'recent_view' END,
 CASE WHEN ts != 'PASSED' THEN 'trading_rows_ok' END, CASE WHEN rs IS NULL OR rs != 'PASSED' THEN 'recent_rows_ok' END, CASE WHEN ts = 'BLOCKED' OR coalesce(rs, '') = 'BLOCKED' THEN 'not_blocked' END], lambda x: x IS NOT NULL) AS bad FROM u)
SELECT o_orderkey, root, len(bad) = 0 AS passed, array_to_string(bad, ',') AS failed FROM f""")
def q34_market_checks(spark, d):
    """The eight checks of market reads that orders stand for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = c.cast("string")
    trading = F.concat(F.lit("https://"), F.when(k % 11 == 0, "other.example").otherwise("Shop.example"), F.lit("/game/product/"), name, F.when(k % 6 == 1, "/buying").when(k % 6 == 2, "/").otherwise(""), F.lit("?p=1"))
    recent = F.concat(F.lit("http://www.shop.example/game/product/"), F.when(k % 5 == 0, c + 1).otherwise(c).cast("string"), F.when(c % 4 == 0, "").when(c % 4 == 1, "/wiki").otherwise("/recent#top"))
    title = F.when(c % 3 == 0, "").when(c % 3 == 1, F.concat(F.lit("the Ring "), name, F.lit(" here"))).otherwise(F.concat(F.lit("ring"), name))
    address = lambda u: F.struct(*visits.product_address(u, ("shop.example", "www.shop.example"), "/game/product", ("recent", "buying", "wiki")))
    rows = _t(spark, d, "orders").select(
        "o_orderkey", T.words(F.concat(F.lit("Ring "), name)).alias("item"), T.words(title).alias("title"), T.words(F.concat(F.lit("a ring "), name)).alias("text"), address(trading).alias("t"), address(recent).alias("r"),
        F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "BLOCKED").otherwise("FAILED").alias("ts"), F.when(k % 7 == 0, "BLOCKED").when(k % 7 == 1, None).otherwise("PASSED").alias("rs"),
    )
    checks = visits.market_checks(*[F.col(x) for x in ("item", "title", "text", "t.root", "t.section", "ts", "r.root", "r.section", "rs")])
    out = rows.select("o_orderkey", F.col("r.root").alias("root"), *market.checks_summary(checks))
    return out.select("o_orderkey", "root", "passed", F.array_join("failed_checks", ",").alias("failed"))


@query("""WITH n AS (SELECT o_custkey AS source, arg_max(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, (epoch(o_orderdate), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END)) AS copied, max(epoch(o_orderdate)) AS made FROM orders GROUP BY o_custkey),
u AS (SELECT c_custkey AS source, copied, CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' END AS got, CASE WHEN 904608000 - made < 7776000 AND copied != '' THEN 'copy' WHEN c_nationkey % 3 = 0 AND c_mktsegment != '' THEN 'fetched' ELSE 'error' END AS used FROM customer LEFT JOIN n ON source = c_custkey)
SELECT source, CASE used WHEN 'copy' THEN copied WHEN 'fetched' THEN got END AS body, used FROM u""")
def q44_cached_sources(spark, d):
    """Young copies are used, old ones are fetched anew, and never fallen back on."""
    body = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    copies = _t(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("fetched_at"), body.alias("body"))
    c = _t(spark, d, "customer")
    third = F.col("c_nationkey") % 3
    fetched = c.where(third < 2).select(F.col("c_custkey").alias("source"), F.when(third == 0, F.col("c_mktsegment")).otherwise("").alias("body"))
    return visits.cached_or_fetched(c.select(F.col("c_custkey").alias("source")), copies, fetched, 904608000, 90 * visits.DAY)


@query("""SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity""")
def q47_same_states(spark, d):
    """Rows in the same state, found by its fingerprint."""
    fields = ("l_quantity", "l_returnflag", "l_linestatus")
    mark = visits.fingerprint({c: F.col(c) for c in fields})
    g = _t(spark, d, "lineitem").groupBy(mark.alias("mark")).agg(*[F.first(c).alias(c) for c in fields], F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))
    return g.select("l_returnflag", "l_linestatus", "l_quantity", "n", "first_order")
