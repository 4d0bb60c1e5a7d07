"""Registered queries of scan sessions, settled pages, stores, published tables and provisional records, applied to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import pages, scan, visits
from marketlens.plans.queries import _t, query
from marketlens.sources import publish, stores
from marketlens.storage import Scratch
from marketlens.streaming import events


@query("""WITH r AS (SELECT user_id || ' ' || ts::DATE AS page, epoch_us(ts) // 1000 AS ts, coalesce(event_type, '') AS text FROM events),
c AS (SELECT *, min(ts) OVER (PARTITION BY page) + 36000000 AS cap, lag(text) OVER (PARTITION BY page ORDER BY ts, text) AS before FROM r),
d AS (SELECT page, ts, text, cap, row_number() OVER w - 1 AS n, lead(ts) OVER w AS following FROM c WHERE before IS NULL OR before != text WINDOW w AS (PARTITION BY page ORDER BY ts, text)),
o AS (SELECT *, ts + 7200000 < cap AND coalesce(following >= ts + 7200000, true) AS quiet FROM d),
g AS (SELECT page, min(cap) AS cap, min(ts) FILTER (quiet) AS told, arg_min(text, n) FILTER (quiet) AS text, min(n) FILTER (quiet) AS n, arg_max(text, n) FILTER (ts < cap) AS last_text, max(n) FILTER (ts < cap) AS last_n FROM o GROUP BY page)
SELECT page, coalesce(told + 7200000, cap) AS ts, coalesce(text, last_text) AS text, told IS NOT NULL AS settled, coalesce(n, last_n) AS changes FROM g""")
def q48_settled_pages(spark, d):
    """When each user's day first was quiet for two hours, or its cap of ten."""
    reads = _t(spark, d, "events").select(F.concat_ws(" ", "user_id", F.to_date("ts").cast("string")).alias("page"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("text"))
    return pages.settled_pages(reads, 7_200_000, 36_000_000)


@query()
def q40_fallback_reads(spark, d):
    """When a slow reader runs, each user's events as frames and outcomes of reads."""
    k = F.col("event_id")
    e = _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session"), (k * 40).alias("ts"), F.when(k % 7 == 0, "rescued").otherwise("frame").alias("event"), F.col("event_type").alias("hash"),
        F.rpad(F.floor(F.col("value") / 40).cast("string"), 16, "0").alias("key"), (k % 19 == 0).alias("panel"), (k % 23 == 0).alias("busy"),
    )
    return scan.fallback_reads(e)


@query("""WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS session, event_id, event_id * 30 AS ts, ['set', 'get', 'expire', 'get', 'del', 'set', 'get'][event_id % 7 + 1] AS command, event_type FROM events),
r AS (SELECT session, ts, command, event_type AS given, ts + CASE WHEN command = 'expire' OR event_id % 3 = 0 THEN event_id % 50 * 60 + 1 END AS until, CASE WHEN command = 'expire' THEN ['NX', 'XX', 'GT', 'LT'][event_id // 7 % 4 + 1] END AS cond,
  row_number() OVER (PARTITION BY session ORDER BY ts) AS n FROM c),
s AS (
  SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS ts, NULL::VARCHAR AS value, NULL::BIGINT AS ends, NULL::VARCHAR AS result FROM r
  UNION ALL
  SELECT session, n, ts, CASE command WHEN 'set' THEN given WHEN 'del' THEN NULL ELSE value END, CASE WHEN command = 'set' THEN until WHEN command = 'del' THEN NULL WHEN command = 'expire' AND done THEN until ELSE ends END,
    CASE command WHEN 'get' THEN value WHEN 'set' THEN '1' ELSE CASE WHEN done THEN '1' ELSE '0' END END
  FROM (SELECT *, value IS NOT NULL AND (command = 'del' OR CASE cond WHEN 'NX' THEN ends IS NULL WHEN 'XX' THEN ends IS NOT NULL WHEN 'GT' THEN coalesce(until > ends, false) ELSE coalesce(until < ends, true) END) AS done
    FROM (SELECT r.session, r.n, r.ts, command, given, until, cond, CASE WHEN coalesce(s.ends <= r.ts, false) THEN NULL ELSE s.value END AS value, CASE WHEN coalesce(s.ends <= r.ts, false) THEN NULL ELSE s.ends END AS ends
      FROM s JOIN r ON r.session = s.session AND r.n = s.n + 1)))
SELECT session, ts, result FROM s WHERE n > 0""")
def q37_expiring_keys(spark, d):
    """A store's commands in order, each user's events as those of one key."""
    k = F.col("event_id")
    command = F.element_at(F.array(*[F.lit(c) for c in ("set", "get", "expire", "get", "del", "set", "get")]), (k % 7 + 1).cast("int"))
    seconds = F.when((command == "expire") | (k % 3 == 0), k % 50 * 60 + 1)
    condition = F.when(command == "expire", F.element_at(F.array(*[F.lit(c) for c in ("NX", "XX", "GT", "LT")]), (F.floor(k / 7) % 4 + 1).cast("int")))
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), (k * 30).alias("ts"), command.alias("command"), F.col("event_type").alias("value"), seconds.alias("seconds"), condition.alias("condition"))
    return visits.expiring_keys(rows)


@query("""SELECT 'code:' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'again ' ELSE '' END || c_name AS name, c_nationkey::VARCHAR AS uses FROM customer
WHERE CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 != 0 ELSE c_custkey % 5 != 0 END""")
def q37_store_scan(spark, d):
    """Records of a store, from a saved scan that gives some keys twice."""
    k = F.col("c_custkey")
    entry = lambda name, kept: F.struct(F.concat(F.lit("code:"), k.cast("string")).alias("key"), F.struct(name.alias("name"), F.when(kept, F.col("c_nationkey").cast("string")).alias("limit")).alias("fields"))
    c = _t(spark, d, "customer")
    first = c.select(F.lit(1).alias("cursor"), entry(F.col("c_name"), k % 5 != 0).alias("e"))
    again = c.where(k % 3 == 0).select(F.lit(2).alias("cursor"), entry(F.concat(F.lit("again "), "c_name"), k % 7 != 0).alias("e"))
    folder = f"{Scratch(spark, 'store').root}/scan"
    first.unionByName(again).select(F.to_json(F.struct("cursor", "e.key", "e.fields"))).write.text(folder)
    stores.register(spark)
    found = stores.records(spark.read.format("store_scan").load(folder))
    return found.select("key", F.col("fields")["name"].alias("name"), F.col("fields")["limit"].alias("uses"))


@query("""WITH r AS (SELECT page_id, 'page/' || page_id AS path, CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status,
  CASE WHEN page_id % 4 = 3 THEN html WHEN page_id % 4 = 2 THEN '{"url":' || to_json(url) || '}' ELSE coalesce(html, '') END AS body FROM pages WHERE url IS NOT NULL)
SELECT path, status, CASE WHEN page_id % 4 = 2 THEN json_extract_string(body, '$.url') END AS url, CASE WHEN page_id % 4 != 2 THEN substr(coalesce(body, ''), 1, 300) END AS head FROM r""")
def q02_saved_replies(spark, d):
    """Replies of a site, read from where they were saved: the JSON of those that succeeded, the beginning of the others."""
    k = F.col("page_id")
    body = F.when(k % 4 == 2, F.to_json(F.struct("url"))).otherwise(F.col("html"))
    status = F.when(k % 4 == 0, 404).when(k % 4 == 1, 503).otherwise(200)
    folder = f"{Scratch(spark, 'replies').root}/saved"
    rows = _t(spark, d, "pages").where("url IS NOT NULL").select(F.concat(F.lit("page/"), k.cast("string")).alias("path"), status.alias("status"), body.alias("body"))
    rows.select(F.to_json(F.struct("path", "status", "body"))).write.text(folder)
    stores.register(spark)
    return spark.read.format("saved_replies").load(folder).select("path", "status", F.get_json_object("body", "$.url").alias("url"), "head")


@query("""SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice::DECIMAL(20, 2))::DOUBLE AS total FROM orders GROUP BY o_orderpriority""")
def q34_published(spark, d):
    """A report as its readers see it: published with a verification that passed, then replaced by a newer one."""
    orders = _t(spark, d, "orders")
    report = orders.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total"))
    checks = orders.groupBy("o_orderstatus").agg((F.count_if(F.col("o_orderkey").isNull()) == 0).alias("passed"))
    folder = f"{Scratch(spark, 'report').root}/report"
    publish.publish(checks, {"report": report.limit(0)}, folder)
    publish.publish(checks, {"report": report}, folder)
    return publish.Published(spark, folder).table("report")


@query("""WITH c AS (SELECT o_custkey AS id, o_orderpriority AS name, o_orderkey % 7 = 0 AS removed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 3 >= 1)
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT id FROM c) UNION ALL SELECT id, name FROM c WHERE n = 1 AND NOT removed""")
def q49_upserted(spark, d):
    """Records after a batch of provisional and final ones, with those of a cleared run refused."""
    now = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    k = F.col("o_orderkey")
    changes = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), (k % 7 == 0).alias("removed"), (k % 3).alias("generation"), k.alias("at"))
    return events.upsert(now, changes, "id", F.col("at"), least=1)
