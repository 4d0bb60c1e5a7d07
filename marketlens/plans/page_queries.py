"""Registered queries over pages that are written from the tables, so their SQL is what was written, not another parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import pages
from marketlens.plans.queries import _t, query


def _page(rows: DataFrame, key: str, order: str, lines: list[Column], head: str, tail: str) -> DataFrame:
    """One page per ``key``: ``head``, the lines of its rows in order (null ones left out), ``tail``."""
    block = F.concat_ws("\n", *lines)
    blocks = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("bs"))
    return blocks.select(key, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit(tail)).alias("text"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def listing_pages(spark, d) -> DataFrame:
    """Each customer's orders as a page of listing cards."""
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    lines = [
        _text("seller ", F.col("o_custkey")), F.when(k % 13 != 0, _text("(", k % 100, "%)")), F.when(k % 3 == 0, "Pro"), _text(k % 9 + 1, " X Item ", F.col("o_orderpriority")),
        F.when(k % 4 == 0, "PC•").when(k % 4 == 1, "Xbox").when(k % 4 == 2, "Nintendo Switch"), F.when(F.col("o_orderstatus") == "F", "Hardcore•").when(F.col("o_orderstatus") == "O", "Softcore"),
        F.when(k % 5 == 0, "Non Ladder").when(k % 5 < 3, "Ladder•"), F.when(k % 2 == 0, _text("+", k % 200, " Defense")), F.when(k % 7 == 0, "+2 to All Skills"), F.when(k % 6 == 0, "Ethereal"),
        F.when(k % 10 == 0, "Make an Offer").otherwise("Trading For"), F.when(k % 10 != 0, "1 X Ist"), F.when(k % 4 == 1, _text("High Rune Value: ", k % 50)), _text(k % 28 + 1, " days ago"),
    ]
    return _page(o, "o_custkey", "o_orderkey", lines, "Marketplace\nApply this search for all\nold\nApply this search for all", "unfinished\nHELP\n2 X After\n3 days ago")


def _cards(spark, d, item: str | None) -> DataFrame:
    found = pages.page_cards(listing_pages(spark, d), "o_custkey", item)
    joined = [F.array_join(c, ";").alias(c) for c in ("stats", "affixes")]
    plain = ["o_custkey", "seller", "rating", "posted_time", "item_name", "platform", "mode", "ladder", "game_version", "is_ethereal", "is_unidentified", "defense", "ask", "high_rune_value"]
    return found.select(*plain, F.col("seg").cast("long").alias("seg"), *joined)


def _sql_cards(item: str | None) -> str:
    hit = f"contains(lower('item ' || o_orderpriority), '{item}')" if item else "true"
    return f"""WITH o AS (SELECT *, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seg, {hit} AS hit FROM orders)
SELECT o_custkey, seg, 'seller ' || o_custkey AS seller, CASE WHEN k % 13 != 0 THEN '(' || k % 100 || '%)' END AS rating, (k % 28 + 1) || ' days ago' AS posted_time,
{f"CASE WHEN hit THEN (k % 9 + 1) || ' X Item ' || o_orderpriority ELSE '{item}' END" if item else "'Item ' || o_orderpriority"} AS item_name,
CASE WHEN NOT hit THEN NULL WHEN k % 4 = 0 THEN 'PC' WHEN k % 4 = 1 THEN 'Xbox' WHEN k % 4 = 2 THEN 'Switch' END AS platform,
CASE WHEN NOT hit THEN NULL WHEN o_orderstatus = 'F' THEN 'Hardcore' WHEN o_orderstatus = 'O' THEN 'Softcore' END AS mode,
CASE WHEN NOT hit THEN NULL WHEN k % 5 = 0 THEN 'Non Ladder' WHEN k % 5 < 3 THEN 'Ladder' END AS ladder, NULL::VARCHAR AS game_version,
hit AND k % 6 = 0 AS is_ethereal, false AS is_unidentified, CASE WHEN hit AND k % 2 = 0 THEN k % 200 END::INTEGER AS defense,
CASE WHEN NOT hit THEN '' ELSE concat_ws(';', CASE WHEN k % 2 = 0 THEN (k % 200) || ' Defense' END, CASE WHEN k % 7 = 0 THEN '+2 to All Skills' END) END AS stats,
CASE WHEN NOT hit THEN '' ELSE concat_ws(';', CASE WHEN k % 2 = 0 THEN '+' || (k % 200) || ' Defense' END, CASE WHEN k % 7 = 0 THEN '+2 to All Skills' END, CASE WHEN k % 6 = 0 THEN 'Ethereal' END) END AS affixes,
CASE WHEN k % 10 = 0 THEN 'Make an Offer' ELSE '1 X Ist' END AS ask, CASE WHEN k % 4 = 1 THEN 'High Rune Value: ' || k % 50 END AS high_rune_value
FROM o WHERE {"true" if item else "k % 13 != 0"}"""


@query(_sql_cards(None))
def q12_cards(spark, d):
    """Listing cards of pages, the item read from each card."""
    return _cards(spark, d, None)


@query(_sql_cards("item 1-urgent"))
def q12_cards_of_item(spark, d):
    """Listing cards of pages of a known item; cards that do not name it keep the given name."""
    return _cards(spark, d, "item 1-urgent")


@query("""WITH o AS (SELECT *, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS block FROM orders),
b AS (SELECT o_custkey, block, 'Ring ' || k % 17 AS item, CASE k % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Ist' WHEN 2 THEN 'Ist OR Mal' WHEN 3 THEN 'or, Mal' ELSE 'Lem, Um' END AS price, (k % 20 + 1) || ' hours ago' AS trade_time,
CASE k % 4 WHEN 0 THEN 'PC' WHEN 1 THEN 'Switch' WHEN 2 THEN 'Xbox' END AS platform, CASE WHEN k % 3 = 0 THEN 'Softcore' END AS mode, CASE WHEN k % 7 = 0 THEN 'Ladder' END AS ladder, CASE WHEN k % 6 = 0 THEN 'Lord of Destruction' END AS game_version FROM o WHERE k % 11 != 0),
m AS (SELECT o_custkey, (max(block) FILTER (WHERE k = k) ) AS n FROM o GROUP BY o_custkey HAVING count(*) FILTER (WHERE k % 11 != 0) = 0)
SELECT * FROM b UNION ALL BY NAME SELECT o_custkey, -1 AS block, 'sold ' || o_custkey AS item, 'Jah' AS price, '' AS trade_time FROM m""")
def q14_trades(spark, d):
    """Finished trades of pages in blocks, and by their markers where a page has no block."""
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    lines = [
        F.when(k % 2 == 0, "They Give").otherwise("THEY GIVE"), _text("Ring ", k % 17), F.when(k % 4 == 0, "PC•").when(k % 4 == 1, "Nintendo Switch").when(k % 4 == 2, "Xbox"), F.when(k % 3 == 0, "Softcore•"), F.when(k % 7 == 0, "Ladder"),
        F.when(k % 6 == 0, "Lord of Destruction"), F.lit("I Give"), F.when(k % 5 == 4, "OR"), F.when(k % 5 == 3, "or").when(k % 5 == 4, "Lem").when(k % 5 > 0, "Ist"), F.when(k % 5 == 2, "OR"), F.when(k % 5 == 4, "Um").when(k % 5 > 1, "Mal"),
        F.when(k % 2 == 1, "High Rune Value: 0 or 0"), F.when(k % 11 != 0, _text(k % 20 + 1, " hours ago")),
    ]
    made = _page(o, "o_custkey", "o_orderkey", lines, "Recent", "")
    made = made.withColumn("text", F.concat("text", _text("sold ", F.col("o_custkey"), "\nsold for\nJah")))
    found = pages.all_trades(made, "o_custkey")
    by_marker = F.col("item").startswith("sold ")
    return found.withColumn("block", F.when(by_marker, -1).otherwise(F.col("block")).cast("long"))
