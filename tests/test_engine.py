"""The engine's queries against their SQL, and hand-written pages, folds and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marketlens import constants as C
from marketlens import registry
from marketlens.operators import affixes, ledger, market, matching, pages
from marketlens.streaming import events
from tests.oracle import rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert rows_of_spark(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(registry.ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


LISTING_PAGE = "\n".join((
    "Marketplace", "Apply this search for all", "old", "Apply this search for all", "Bob", "(12)", "Pro", "PC•", "2 X Shako", "Softcore•", "Ladder•", "141 Defense", "+2 to All Skills",
    "Trading For", "1 X Ist", "High Rune Value: 5", "3 days ago", "Ann", "(3)", "1 x Ring", "Xbox", "Ethereal", "Make an Offer", "just now", "Cid", "Lone", "Trading For", "2024-01-05", "tail", "HELP", "after",
))
TRADE_PAGE = "\n".join((
    "Recent", "They Give", "Shako", "PC•", "Softcore•", "Ladder•", "I Give", "1 X Ist", "OR", "2 X Mal", "Um", "2 days ago", "They Give", "broken",
    "They Give", "I Give", "High Rune Value: 0 or 0", "Lem", "1 hour ago", "They Give", "Ring", "Non Ladder", "I Give", "OR", "3分鐘前", "end",
))


def _lines(spark, text: str):
    return pages.page_lines(spark.createDataFrame([(1, text)], "page_id int, text string"))


def test_listing_cards(spark):
    found = pages.cards(pages.segments(pages.listing_lines(_lines(spark, LISTING_PAGE)), F.rlike("line", F.lit(C.CARD_TIME))))
    rows = {r["seller"]: r for r in found.collect()}
    assert set(rows) == {"Bob", "Ann", "Cid"}  # a card without an item line is one, but has no item
    assert (rows["Cid"]["item_name"], rows["Cid"]["rating"]) == (None, None)
    bob, ann = rows["Bob"], rows["Ann"]
    assert (bob["rating"], bob["item_name"], bob["defense"], bob["stats"], bob["ask"], bob["high_rune_value"]) == ("(12)", "Shako", 141, ["141 Defense", "+2 to All Skills"], "1 X Ist", "High Rune Value: 5")
    assert (bob["mode"], bob["ladder"], bob["posted_time"]) == ("Softcore", "Ladder", "3 days ago")
    assert (ann["platform"], ann["is_ethereal"], ann["ask"], ann["posted_time"]) == ("Xbox", True, "Make an Offer", "just now")


def test_finished_trades(spark):
    rows = sorted((r["item"], r["price"], r["trade_time"]) for r in pages.trades(_lines(spark, TRADE_PAGE)).collect())
    assert rows == [("Ring", "Unknown", "3分鐘前"), ("Shako", "1 X Ist OR 2 X Mal, Um", "2 days ago"), ("Unknown", "Lem", "1 hour ago")]


def brute_throttle(rows: list[tuple[str, float]], limit: int, window_s: float) -> list[tuple]:
    state: dict = {}
    out = []
    for key, ts in sorted(rows):
        opened, n = state.get(key, (float("-inf"), 0))
        if ts >= opened + window_s:
            opened, n = ts, 0
        state[key] = opened, n + 1
        out.append((key, ts, n + 1, n + 1 > limit))
    return out


FAILURES = [("a", 1e6 + t) for t in (0, 1, 2, 3, 9, 10, 11, 12, 13, 30)] + [("b", 1e6 + t) for t in (5, 5, 14.5, 15)]


def test_throttle(spark):
    df = spark.createDataFrame(FAILURES, "key string, ts double")
    assert sorted(map(tuple, ledger.throttle(df, 2, 10.0).collect())) == brute_throttle(FAILURES, 2, 10.0)


def _run(stream, name: str) -> list:
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def _source(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def test_throttle_stream_equals_batch(spark, tmp_path):
    stream = _source(spark, tmp_path / "in", FAILURES, "key string, ts double")
    assert sorted(map(tuple, _run(events.throttled(stream, 2, 10.0), "throttled"))) == brute_throttle(FAILURES, 2, 10.0)


def test_window_streams_equal_batch_on_closed_windows(spark, tmp_path):
    rows = [("a", t) for t in (0, 10, 299, 300, 4000, 4100, 9000)] + [("b", 20), ("end", 10**6)]
    stream = _source(spark, tmp_path / "in", rows, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r["key"], r["n"]) for r in _run(events.window_counts(stream, ["key"]), "windows"))
    assert got == sorted([("a", 3), ("a", 1), ("a", 2), ("a", 1), ("b", 1)])
    got = sorted((r["key"], r["n"]) for r in _run(events.quiet_sessions(stream, ["key"]), "sessions"))
    assert got == sorted([("a", 4), ("a", 2), ("a", 1), ("b", 1)])


def test_upsert(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    changes = spark.createDataFrame([(1, "new", False, 5, 1), (1, "newer", False, 5, 2), (2, "y", True, 5, 1), (3, "old run", False, 4, 9), (4, "four", None, 5, 1)], "id int, name string, removed boolean, generation int, at int")
    found = events.upsert(now, changes, "id", F.col("at"), least=5)
    assert sorted(map(tuple, found.collect())) == [(1, "newer"), (3, "z"), (4, "four")]


LINES = ["Shako", "需要力量:148", "+2 所有技能", "20 6% 增強", "移動 速度 406", "+2 所有技能 again", "增加 (FRX) 34060", "無法凍結", "生命之寶"]
ENTRIES = [
    affixes.Affix("all", ("所有技能",), "to all skills"), affixes.Affix("speed", ("移動速度",), "faster run", "percent", ceiling=100), affixes.Affix("ed", ("增強",), "enhanced", "percent"),
    affixes.Affix("frw", ("跑速",), "run walk", "percent", "FRW", 60), affixes.Affix("cnbf", ("無法凍結",), "cannot be frozen", "bool"), affixes.Affix("life", ("生命",), "to life"),
]


def test_affix_lines(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)] + [(2, 0, None)], "page_id int, pos int, line string")
    found = {r["key"]: (r["min"], r["confident"]) for r in affixes.parse_affixes(lines, ENTRIES).collect()}
    assert found == {"all": (2.0, True), "speed": (40.0, False), "ed": (6.0, True), "frw": (34.0, False), "cnbf": (None, True)}


@pytest.mark.parametrize("shown, value", [("406", 40), ("2096", 20), ("10509", 105), ("34060", 34), ("119", 119), ("40", 40)])
def test_number_repair(spark, shown, value):
    row = affixes.read_numbers(spark.range(1), F.lit(shown), F.lit(True), F.lit(120)).first()
    assert (row["min"], row["confident"]) == (value, False)


def test_equal_texts_of_nulls_blanks_and_repeated_rows(spark):
    rows = [(3, "a b"), (1, "ab\n"), (1, "ab\n"), (2, None), (5, " "), (None, "x"), (None, "A"), (4, "A")]
    found = matching.first_with_text(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert sorted(((r["id"], r["first_id"], r["again"]) for r in found), key=repr) == sorted(
        [(3, 1, True), (1, 1, False), (1, 1, False), (2, 2, False), (5, 2, True), (None, None, False), (None, 4, False), (4, 4, False)], key=repr
    )
    assert matching.first_with_text(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_first_requests_of_a_stream(spark, tmp_path):
    rows = [("a", 10), ("a", 12), ("b", 11), ("a", 13), ("b", 500)]
    stream = _source(spark, tmp_path / "in", rows, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts"))
    assert sorted(r["key"] for r in _run(events.first_requests(stream, ["key"]), "firsts")) == ["a", "b"]


def test_rows_of_missing_views_and_bases(spark):
    views = spark.createDataFrame([(1, "Ring", True), (2, None, True), (3, "Ring", False), (4, "Axe", True), (None, "Axe", True)], "v int, base string, passed boolean")
    rows = spark.createDataFrame([(1, "ring"), (1, None), (2, "x"), (3, "x"), (1, "RING")], "v int, item_name string")
    found = {r["v"]: (r["rows_before_base"], r["rows"], r["note"]) for r in market.base_notes(views, rows, "v").collect()}
    assert found == {1: (3, 2, None), 2: (None, 1, None), 3: (None, 1, None), 4: (0, 0, None), None: (0, 0, None)}
    lone = market.base_notes(views, rows.where("item_name IS NULL"), "v").where("v = 1").first()
    assert lone["note"] == "網站回傳的 1 筆裡沒有名稱是「Ring」的掛單"
