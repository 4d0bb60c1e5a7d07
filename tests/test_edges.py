"""Odd rows of registered queries, each against its SQL or a plain reading."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marketlens import constants as C
from marketlens import registry
from marketlens.llm import quality
from marketlens.operators import pages
from tests.oracle import rows_of_spark, rows_of_sql


def _agree(spark, name: str, folder) -> list[tuple]:
    found = rows_of_spark(registry.QUERIES[name](spark, str(folder)))
    assert found == rows_of_sql(registry.ORACLE_SQL[name], str(folder))
    return found[1]


def test_collapsed_cells_at_their_steps(spark, tmp_path):
    at = (np.arange(0, 64) / 20).astype(np.float32)
    vectors = [at, np.nextafter(at, np.float32(0)), np.nextafter(at, np.float32(9)), -at]
    table = pa.table({"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * 4, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    _agree(spark, "q47_collapse", tmp_path)


def test_every_trusted_row_is_fitted_or_judged(spark):
    docs = spark.range(44_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 10).alias("text"), F.lit("en").alias("lang"))
    found = quality.document_perplexity(docs, docs.select("doc_id"), chunk_bytes=20_000).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    assert found.where("fitted != half").count() == 0 and found.where("fitted").count() > 20_000


def _operators(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_without_windows_or_sorts_of_lines(spark, sf_dir):
    for name in ("q12_cards", "q12_cards_of_item", "q14_trades"):
        plan = _operators(registry.QUERIES[name](spark, sf_dir))
        assert "Window" not in plan and "Join" not in plan and plan.count("Aggregate") == 1, name


def test_whole_pages_give_what_their_lines_give(spark):
    listing = "\n".join(("Apply this search for all", "Pro", "Bob", "(12)", "2 X Shako", "PC•", "Pro", "Trading For", "High Rune Value: 5", "1 X Ist", "3 days ago", "just now", "(3)", "1 x Ring", "JUST NOW", "x", "HELP", "4 days ago"))
    trade = "\n".join(("They Give", "PC•", "2 days ago", "they give", "Ring", "I Give", "I Give", "OR", "Um", "剛剛", "They Give", "unfinished"))
    rows = [(1, listing), (2, trade), (3, "sold for\nJah"), (4, "They Give\nHardcore•\n1 day ago\nRing\nTRADED FOR"), (5, None), (6, ""), (7, "HELP\n5 days ago")]
    df = spark.createDataFrame(rows, "page_id int, text string")
    lines = pages.page_lines(df)
    own = pages.cards(pages.segments(pages.listing_lines(lines), F.rlike("line", F.lit(C.CARD_TIME))))
    assert rows_of_spark(pages.page_cards(df)) == rows_of_spark(own) and own.count() == 5
    found = rows_of_spark(pages.all_trades(df))
    in_blocks = pages.trades(lines)
    by_marker = pages.marker_trades(lines.where("page_id IN (3, 4)")).withColumnRenamed("pos", "block")
    assert found == rows_of_spark(in_blocks.unionByName(by_marker, allowMissingColumns=True))
    assert [(r["page_id"], r["block"], r["item"], r["price"], r["trade_time"]) for r in pages.all_trades(df).orderBy("page_id").collect()] == [
        (2, 2, "Ring", "Um", "剛剛"), (3, 0, "Unknown", "Jah", ""), (4, 4, "Ring", "", ""),
    ]


def test_readings_are_made_once_for_each_text(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog and runs away again"
    texts = [long, long.upper(), long + " x", " ".join(long) + "\v\f\r\n", None, "", "ab", "a b", "a", long[:39], "ключ 😀 и замок 😀, " * 4, "ключ 😀 и замок 😁, " * 4, long * 300, " " + long * 299]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    found = {r[1]: r[0] for r in _agree(spark, "q49_read_again", tmp_path)}
    assert found[3] and found[5] and found[7] and found[13] and not found[1]
    assert "array_distinct" not in _operators(registry.QUERIES["q49_read_again"](spark, str(tmp_path)))


def test_runs_of_odd_lines(spark, tmp_path):
    texts = ["The Stone of Jordan\nshort\n  the  the ring's edge ", "Shako+141 Defense [rare] 12\nabc: 12\nab c d: 12 items\nMany words (Item) of 3", "don’t-stop--now ’the the  axe", None, "", "naïve façade Straße\tand more", "[all of it\nname [rare] left"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    assert len(_agree(spark, "q24_name_pieces", tmp_path)) > 5
    plan = _operators(registry.QUERIES["q24_name_pieces"](spark, str(tmp_path)))
    assert "size(" not in plan, "what is exploded is made twice"
