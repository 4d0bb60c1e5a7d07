"""What the quality threshold catches, on labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.llm import queries


def test_low_quality_rows_are_caught(spark):
    d = "/root/testdata/sf0.1"
    found = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {r["quality"]: r["k"] for r in found.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert kept[0] < 0.05 and kept[1] > 0.95, kept
