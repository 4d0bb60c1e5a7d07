"""Saved scans and replies as data sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marketlens.sources import stores


def saved(folder, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def test_scan_with_repeated_keys(spark, tmp_path):
    folder = tmp_path / "scan"
    saved(folder, "a.json", [{"cursor": 1, "key": "code:é", "fields": {"limit": 3, "name": "x"}}, {"cursor": 1, "key": "code:2", "fields": {"limit": "1"}}, {"key": "other", "fields": {"limit": "1"}}])
    saved(folder, "b.json", [{"cursor": 2, "key": "code:é", "fields": {"limit": "4", "name": None}}, {"cursor": 2, "key": "code:2", "fields": {"name": "no limit"}}])
    saved(folder, "_hidden", [{"key": "hidden", "fields": {}}])
    (folder / "empty.json").write_text("\n\n")
    stores.register(spark)
    scan = spark.read.format("store_scan").load(str(folder))
    assert scan.count() == 5 and scan.rdd.getNumPartitions() == 3
    assert sorted((r.key, r.fields) for r in stores.records(scan).collect()) == [("code:é", {"limit": "4", "name": None}), ("other", {"limit": "1"})]
    assert spark.read.format("store_scan").load(str(tmp_path / "none")).count() == 0


def test_tests_on_names_are_pushed_down(spark, tmp_path):
    folder = tmp_path / "scan"
    saved(folder, "a.json", [{"cursor": n, "key": f"k{n}", "fields": {"limit": n}} for n in range(20)])
    stores.register(spark)
    scan = spark.read.format("store_scan").load(str(folder))
    for test, left in ((F.col("key") == "k7", {"k7"}), (F.col("key").isin("k1", "k2", "x"), {"k1", "k2"}), (F.startswith("key", F.lit("k1")) & (F.col("cursor") > 15), {"k16", "k17", "k18", "k19"})):
        asked = scan.where(test)
        assert {r.key for r in asked.collect()} == left
        plan = asked._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
        assert not any("k7" in f or "k1" in f for f in filters), plan  # only what was not pushed is tested again
        source = stores.StoreScan({"path": str(folder)})
        source_rows = list(source.rows(f"file://{folder}/a.json", stores.Names((frozenset(left),))))
        assert {r[0] for r in source_rows} == left


def test_scan_as_a_stream(spark, tmp_path):
    folder = tmp_path / "scan"
    saved(folder, "1.json", [{"cursor": 1, "key": "a", "fields": {"limit": 1}}])
    stores.register(spark)
    seen: list[list[str]] = []

    def run() -> None:
        query = spark.readStream.format("store_scan").load(str(folder)).writeStream.foreachBatch(lambda df, _: seen.append(sorted(r.key for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    saved(folder, "2.json", [{"cursor": 2, "key": "b", "fields": {}}, {"cursor": 2, "key": "c", "fields": {}}])
    run()
    assert [b for b in seen if b] == [["a"], ["b", "c"]]


def test_saved_replies(spark, tmp_path):
    folder = tmp_path / "replies"
    saved(folder, "r.json", [{"path": "/a", "status": 200, "body": '{"x": 1}'}, {"path": "/b", "status": 200, "body": "<html>" + "é" * 400}, {"path": "/c", "status": 404, "body": '{"x": 1}'}, {"path": "/d", "status": 500}])
    stores.register(spark)
    found = {r.path: (r.status, r.body, r["head"]) for r in spark.read.format("saved_replies").load(str(folder)).collect()}
    assert found == {"/a": (200, '{"x": 1}', None), "/b": (200, None, "<html>" + "é" * 294), "/c": (404, None, '{"x": 1}'), "/d": (500, None, "")}


def test_folders_without_files_have_no_rows(spark, tmp_path):
    stores.register(spark)
    (tmp_path / "empty").mkdir()
    for source in ("store_scan", "saved_replies"):
        for folder in ("empty", "none"):
            found = spark.read.format(source).load(str(tmp_path / folder))
            assert found.collect() == [] and found.where("key = 'x'" if source == "store_scan" else "path = 'x'").count() == 0
