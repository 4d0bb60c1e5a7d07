"""Folds, sinks and names against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import names, scan, visits
from marketlens.sources import publish


def test_admitted_keys(spark):
    rng = random.Random(4)
    rows = [("s" + str(rng.randrange(2)), t, rng.choice(["add", "add", "add", "taken", "failed"]), "".join(rng.choice("01") for _ in range(2)) * 8) for t in range(120)]
    found = {(r["session"], r["ts"]): r["state"] for r in scan.admitted_keys(spark.createDataFrame(rows, "session string, ts long, event string, key string"), 2 / 16, 2).collect()}
    seen: dict = {"s0": [], "s1": []}
    waiting: dict = {"s0": 0, "s1": 0}
    for s, t, event, key in rows:
        if event == "taken":
            want, waiting[s] = "taken", max(0, waiting[s] - 1)
        elif event == "failed":
            want, seen[s] = "forgotten", [k for k in seen[s] if k != key]
        elif key in seen[s]:  # different keys differ in at least a half of their places
            want = "skipped"
        elif waiting[s] >= 2:
            want = "dropped"
        else:
            want = "queued"
            seen[s].append(key)
            waiting[s] += 1
        assert found[s, t] == want, (s, t)


def test_stable_frames(spark):
    box = lambda x: (x, 5, 100, 50)
    frames = [(0, box(10), "h"), (30, box(10), "h"), (70, box(11), "h"), (140, box(14), "h"), (210, box(30), "h"), (280, box(30), "g"), (350, box(30), "g"), (420, None, None), (490, box(30), "g"), (560, box(32), "g"), (630, box(34), "g")]
    rows = [("a", t, *(b or (None,) * 4), h, "0" * 16 if t < 200 else "1" * 16) for t, b, h in frames]
    out = scan.stable_frames(spark.createDataFrame(rows, "session string, ts long, x int, y int, width int, height int, hash string, key string"))
    states = [r["state"] for r in out.orderBy("ts").collect()]
    assert states == ["waiting", "skipped", "emitted", "held", "waiting", "waiting", "emitted", "none", "waiting", "emitted", "held"]


def test_publish_only_what_passed(spark, tmp_path):
    rows = spark.range(3)
    folder = f"file://{tmp_path}"
    made = lambda *passed: spark.createDataFrame([(p,) for p in passed], "passed boolean")
    seen = publish.Published(spark, folder)
    assert seen.state() is None and seen.table("market") is None
    assert publish.publish(made(True, True), {"market": rows}, folder) and seen.table("market").count() == 3
    for bad in (made(True, False), made(True, None), made()):
        assert not publish.publish(bad, {"market": rows}, folder) and seen.table("market") is None
        assert seen.table("verification").count() == bad.count()
    assert publish.publish(made(True), {"market": spark.range(5), "other": rows}, folder) and (seen.table("market").count(), seen.table("other").count()) == (5, 3)
    seen.sweep()
    assert seen.table("market").count() == 5 and len([p for p in tmp_path.iterdir() if p.name.startswith("generation-")]) == 1
    with pytest.raises(ValueError):
        publish.publish(made(True), {"verification": rows}, folder)


@pytest.mark.parametrize("passes", [True, False])
def test_a_job_that_dies_while_publishing_leaves_a_whole_state(spark, tmp_path, monkeypatch, passes):
    """The job is ended before and after each of its steps; readers see the state before or after it, and the next job succeeds."""
    steps = [("write", 0), ("write", 1), ("write", 2), ("switch", 0)]
    for n, (step, which) in enumerate((s, w) for s, w in steps if passes or (s, w) in (("write", 0), ("switch", 0))):
        for after in (False, True):
            folder = f"file://{tmp_path}/{n}{after}"
            rows = lambda k: {"a": spark.range(k), "b": spark.range(k + 1)}
            good = spark.createDataFrame([(True,)], "passed boolean")
            publish.publish(good, rows(2), folder)
            calls = {"write": 0, "switch": 0}
            whole = getattr(publish.Published, step)

            def dying(self, *args, whole=whole, calls=calls, step=step, which=which, after=after):
                calls[step] += 1
                if calls[step] == which + 1:
                    if after:
                        whole(self, *args)
                    raise KeyboardInterrupt
                return whole(self, *args)

            monkeypatch.setattr(publish.Published, step, dying)
            with pytest.raises(KeyboardInterrupt):
                publish.publish(good if passes else spark.createDataFrame([(False,)], "passed boolean"), rows(7), folder)
            monkeypatch.setattr(publish.Published, step, whole)
            seen = publish.Published(spark, folder)
            now = tuple(t and t.count() for t in (seen.table("a"), seen.table("b")))
            switched = step == "switch" and after
            assert now == (((7, 8) if passes else (None, None)) if switched else (2, 3))
            assert publish.publish(good, rows(4), folder) and seen.table("a").count() == 4
            seen.sweep()
            assert seen.table("b").count() == 5


def test_two_jobs_that_publish_at_once(spark, tmp_path):
    seen = publish.Published(spark, f"file://{tmp_path}")
    seen.switch("x", True, [], 0)
    with pytest.raises(publish.ConcurrentPublish):
        seen.switch("y", True, [], 0)
    assert seen.state() == {"number": 1, "passed": True, "generation": "x", "tables": []}


def test_csv_files_open_by_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 'say "a", b'), ("x", None), ("-2", "line\nend")], "a string, b string").repartition(2)
    publish.write_csv(rows, ["a", "b"], f"file://{tmp_path}/out")
    parts = [p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size]
    assert all(p.startswith("\ufeffa,b\r\n") and p.endswith("\r\n") for p in parts)
    lines = sorted(x for p in parts for x in p.removeprefix("\ufeffa,b\r\n").removesuffix("\r\n").split("\r\n"))
    assert lines == sorted(["'=1+1,\"say \"\"a\"\", b\"", "x,", "'-2,\"line\nend\""])


def test_fence_is_longer_than_any_run(spark):
    text = spark.createDataFrame([("a```` b``",), ("plain",)], "t string").select(publish.fenced(F.col("t")).alias("f")).collect()
    assert [t["f"].split("\n")[0] for t in text] == ["`" * 5, "```"]


ENTRIES = [("item", "Harlequin Crest", "諧角之冠"), ("item", "Spirit", "精神"), ("base", "Ring", "戒指"), ("base", "Grand Charm", "特大咒符"), ("item", "Skin of the Vipermagi", "蛇皮法衣之魂"), ("item", "Harlequin Crest", "harlequin crest"), ("base", "Breast Plate", "breast plate")]


def test_chinese_names(spark):
    """Exact names, one wrong character, a window of a longer run, a glued type word, an end of a run, and a line of numbers."""
    lines = ["諧角之冠", "諧角之寇", "我的蛇皮法衣之魂啊", "珍貴戒指", "稀有神秘的特大咒符", "精神[120ED]", "+30 精神", "HARLEQUIN  CREST", "12 to Breast Plate", "需要力量: 12"]
    pages = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "id long, pos int, line string")
    entries = spark.createDataFrame(ENTRIES, "kind string, name string, key string")
    found = names.closest_names(names.name_pieces(pages, "id"), entries, "id")
    best = {r["id"]: (r["name"], r["distance"]) for r in names.candidates(found, "id").where("ord = 1").collect()}
    assert best == {0: ("Harlequin Crest", 0), 1: ("Harlequin Crest", 1), 2: ("Skin of the Vipermagi", 0), 3: ("Ring", 0), 4: ("Grand Charm", 0), 5: ("Spirit", 0), 7: ("Harlequin Crest", 0), 8: ("Breast Plate", 3)}


def test_name_lines_and_keys(spark):
    lines = ["長虹指走 康賣她", "安達莉爾的面容 Spirit Shroud", "攻擊力量: 12", "力量: 12"]
    pages = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "id long, pos int, line string")
    pieces = names.name_pieces(pages, "id", traditional=("面", "面"))
    assert names.name_keys(pieces, "id").first()["keys"] == ["戒指寶冠", "安達莉爾的面貌", "spirit shroud"]
    assert [r["piece"] for r in pieces.where("stat_prefix").collect()] == ["攻擊力量"]
    key = spark.range(1).select(names.comparison_key(F.lit("賭 註")).alias("a"), names.comparison_key(F.lit("The Spirit's")).alias("b"), T.clean_name(F.lit(" Ａ  b ")).alias("c")).first()
    assert tuple(key) == ("賭注", "spirits", "A b")


def test_memory_and_translations(spark):
    memory = spark.createDataFrame([("p", "The Ring!", "item"), ("q", "Gone", "item")], "piece string, name string, kind string")
    entries = spark.createDataFrame([("base", "Ring"), ("item", "Spirit")], "kind string, name string")
    assert [tuple(r) for r in names.pruned(memory, entries).collect()] == [("p", "Ring", "base")]
    conditions = spark.createDataFrame([("l1", "fcr", "number", 5), ("l2", "fcr", "number", 6), ("l1", "eth", "bool", None)], "line string, key string, kind string, min int")
    known = spark.createDataFrame([("l1", "fcr", 9), ("l2", "ias", 8), ("l1", "eth", 1)], "line string, affix string, min int")
    assert {(r["line"], r["key"], r["min"], r["learned"]) for r in names.with_learned_values(conditions, known).collect()} == {("l1", "fcr", 9, True), ("l2", "fcr", 6, False), ("l1", "eth", None, False)}
    lines = spark.createDataFrame([(1, 0, "Shako"), (1, 1, "軍帽 Shako"), (1, 2, "plain")], "id long, pos int, line string")
    best = spark.createDataFrame([(1, 0, "軍帽"), (1, 1, "軍帽")], "id long, pos int, zh string")
    assert names.texts_with_translations(lines, best, "id").first()["text"] == "Shako 軍帽\n軍帽 Shako\nplain"
    both = names.merged({"a": spark.createDataFrame([("x", 1), ("y", 5)], "key string, used int"), "b": spark.createDataFrame([("z", 3)], "key string, used int")}, "used", 2)
    assert [(r["key"], r["store"]) for r in both.collect()] == [("y", "a"), ("z", "b")]
    zh = spark.createDataFrame([("蛇皮", "蛇皮", "Skin"), ("大蛇皮", "大蛇皮", "Big"), ("蛇", "蛇", "Snake")], "key string, chinese string, english string")
    told = names.suggested_chinese(spark.createDataFrame([("蛇",)], "key string"), zh).orderBy("rn").collect()
    assert [(r["chinese"], r["rank"]) for r in told] == [("蛇皮", 0), ("大蛇皮", 1)]


def test_expiring_keys(spark):
    told = [
        (0, "get", None, None, None, None), (1, "set", "a", None, None, "1"), (2, "set", "b", 5, "NX", "0"), (3, "expire", None, 10, "XX", "0"), (4, "expire", None, 10, "GT", "0"),
        (5, "expire", None, 10, "lt", "1"), (6, "expire", None, 3, "NX", "0"), (7, "expire", None, 5, "GT", "0"), (8, "expire", None, 20, "GT", "1"), (9, "expire", None, 30, "LT", "0"),
        (27, "get", None, None, None, "a"), (28, "get", None, None, None, None), (29, "expire", None, 9, None, "0"), (30, "set", "c", 2, "NX", "1"), (31, "get", None, None, None, "c"), (32, "del", None, None, None, "0"),
        (33, "set", "d", 1, None, "1"), (34, "set", "d", None, None, "1"), (99, "get", None, None, None, "d"), (100, "del", None, None, None, "1"), (101, "get", None, None, None, None),
    ]
    rows = spark.createDataFrame([(k, *t[:5]) for k in ("x", "y") for t in told], "session string, ts long, command string, value string, seconds long, condition string")
    found = visits.expiring_keys(rows).collect()
    for k in ("x", "y"):
        assert [r["result"] for r in sorted((r for r in found if r["session"] == k), key=lambda r: r["ts"])] == [t[5] for t in told]
    with pytest.raises(Exception, match="unsupported command"):
        visits.expiring_keys(rows.withColumn("command", F.lit("rename"))).collect()


def test_cookies_without_a_pair(spark):
    rows = spark.createDataFrame([("Path=/; Secure",)], "raw string")
    with pytest.raises(Exception, match="name=value"):
        rows.select(visits.cookie_pairs(F.col("raw"))).collect()
    kept = spark.createDataFrame([(None,), (" ",), ("a=1; Secure; a = 2",)], "raw string").select(visits.cookie_pairs(F.col("raw")).alias("p")).collect()
    assert [[tuple(x) for x in r["p"]] for r in kept] == [[], [], [("a", "1"), ("a", "2")]]


def test_edited_forms(spark):
    told = [
        ("a", "on", None, False), ("a", "add", None, True), ("a", "add", None, False), ("b", "add", None, True), ("c", "add", None, True), ("u", "add", None, True), ("u", "on", None, False),
        ("a", "on", None, True), ("a", "on", None, False), ("b", "on", None, True), ("c", "on", None, False), ("a", "min", "3", True), ("a", "max", "x", True), ("b", "min", "7", True), ("b", "max", "9", True),
        ("b", "max", "-1", True), ("a", "remove", None, True), ("c", "on", None, True), ("a", "add", None, True), ("a", "max", "4.5", True), ("z", "min", "1", False), ("b", "off", None, True), ("b", "off", None, False),
    ]
    rows = spark.createDataFrame([(s, t, k, c, k == "u", v) for s in ("x", "y") for t, (k, c, v, _) in enumerate(told)], "session string, ts long, key string, command string, unavailable boolean, value string")
    found = visits.form_edits(rows, limit=2).collect()
    assert [r["done"] for r in sorted((r for r in found if r["session"] == "x"), key=lambda r: r["ts"])] == [t[3] for t in told]
    forms = {tuple(r) for r in visits.edited_forms(rows, limit=2).collect()}
    assert forms == {(s, *f) for s in ("x", "y") for f in (("a", False, None, 4.5), ("b", False, 7.0, None), ("c", True, None, None), ("u", False, None, None))}
