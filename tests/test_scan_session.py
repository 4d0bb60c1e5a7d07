"""Folds of a scan session: batch, stream and plain Python say the same, however the rows are cut into batches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from marketlens.operators import pages, scan, visits
from marketlens.streaming import scan_session

FRAMES = "session string, ts long, x int, y int, width int, height int, hash string, key string"
JOBS = "session string, ts long, event string, key string"
LOOKS = "session string, ts long, event string, hash string, key string, panel boolean, busy boolean"


def streamed(spark, tmp_path, rows: list[tuple], schema: str, cuts: int, seed: int, build) -> list[tuple]:
    """Rows of a streaming job over files that come one after the other, with a last one that moves the watermark past all others."""
    r = random.Random(seed)
    names = [c.split()[0] for c in schema.split(", ")]
    ordered = sorted(rows, key=lambda x: x[1] + r.uniform(0, 1500))  # out of order, but by less than the watermark's delay
    size = max(1, len(ordered) // cuts)
    folder = tmp_path / f"in{seed}"
    late = max(x[1] for x in rows) + 30_000
    parts = [ordered[k : k + size] for k in range(0, len(ordered), size)] + [[("~", late, *[None] * (len(names) - 2))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"p{k:03d}"))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(f"told{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{seed}")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return sorted((tuple(x) for x in spark.table(f"told{seed}").collect() if x[0] != "~"), key=repr)


def frames(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out, at = [], {"a": (10, 10), "b": (50, 5)}
    for k in range(n):
        who = r.choice("ab")
        if r.random() < 0.3:
            at[who] = (r.randrange(60), r.randrange(60))
        x, y = at[who][0] + r.randrange(3), at[who][1] + r.randrange(3)
        none = r.random() < 0.05
        out.append((who, 10**12 + k * 40, None if none else x, None if none else y, None if none else 100, None if none else 50, r.choice("gh"), r.choice(["0", "1"]) * 16))
    return out


def jobs(n: int, seed: int, letters: str = "01", size: int = 16) -> list[tuple]:
    r = random.Random(seed)
    return [("s" + str(r.randrange(2)), 10**12 + k * 10, r.choice(["add", "add", "add", "taken", "failed"]), None if r.random() < 0.05 else "".join(r.choice(letters) for _ in range(size))) for k in range(n)]


def plain_admission(rows: list[tuple], share: float, most: int) -> list[tuple]:
    seen: dict = {}
    waiting: dict = {}
    out = []
    for who, ts, event, key in sorted(rows, key=lambda x: (x[0], x[1])):
        keys, n = seen.setdefault(who, []), waiting.get(who, 0)
        if event == "taken":
            state, n = "taken", max(0, n - 1)
        elif event == "failed":
            state = "forgotten"
            keys[:] = [k for k in keys if k != key]
        elif key is not None and any(scan.alike(k, key, share) for k in keys):
            state = "skipped"
        elif n >= most:
            state = "dropped"
        else:
            state, n = "queued", n + 1
            keys += [key] if key is not None else []
        waiting[who] = n
        out.append((who, ts, state))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, most", [(2 / 16, 5), (0.0, 300), (1.0, 300), (5 / 16, 40)])
def test_admission_by_parts_is_admission_by_comparison(spark, share, most):
    rows = jobs(600, 5, size=16)
    got = sorted((tuple(r) for r in scan.admitted_keys(spark.createDataFrame(rows, JOBS), share, most).collect()), key=repr)
    assert got == plain_admission(rows, share, most)


def test_many_keys_of_one_session():
    """100,000 keys of six levels and of two: compared with few others each."""
    for letters, n in (("012345", 100_000), ("01", 20_000)):
        r = random.Random(1)
        fold, state, parts = scan.Admission(most=10**9), [0], {}
        began = time.process_time()
        keys = ["".join(r.choices(letters, k=64)) for _ in range(n)]
        states = [fold.step(state, (k, "add", key), parts) for k, key in enumerate(keys)]
        assert states.count("queued") > 0.9 * n and time.process_time() - began < 90


@pytest.mark.parametrize("cuts, seed", [(1, 1), (5, 2)])
def test_streams_say_what_batches_say(spark, tmp_path, cuts, seed):
    shown = frames(150, seed)
    batch = sorted((tuple(r) for r in scan.stable_frames(spark.createDataFrame(shown, FRAMES)).collect()), key=repr)
    assert len({s for _, _, s in batch}) >= 4
    assert streamed(spark, tmp_path, shown, FRAMES, cuts, seed, scan_session.stable_frames) == batch
    asked = jobs(150, seed, size=8)
    build = lambda s: scan_session.admitted_keys(s, share=2 / 8, most=6)
    assert streamed(spark, tmp_path, asked, JOBS, cuts, seed + 10, build) == plain_admission(asked, 2 / 8, 6)


def looks(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out, ts = [], 10**12
    picture = "a"
    for _ in range(n):
        ts += r.choice([70, 700, 3000])
        picture = r.choice("ab") if r.random() < 0.1 else picture
        event = "rescued" if r.random() < 0.1 else "frame"
        out.append(("s", ts, event, picture, {"a": "0", "b": "1"}[picture] * 16, r.random() < 0.05, r.random() < 0.1))
    return out


def test_fallback_reads(spark, tmp_path):
    rows = [("s", t, "frame", "h", "0" * 16, False, False) for t in (0, 70, 140, 3500, 20_071, 23_500)] + [("s", 23_600, "rescued", None, None, None, None)]
    rows += [("s", t, "frame", "h", "0" * 16, False, False) for t in (50_000, 80_000)] + [("s", t, "frame", "g", "1" * 16, False, False) for t in (80_100, 80_200)]
    rows += [("s", 80_300, "frame", "g", "1" * 16, True, False), ("s", 90_000, "frame", "g", "1" * 16, False, False), ("s", 90_100, "frame", "g", "1" * 16, False, True)]
    said = [r.state for r in scan.fallback_reads(spark.createDataFrame(rows, LOOKS)).orderBy("ts").collect()]
    assert said == ["waiting", "run", "limited", "known", "run", "known", "rescued", "known", "known", "waiting", "run", "panel", "waiting", "waiting"]
    shown = looks(200, 4)
    batch = sorted((tuple(r) for r in scan.fallback_reads(spark.createDataFrame(shown, LOOKS)).collect()), key=repr)
    assert len({s for _, _, s in batch}) >= 6
    assert streamed(spark, tmp_path, shown, LOOKS, 4, 21, scan_session.fallback_reads) == batch


def test_sessions_begin_anew_after_idling(spark, tmp_path):
    rows = [("s", 10**12 + t, "add", "0" * 8) for t in (0, 1000, 5000, 15_001, 15_002, 60_000)]
    batch = sorted(tuple(r) for r in scan.fold_sessions(spark.createDataFrame(rows, JOBS), scan.Admission(), 10_000).collect())
    assert [s for _, _, s in batch] == ["queued", "skipped", "skipped", "queued", "skipped", "queued"]
    assert streamed(spark, tmp_path, rows, JOBS, 3, 31, lambda s: scan_session.admitted_keys(s, idle_ms=10_000)) == batch


def test_expiring_keys_as_a_stream(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for k in range(200):
        command = r.choice(["set", "set", "get", "get", "expire", "del"])
        seconds = r.choice([None, 1, 5, 40]) if command == "set" else r.randrange(1, 60) if command == "expire" else None
        condition = r.choice([None, "NX"]) if command == "set" else r.choice([None, "NX", "XX", "GT", "LT"]) if command == "expire" else None
        rows.append((r.choice("ab"), 10**9 + k, command, f"v{k}", seconds, condition))
    schema = "session string, ts long, command string, value string, seconds long, condition string"
    batch = sorted((tuple(x) for x in visits.expiring_keys(spark.createDataFrame(rows, schema)).collect()), key=repr)
    build = lambda s: scan_session.expiring_keys(s.withColumn("command", F.coalesce("command", F.lit("get"))), late="30 minutes")
    shuffled = [(a, ts, *rest) for a, ts, *rest in rows]
    assert streamed(spark, tmp_path, shuffled, schema, 5, 41, build) == batch


def plain_settling(rows: list[tuple], quiet: int, cap: int) -> list[tuple]:
    """Each millisecond is looked at by itself."""
    out = []
    for page in sorted({r[0] for r in rows}):
        reads = sorted((ts, text or "") for p, ts, text in rows if p == page)
        opened = changed = reads[0][0]
        text, changes = reads[0][1], 0
        for now in range(opened, opened + cap + 1):
            if now == opened + cap or now == changed + quiet:
                out.append((page, now, text, now < opened + cap, changes))
                break
            for _, read in (x for x in reads if x[0] == now):
                if read != text:
                    text, changed, changes = read, now, changes + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts, seed", [(1, 51), (5, 52)])
def test_settled_pages(spark, tmp_path, cuts, seed):
    r = random.Random(seed)
    rows = []
    for page in range(25):
        ts = 10**12 + r.randrange(3000)
        for k in range(r.randrange(1, 20)):
            rows.append((f"p{page}", ts, r.choice(["x", "", None, f"t{k}", f"t{k}", f"t{k}", f"t{k}"])))
            ts += r.choice([0, 40, 60, 80, 99, 50, 70, 100 if page % 2 else 50])
    schema = "page string, ts long, text string"
    want = plain_settling(rows, 100, 400)
    assert {x[3] for x in want} == {True, False}
    df = spark.createDataFrame(rows, schema)
    assert sorted((tuple(x) for x in pages.settled_pages(df, 100, 400).collect()), key=repr) == want
    assert streamed(spark, tmp_path, rows, schema, cuts, seed, lambda s: scan_session.settled_pages(s, 100, 400)) == want
