"""Memories with eviction, edit distances by tries and exact ranks, against plain Python."""

from __future__ import annotations

import math
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import lru, market, matching, name_trie, ranks


def plain_memory(rows: list[tuple], most: int, cap: int) -> set[tuple]:
    memory: OrderedDict = OrderedDict()
    for _, key, name in sorted(rows):
        before = memory.pop(key, None)
        memory[key] = (name, min(cap, before[1] + 1) if before and before[0] == name else 1)
        if len(memory) > most:
            memory.popitem(last=False)
    return {(k, n, c) for k, (n, c) in memory.items()}


@pytest.mark.parametrize("most, keys, seed", [(1, 3, 1), (3, 8, 2), (5, 6, 3), (40, 60, 4), (500, 20, 5)])
def test_memory_is_that_of_a_log_read_in_order(spark, most, keys, seed):
    r = random.Random(seed)
    rows = [(k, min(int(r.expovariate(3.0 / keys)), keys - 1), r.choice(["a", "a", "b"])) for k in range(800)]
    log = spark.createDataFrame(rows + [(900, None, "x")], "at long, key long, name string").repartition(6)
    assert {tuple(x) for x in lru.remembered(log, "key", F.col("at"), most, 4).collect()} == plain_memory(rows, most, 4)


def test_memory_of_nothing(spark):
    assert lru.remembered(spark.createDataFrame([], "at long, key string, name string"), "key", F.col("at")).collect() == []


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("size", [0, 1, 3, 6])
@pytest.mark.parametrize("allowed", [0, 1, 2, 5])
def test_a_trie_finds_all_names_within_reach(size, allowed):
    r = random.Random(size)
    names = list({"".join(r.choice("abé😀") for _ in range(size)) for _ in range(60)})
    trie = name_trie.Trie(names)
    for length in (0, 1, 4, 7):
        pieces = list({"".join(r.choice("abé😀") for _ in range(length)) for _ in range(30)})
        got = {(pieces[p], trie.names[n], int(d)) for ps, ns, ds in trie.near(pieces, allowed) for p, n, d in zip(ps, ns, ds)}
        assert got == {(a, b, edits(a, b)) for a in pieces for b in names if edits(a, b) <= allowed}


@pytest.mark.parametrize("loose", [False, True])
def test_fuzzy_names_in_small_blocks_and_groups(spark, loose, monkeypatch):
    r = random.Random(7)
    names = sorted({"".join(r.choice("abcde") for _ in range(r.choice([3, 5, 6, 9]))) for _ in range(120)})
    pieces = sorted({"".join(r.choice("abcde") for _ in range(r.randint(1, 11))) for _ in range(80)})
    for block, group in ((7, 9), (20_000, 50_000)):
        monkeypatch.setattr(name_trie.near_names, "__defaults__", (block, group))
        frame = lambda c, v: spark.createDataFrame([(x,) for x in v] + [(None,), (v[0],)], f"{c} string")
        found = matching.fuzzy(frame("piece", pieces), frame("name", names), T.allowed_edits(F.col("size"), loose=loose), 3).collect()
        reach = lambda n: max(1 if len(n) <= 5 else 2, math.floor(len(n) * 0.4 + 0.5) if loose else 0)
        want = set()
        for p in pieces:
            near = sorted((edits(p, n) * 100 - min(len(n), 40), n, edits(p, n)) for n in names if edits(p, n) <= reach(n))
            want |= {(p, n, d, s, k + 1) for k, (s, n, d) in enumerate(near[:3])}
        assert {tuple(x) for x in found} == want


def test_a_piece_meets_few_blocks(spark):
    """At most one row for each length in reach and block, whatever the edits allowed."""
    pieces = spark.createDataFrame([("abcdefghijklmnop",)], "piece string")
    names = spark.createDataFrame([("x" * n,) for n in range(1, 40)], "name string")
    found = name_trie.near_names(pieces, names, F.lit(7), 3)
    assert found.count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 6 and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_exact_ranks(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None, "one"]), r.choice([1, None]), r.choice([None, float(r.randrange(12)), r.random()])) for _ in range(700)] + [("none", 1, None)] * 3 + [("lone", 1, 2.5)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    n = F.col("n")
    found = {(x.g, x.h): (x.n, x.low, x.mid, x.up, x.past) for x in ranks.at_ranks(df, ["g", "h"], "v", {"low": F.lit(1), "mid": ranks.nearest(0.5, n), "up": ranks.upper_median(n), "past": n + 1}).collect()}
    want = {}
    for key in {(g, h) for g, h, v in rows if v is not None}:
        v = sorted(x for g, h, x in rows if (g, h) == key and x is not None)
        want[key] = (len(v), v[0], v[max(1, math.ceil(len(v) * 0.5)) - 1], v[len(v) // 2] if len(v) > len(v) // 2 else None, None)
    assert found == want
    middles = {(x.g, x.h): x.m for x in ranks.quantiles(df, ["g", "h"], "v", {"m": 0.5}).collect()}
    for key, got in middles.items():
        v = sorted(x for g, h, x in rows if (g, h) == key and x is not None)
        assert got == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)


def test_price_summary_of_one_huge_group(spark):
    """All rows in one group: its sort is of many partitions, and the task that looks at the ranks sees one of them."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 7919, F.lit(200_003)).alias("p"))
    row = market.price_summary(df, "p", ["g"]).first()
    v = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert (row.rows, row.priced, row.min_price, row.q1_price, row.median_price, row.q3_price) == (200_000, 200_000, v[0], v[49_999], v[99_999], v[149_999])


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert ranks.at_ranks(none, ["g"], "v", {"m": F.lit(1)}).collect() == [] and market.price_summary(none, "v", ["g"]).collect() == []
