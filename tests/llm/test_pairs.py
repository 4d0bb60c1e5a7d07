"""Exact dedup and n-gram Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, documents, words  # noqa: E402

from marketlens.llm import queries  # noqa: E402
from marketlens.llm.exact_dedup import exact_duplicates  # noqa: E402
from marketlens.llm.jaccard_join import jaccard_groups  # noqa: E402
from tests.oracle import rows_of_spark, rows_of_sql  # noqa: E402


def brute_groups(rows: list[tuple[int | None, str | None]], percent: int = 75) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (doc_id, least.get(find(i))) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def brute_exact(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    groups = defaultdict(list)
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for doc_id, text in rows:
        groups[(text or "").translate(strip)].append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0))
    out = []
    for clean, members in groups.items():
        best = min(members)
        keep, seen = (None if best[1] else best[2]), False
        for m in members:
            kept = m == best and not seen
            seen = seen or kept
            out.append((None if m[1] else m[2], keep, len(members), kept, hashlib.sha256(clean.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edges(spark):
    docs = documents()
    found = exact_duplicates(spark.createDataFrame(docs, SCHEMA).coalesce(2), block_chars=16)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_exact([d[:2] for d in docs])


def test_exact_dedup_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_edges(spark):
    docs = documents()
    found = jaccard_groups(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_groups([d[:2] for d in docs])


def test_jaccard_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_chains_and_common_passages(spark):
    """Chains of near copies around the threshold, in a group that shares a passage with others."""
    import random

    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(1000 + i, f"{passage} " + " ".join(f"u{i % 30}_{k}" for k in range(rng.randrange(2, 12)))) for i in range(60)]
    found = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_groups(rows)


def test_jaccard_members_that_stay_apart_are_not_paired_with_all_others(spark, monkeypatch):
    """A group of near copies of which many link to none: what is met follows the members, and the groups are those of brute force."""
    import random

    from marketlens.storage import Scratch

    rng, rows = random.Random(3), []
    for i in range(240):
        own = [f"t{k}" for k in range(290)]
        for at in rng.sample(range(0, 290, 5), rng.choice((4, 7))):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    met, stored = [], Scratch.table

    def table(self, df, tag):
        out = stored(self, df, tag)
        if tag in ("pivot-pairs", "cross-pairs"):
            met.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", table)
    found = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute_groups(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert sum(root == doc for doc, _, root in want) > 30
    assert met[-1] < 5 * len(rows), met


def test_sketches_never_discard_a_pair_at_the_threshold(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from marketlens.llm import jaccard_join

    rng, rows = np.random.default_rng(1), []
    for size in (1, 7, 60, 350, 3000):
        for _ in range(20):
            n, m = (int(x) for x in rng.integers(size, 1 + size * 4 // 3, 2))
            shared = min(n, m, -(-75 * (n + m) // 175))
            if 100 * shared < 75 * (n + m - shared):
                continue
            every = rng.integers(0, 1 << 64, n + m - shared, dtype=np.uint64)
            rows.append((n, m, *(jaccard_join._sketch(s).tolist() for s in (every[:n], every[n - shared :]))))
    pairs = spark.createDataFrame(rows, "n int, m int, sketch array<long>, sketch_m array<long>")
    assert len(rows) > 50 and pairs.where(~jaccard_join._near(75)).count() == 0
    apart = pairs.where("n between 100 and 500").withColumn("sketch_m", F.transform("sketch_m", F.bitwise_not))
    assert apart.count() and apart.where(jaccard_join._near(75)).count() == 0


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_url_filter", "op8_ngram_jaccard"])
def test_sql(spark, sf_dir, name):
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(queries.ORACLE_SQL[name], sf_dir)
