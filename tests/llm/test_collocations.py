"""Phrase counts and collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from marketlens.llm import collocations
from marketlens.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import rows_of_spark, rows_of_sql

ALL = np.full(collocations._BITS // 8, 255, dtype=np.uint8)


def phrases_of(docs: list[tuple[str | None, str | None]], words: int) -> Counter:
    out: Counter = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update((lang or "und", " ".join(w[i : i + words])) for i in range(len(w) - words + 1))
    return out


def brute_force(docs, max_words: int, least: int, inside: int, top: int) -> list[tuple]:
    f = Counter()
    for k in range(1, max_words + 1):
        f += phrases_of(docs, k)
    total = Counter()
    for (lang, _), c in phrases_of(docs, 1).items():
        total[lang] += c
    candidates = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    rows = []
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        if any(la == lang and 100 * b >= inside * a and len(p) > len(phrase) and f" {phrase} " in f" {p} " for (la, p), b in candidates.items()):
            continue
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
        score, _, left, right = min((1000000 * a * a // (left * right), k, left, right) for left, right, k in cuts)
        rows.append((lang, phrase, a, left, right, total[lang], score))
    out = []
    for lang in total:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, k + 1, *r[1:]) for k, r in enumerate(mine[:top])]
    return sorted(out)


def drawn(n: int, seed: int, letters: str = "aB  \t.\nç\x00") -> list[tuple[str | None, str | None]]:
    r = random.Random(seed)
    return [(r.choice(["en", "de", None]), "".join(r.choice(letters) for _ in range(r.randint(0, 300)))) for _ in range(n)]


@pytest.mark.parametrize("words", [1, 2, 3, 4])
@pytest.mark.parametrize("room", [7, 23, 10**6])
def test_counts_of_shards(words, room):
    docs = [(lang or "und", t) for lang, t in drawn(60, words)]
    got: Counter = Counter()
    for lang, text in docs:
        for part in collocations._chunks(text.encode(), words, room):
            for batch in collocations._shard_counts([(lang, part)], words, [ALL] * 3):
                got.update({(la, p.decode()): f for la, p, f in zip(*(c.to_pylist() for c in batch.columns)) if p})
    assert got == phrases_of(docs, words)


def test_small_batches_of_bitmaps(monkeypatch):
    docs = [(lang or "und", t) for lang, t in drawn(80, 9)]
    monkeypatch.setattr(collocations, "_BATCH", 16)
    got: Counter = Counter()
    for batch in collocations._shard_counts([(lang, t.encode()) for lang, t in docs], 3, [ALL] * 3):
        got.update({(la, p.decode()): f for la, p, f in zip(*(c.to_pylist() for c in batch.columns))})
    assert got == phrases_of(docs, 3)


@pytest.mark.parametrize("max_words, top", [(2, 5), (3, 2000), (4, 2000)])
def test_collocations_against_brute_force(spark, max_words, top):
    docs = [*drawn(120, 11, "aBc  .ç"), (None, None), ("en", ""), ("en", " \t "), ("de", "x y z " * 3000), ("de", "x y z " * 3000), ("und", "a b. " * 20)]
    rows = spark.createDataFrame([(i, t, lang, "n") for i, (lang, t) in enumerate(docs)], "doc_id int, text string, lang string, rank string").repartition(5)
    found = collocations.collocations(rows, max_words=max_words, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(docs, max_words, 10, 50, top)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_exact_scores_of_huge_counts(spark):
    from pyspark.sql import functions as F

    a, left, right = 3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 3
    wide = lambda v: F.lit(v).cast("decimal(19,0)")
    row = spark.range(1).select((F.lit(1000000).cast("decimal(7,0)") * wide(a) * wide(a)).alias("x"), (wide(left) * wide(right)).alias("y")).selectExpr("cast(x div y as bigint) AS score")
    assert row.first()[0] == 1000000 * a * a // (left * right)


def test_query_against_sql(spark, sf_dir):
    assert rows_of_spark(QUERIES["op13_collocations"](spark, sf_dir)) == rows_of_sql(ORACLE_SQL["op13_collocations"], sf_dir)
