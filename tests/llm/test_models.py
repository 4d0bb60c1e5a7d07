"""Context trees, language ID and the quality model against brute force and on held-out rows."""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, documents, remainder, words  # noqa: E402

from marketlens.llm import context_tree, language, quality, queries  # noqa: E402


class BruteTree:
    """Context-tree weighting, one binary tree per bit position and prefix, by direct recursion over contexts."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, byte in self.coded(t):
                for d in range(depth + 1):
                    for bit in range(8):
                        key = context[:d], bit, byte >> (8 - bit)
                        self.counts[key][byte >> (7 - bit) & 1] += 1
                        if d:
                            self.children[context[: d - 1], bit, byte >> (8 - bit)].add(context[:d])

    def coded(self, text: bytes):
        padded = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(padded)):
            yield bytes(reversed(padded[i - self.depth : i])), padded[i]

    @staticmethod
    def log_kt(a: int, b: int) -> float:
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    @lru_cache(maxsize=None)
    def weighted(self, context: bytes, bit: int, prefix: int) -> tuple[float, float]:
        own = self.log_kt(*self.counts.get((context, bit, prefix), (0, 0)))
        if len(context) == self.depth:
            return own, math.inf
        below = sum(self.weighted(c, bit, prefix)[0] for c in self.children.get((context, bit, prefix), ()))
        return float(np.logaddexp(own, below)) - math.log(2), own - below

    def predict(self, context: bytes, bit: int, prefix: int, one: int, depth: int = 0) -> float:
        n = self.counts.get((context[:depth], bit, prefix), (0, 0))
        kt = (n[one] + 0.5) / (sum(n) + 1)
        if depth == self.depth or sum(self.counts.get((context[: depth + 1], bit, prefix), (0, 0))) == 0:
            return kt
        share = 1 / (1 + math.exp(-max(-700.0, min(700.0, self.weighted(context[:depth], bit, prefix)[1]))))
        return share * kt + (1 - share) * self.predict(context, bit, prefix, one, depth + 1)

    def score(self, text: bytes) -> float:
        return sum(math.log10(self.predict(c, bit, b >> (8 - bit), b >> (7 - bit) & 1)) for c, b in self.coded(text) for bit in range(8))


def test_context_tree_is_the_brute_force_one(spark):
    docs = [d for d in documents(n=12) if len(d[1] or "") < 700 and d[0] is not None]
    train = F.coalesce(queries.remainder(7) != 2, F.lit(True))
    found = context_tree.score_texts(spark.createDataFrame(docs, SCHEMA).repartition(3), train, chunk_bytes=900).collect()
    tree = BruteTree([(d[1] or "").encode() for d in docs if remainder(d[0], 7) != 2], context_tree.DEPTH)
    own = sorted((d[0], round(tree.score((d[1] or "").encode()), 5)) for d in docs)
    assert sorted((r["doc_id"], round(r["score"], 5)) for r in found) == own


def test_base_scores_and_counts(spark):
    docs = documents()
    train = F.coalesce(queries.remainder(7) != 2, F.lit(True))
    found = context_tree.score_texts(spark.createDataFrame(docs, SCHEMA).repartition(3), train, chunk_bytes=9000).collect()
    counts = Counter()
    for d in docs:
        if remainder(d[0], 7) != 2:
            counts.update([*words(d[1]), None])
    n, v = sum(counts.values()), len(counts)
    own = []
    for d in docs:
        tokens = [*words(d[1]), None]
        own.append((d[0], len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), 4)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found), key=repr) == sorted(own, key=repr)
    assert all(r["score"] < 0 for r in found)


def test_context_tree_empty(spark):
    assert context_tree.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_context_tree_beats_unigrams_on_held_out_texts(spark):
    """On 10,000 documents; with the 200 or 1000 of the smaller tables, whole-word counts still tell more than bytes."""
    rows = queries.op2_context_tree_scores(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language_id(spark, d).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred != 'und'")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.95


def test_language_edges(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    model = language.train(df)
    found = df.select("doc_id", "text", "lang", language.identify(model, df, F.col("text")).alias("p")).collect()
    assert len(found) == len(docs)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang"] == "und") == (not letters)
        assert 0 <= r["p"]["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["p"]["lang"] == r["lang"]


def test_language_spans_of_mixed_text(spark):
    model = language.train(spark.createDataFrame(documents(), SCHEMA))
    parts = ("the cat and dog ran over this hill", "der hund und die katze über den berg", "кот и собака бежали вместе")
    text = " ".join(parts)
    spans = model.label([text], True)["spans"][0]
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in spans] == list(zip(("en", "de", "ru"), parts))


def test_language_viterbi_is_the_best_path(spark):
    from itertools import product

    model = language.train(spark.createDataFrame(documents(), SCHEMA))
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(5, len(model.languages))).astype(np.float32) * 6
    for _ in range(20):
        s = rng.integers(0, 5, size=6).astype(np.int32)
        value = lambda p: sum(scores[w, k] for w, k in zip(s, p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))
        (path,) = model.paths([s], scores)
        assert value(path) == pytest.approx(max(map(value, product(range(len(model.languages)), repeat=6))), abs=1e-4)


def test_language_without_labels(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    model = language.train(df.where("lang is null"))
    assert {r[0] for r in df.select(language.identify(model, df, F.col("text"))["lang"]).collect()} == {"und"}


def brute_kneser_ney(train: list[bytes], text: bytes) -> float:
    """log2 probability per byte, from dictionaries of n-grams; discounts as the operator estimates them."""
    order = quality.ORDER
    grams = Counter()
    for t in train:
        p = b"\xff" * (order - 1) + t + b"\xff"
        grams.update(p[i - order + 1 : i + 1] for i in range(order - 1, len(p)))
    levels = [grams]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    tables = []
    for c in levels:
        ones = np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
        totals, by_context = Counter(), defaultdict(list)
        for g, v in c.items():
            totals[g[:-1]] += v
            by_context[g[:-1]].append(v)
        tables.append((c, quality.discounts(ones), totals, by_context))

    def p(gram: bytes) -> float:
        c, d, totals, by_context = tables[len(gram) - 1]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / 256
        total = totals[gram[:-1]]
        if not total:
            return lower
        freed = sum(d[min(v, 3)] for v in by_context[gram[:-1]])
        return (max(c[gram] - d[min(c[gram], 3)], 0) + freed * lower) / total

    padded = b"\xff" * (order - 1) + text + b"\xff"
    return -sum(math.log2(p(padded[i - order + 1 : i + 1])) for i in range(order - 1, len(padded))) / (len(text) + 1)


def test_quality_perplexity_is_the_brute_force_one(spark):
    docs = [d for d in documents() if d[0] is not None and d[0] != 106]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    trusted = df.where("doc_id < 40").select("doc_id")
    found = quality.document_perplexity(df, trusted, chunk_bytes=4000).collect()
    fitted = [(d[1] or "").encode() for d in docs if d[0] in {r["doc_id"] for r in found if r["fitted"]}]
    assert 5 < len(fitted) < 35
    own = {d[0]: round(brute_kneser_ney(fitted, (d[1] or "").encode()), 5) for d in docs}
    assert {r["doc_id"]: round(r["bits_per_byte"], 5) for r in found} == own


def test_quality_edges(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    found = quality.classify(df, df.where("doc_id < 40").select("doc_id")).collect()
    assert len(found) == len(docs)
    assert all(r["keep"] for r in found if r["doc_id"] in (100, 101))
    assert all(r["keep"] for r in quality.classify(df, df.limit(0).select("doc_id")).collect())
    assert quality.classify(df.limit(0), df.select("doc_id")).count() == 0


def test_quality_keeps_clean_rows(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {r["quality"]: r["k"] for r in found.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.95 and kept[0] < kept[1]


def test_shards_of_a_chunk_are_found_by_one_sort():
    """The same places as one comparison for each shard, and about the same time for many shards as for few."""
    import time

    import numpy as np

    from marketlens.llm.lookups import by_shard

    r = np.random.default_rng(1)
    for n, shards in ((0, 3), (1, 1), (5000, 40)):
        s = r.integers(0, shards, n)
        assert [(k, p.tolist()) for k, p in by_shard(s)] == [(int(k), np.flatnonzero(s == k).tolist()) for k in np.unique(s)]
    took = []
    for shards in (32, 62_500):
        s = r.integers(0, shards, 4_000_000)
        began = time.process_time()
        assert sum(len(p) for _, p in by_shard(s)) == len(s)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5
