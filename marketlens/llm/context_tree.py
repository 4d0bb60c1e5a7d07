"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, and a context is the up to ``DEPTH`` bytes before it; texts begin after bytes 0xFF,
which UTF-8 never has, and end with one, which is coded too.  Every node of the context tree keeps, for each
of the 255 bit positions inside a byte, Krichevsky-Trofimov counts from the training texts.  A node's weighted
probability is half its own KT probability and half the product of its children's; what a node predicts
mixes its own estimate with its child's by the resulting odds, over all depths.  A context that training
never saw predicts as its parent does.

Counts come from distinct byte n-grams of chunks, summed in shards (see ``lookups``).  A shard owns all
contexts with the same last two bytes, so it holds whole subtrees; the two levels above are at most
256 * 255 nodes, which the driver adds up.  Values per n-gram go back to the chunks, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.arrays import pack, unpack
from marketlens.llm.lookups import answers, by_shard, chunks, read_blob, shard_count, totals
from marketlens.llm.shingles import mix64, runs, word_hashes
from marketlens.storage import Scratch

DEPTH = 5
_U = np.uint64
_PIECE = 1_000_000
WORDS, GRAMS = 0, 1


def log_gamma(z: np.ndarray) -> np.ndarray:
    """For z > 0: Stirling's series at z + 8, less the logarithms of the steps up to there."""
    steps = np.zeros_like(z)
    for i in range(8):
        steps += np.log(z + i)
    w = z + 8
    return (w - 0.5) * np.log(w) - w + 0.9189385332046727 + 1 / (12 * w) - 1 / (360 * w**3) - steps


_HALF = float(log_gamma(np.array([0.5]))[0])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The KT estimator's log probability of a string with so many zeros and ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * _HALF - log_gamma(n0 + n1 + 1.0)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte, its key (the bytes before it, nearest first, then itself), and how many each text has."""
    pad = b"\xff" * DEPTH
    b = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + DEPTH)
    key = np.zeros(len(b), dtype=np.uint64)
    for d in range(DEPTH, 0, -1):
        key[d:] |= b[:-d].astype(np.uint64) << _U(8 * (DEPTH + 1 - d))
    key |= b
    coded = np.ones(len(b), dtype=bool)
    for i in range(DEPTH):
        coded[ends - sizes - DEPTH + i] = False
    return key[coded], sizes


def _pieces(texts: list[bytes]) -> list[tuple[int, int]]:
    """Runs of texts of bounded size together; a long text is a run of its own."""
    return runs([len(t) + DEPTH + 1 for t in texts], _PIECE)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]).astype(np.int64)
    return word_hashes(b"\n".join(texts), starts)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs with weight."""
    if len(keys) and weight.any() and not int(keys.max()) >> 63:
        # One sort does for both, with the weight as the last bit.
        s = np.sort((keys << _U(1)) | weight)
        k = s >> _U(1)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat((s & _U(1)).astype(np.int64), first)
    seen = np.unique(keys)
    own, n = np.unique(keys[weight], return_counts=True)
    counts = np.zeros(len(seen), dtype=np.int64)
    counts[np.searchsorted(seen, own)] = n
    return seen, counts


def _shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    lead = keys >> _U(8 * (DEPTH - 1)) if kind == GRAMS else keys
    return (mix64(lead + _U(1)) % _U(shards)).astype(np.int64)


def chunk_keys(texts: list[bytes], train: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words, grams = [], []
    for a, b in _pieces(texts):
        h, n = _words(texts[a:b])
        words.append(_distinct(h, np.repeat(train[a:b], n)))
        g, n = gram_keys(texts[a:b])
        grams.append(_distinct(g, np.repeat(train[a:b], n)))
    out = []
    for kind, parts in ((WORDS, words), (GRAMS, grams)):
        k, c = _counted(parts)
        out.append((k, c, _shard_of(kind, k, shards)))
    return out


class _Level:
    """One depth of a subtree: distinct (context, byte) in order, with the eight bit nodes above each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.first, self.n, self.n1, self.of = [], [], [], []
        for bit in range(8):
            node = keys >> _U(8 - bit)
            new = np.concatenate([[True], node[1:] != node[:-1]])
            first = np.flatnonzero(new)
            one = (keys >> _U(7 - bit)) & _U(1) == 1
            self.first.append(first)
            self.of.append(np.cumsum(new) - 1)
            self.n.append(np.add.reduceat(self.counts, first))
            self.n1.append(np.add.reduceat(self.counts * one, first))

    def parents(self) -> tuple["_Level", np.ndarray]:
        """The level with one context byte less, and where each entry of this one lies in it."""
        up = ((self.keys >> _U(16)) << _U(8)) | (self.keys & _U(0xFF))
        keys, at = np.unique(up, return_inverse=True)
        return _Level(keys, np.bincount(at, weights=self.counts)), at


def _bits(levels: list[_Level], links: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Mixed predictions of the last level's entries for each of their eight bits, down from the first level's nodes.

    Also, for each bit, the first level's nodes: their log weighted probabilities, counts and first entries.
    """
    shape = len(levels[-1].keys)
    predicted = np.empty((8, shape))
    roots = []
    for bit in range(8):
        weighted, odds = None, []
        for depth in range(len(levels) - 1, -1, -1):
            lv = levels[depth]
            own = log_kt(lv.n[bit] - lv.n1[bit], lv.n1[bit])
            if weighted is None:
                log_w, ratio = own, np.full(len(own), np.inf)
            else:
                below = levels[depth + 1]
                child_first = links[depth][below.first[bit]]
                children = np.bincount(lv.of[bit][child_first], weights=weighted, minlength=len(own))
                ratio = own - children
                log_w = np.logaddexp(own, children) - np.log(2.0)
            weighted = log_w
            odds.insert(0, ratio)
        roots.append((weighted, levels[0].n[bit], levels[0].first[bit]))
        # From the deepest node up, for each entry of the last level.
        at = np.arange(shape)
        p, seen = None, None
        for depth in range(len(levels) - 1, -1, -1):
            lv = levels[depth]
            node = lv.of[bit][at]
            one = (lv.keys[at] >> _U(7 - bit)) & _U(1) == 1
            n, n1 = lv.n[bit][node], lv.n1[bit][node]
            kt = (np.where(one, n1, n - n1) + 0.5) / (n + 1.0)
            if p is None:
                p = kt
            else:
                share = 1.0 / (1.0 + np.exp(np.clip(-odds[depth][node], -700, 700)))
                p = np.where(seen, share * kt + (1 - share) * p, kt)
            seen = n > 0
            if depth:
                at = links[depth - 1][at]
        predicted[bit] = p
        predicted[bit][~seen] = np.nan
    return predicted, roots


def _subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[list[_Level], list[np.ndarray]]:
    """Levels of depth 2 to ``DEPTH``, shallowest first."""
    levels, links = [_Level(keys, counts)], []
    while len(levels) < DEPTH - 1:
        up, at = levels[0].parents()
        levels.insert(0, up)
        links.insert(0, at)
    return levels, links


def _top_rows(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """What the levels above need of a shard: for each last byte, bit node and value sums."""
    levels, links = _subtrees(keys, counts)
    _, roots = _bits(levels, links)
    parts = []
    for bit, (weighted, n, first) in enumerate(roots):
        entry = levels[0].keys[first]
        c1 = (entry >> _U(16)) & _U(0xFF)
        node = (_U(1) << _U(bit)) | ((entry & _U(0xFF)) >> _U(8 - bit))
        parts.append(pd.DataFrame({"c1": c1.astype(np.int64), "node": node.astype(np.int64), "log_w": weighted, "n1": levels[0].n1[bit], "n": n}))
    return pd.concat(parts).groupby(["c1", "node"], as_index=False).sum()


class Top:
    """Depths 0 and 1: for each bit node, the KT estimate of a one and the odds against what is deeper."""

    def __init__(self, rows: list):
        n, n1, children = (np.zeros((256, 256)) for _ in range(3))
        for r in rows:
            n[r["c1"], r["node"]], n1[r["c1"], r["node"]], children[r["c1"], r["node"]] = r["n"], r["n1"], r["log_w"]
        own = log_kt(n - n1, n1)
        self.n, self.kt, self.odds = n, (n1 + 0.5) / (n + 1.0), own - children
        below = np.where(n > 0, np.logaddexp(own, children) - np.log(2.0), 0.0).sum(0)
        m, m1 = n.sum(0), n1.sum(0)
        self.kt0, self.odds0 = (m1 + 0.5) / (m + 1.0), log_kt(m - m1, m1) - below

    def log10(self, keys: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """log10 probabilities of n-grams, given the eight predictions from depth 2 on (nan: not seen there)."""
        c1 = ((keys >> _U(8 * DEPTH)) & _U(0xFF)).astype(np.int64)
        x = keys & _U(0xFF)
        total = np.zeros(len(keys))
        for bit in range(8):
            node = ((_U(1) << _U(bit)) | (x >> _U(8 - bit))).astype(np.int64)
            one = (x >> _U(7 - bit)) & _U(1) == 1
            kt1 = np.where(one, self.kt[c1, node], 1 - self.kt[c1, node])
            share = 1.0 / (1.0 + np.exp(np.clip(-self.odds[c1, node], -700, 700)))
            p = np.where(np.isnan(deeper[bit]), kt1, share * kt1 + (1 - share) * deeper[bit])
            kt0 = np.where(one, self.kt0[node], 1 - self.kt0[node])
            share = 1.0 / (1.0 + np.exp(np.clip(-self.odds0[node], -700, 700)))
            total += np.log10(np.where(self.n[c1, node] > 0, share * kt0 + (1 - share) * p, kt0))
        return total


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 24_000_000, shards: int | None = None) -> DataFrame:
    """Scores of all whole texts by models of those rows where ``train`` holds.

    Returns ``doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.
    ``score`` is the log10 probability of the text's bytes and its end under the context tree.  ``base_score`` is
    that of its lower-cased words and one end under add-one unigrams of the training texts, ``train_tokens`` their
    number of tokens, ``n_known`` how many of the text's tokens they have.  Null texts count as empty: only the end is coded.
    With no training text at all, every bit has probability one half.  Repeated rows are scored, and learned from, each.
    Other columns are ignored.  Words are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "context-tree")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.lit(None).cast("string").alias("tag"))
    shards = shards or shard_count(rows)
    written = scratch.table(chunks(rows, lambda t, flags: chunk_keys(t, flags, shards), shards, chunk_bytes), "chunks")
    blobs, asked = written.where("kind = -1").select("chunk", "blob"), written.where("kind >= 0").select("chunk", "kind", "shard", "keys", "counts")
    n_chunks = blobs.select("chunk").count()
    summed = scratch.table(totals(asked, n_chunks), "totals")

    def word_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [unpack(c, np.int64) for c in pdf["counts"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in counts], "v": [int((c > 0).sum()) for c in counts]})

    n_words, n_distinct = summed.where(F.col("kind") == WORDS).select("counts").mapInPandas(word_facts, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.where("train").count()
    tokens, distinct = n_words + ends, n_distinct + (ends > 0)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, c in zip(pdf["keys"], pdf["counts"]):
                keys = unpack(k, np.uint64, ascending=True)
                if len(keys):
                    yield _top_rows(keys, unpack(c, np.int64))

    gram_totals = summed.where(F.col("kind") == GRAMS)
    tree = gram_totals.select("keys", "counts").mapInPandas(tops, "c1 long, node long, log_w double, n1 double, n double")
    # In a fixed order: sums of doubles must not depend on which task ends first.
    top = Top(tree.groupBy("c1", "node").agg(F.aggregate(F.array_sort(F.collect_list("log_w")), F.lit(0.0), lambda a, x: a + x).alias("log_w"), F.sum("n1").alias("n1"), F.sum("n").alias("n")).collect())
    sent = spark.sparkContext.broadcast(top)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, shard, k, c in zip(pdf["kind"], pdf["shard"], pdf["keys"], pdf["counts"]):
                keys, counts = unpack(k, np.uint64, ascending=True), unpack(c, np.int64)
                if kind == GRAMS and len(keys):
                    v = sent.value.log10(keys, _bits(*_subtrees(keys, counts))[0])
                else:
                    v = counts.astype(np.float64)
                yield pd.DataFrame({"kind": [kind], "shard": [shard], "keys": [k], "values": [pack(v)]})

    valued = summed.mapInPandas(values, "kind int, shard int, keys binary, values binary")
    back = answers(asked, valued, n_chunks, "float64")
    columns = ["doc_id", "train", "n_bytes", "n_tokens", "n_known", "base_score", "score"]

    def score(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ids, flags, texts, _ = read_blob(own["blob"].iloc[0])
        # The keys only: nothing is counted again.
        (wk, _, ws), (gk, _, gs) = chunk_keys(texts, np.zeros(len(texts), dtype=bool), shards)
        wv, gv = np.zeros(len(wk)), np.zeros(len(gk))
        places = {WORDS: dict(by_shard(ws)), GRAMS: dict(by_shard(gs))}
        for kind, shard, v in zip(known["kind"], known["shard"], known["values"]):
            (wv if kind == WORDS else gv)[places[kind][shard]] = unpack(v, np.float64)
        norm = np.log10(tokens + distinct + 1.0)
        base_of, end = np.log10(wv + 1.0) - norm, np.log10(ends + 1.0) - norm
        out = []
        for a, b in _pieces(texts):
            h, n_words = _words(texts[a:b])
            g, n_grams = gram_keys(texts[a:b])
            w_at, g_at = 0, 0
            for i, nw, ng in zip(range(a, b), n_words.tolist(), n_grams.tolist()):
                w = np.searchsorted(wk, np.sort(h[w_at : w_at + nw]))
                s = gv[np.searchsorted(gk, np.sort(g[g_at : g_at + ng]))]
                w_at, g_at = w_at + nw, g_at + ng
                out.append((ids[i], bool(flags[i]), ng - 1, nw + 1, int((wv[w] > 0).sum()) + (ends > 0), float(base_of[w].sum() + end), float(s.sum())))
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    scored = blobs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    bits = -F.col("score") / F.lit(float(np.log10(2.0))) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "train", "n_bytes", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
