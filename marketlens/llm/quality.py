"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each byte of a text, and its end, from the three before it.  Trusted rows fall into two halves by a
hash of their id: the model is fitted on all of one half, thresholds come from all of the other.  Ids meet the trusted ones
without their texts, and the chunks of texts learn which of their rows are fitted.  Counts and values travel as distinct
n-grams of chunks to shards and back (see ``lookups``): a join of counts, sharded by the last two bytes of the
context.  Continuation counts and discounts of the two lowest orders have at most 256 * 256 entries, which
the driver holds.  Each document's perplexity then meets the threshold of its language, a quantile over trusted
documents that the model was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.arrays import pack, unpack
from marketlens.llm.lookups import CHUNK, answers, asked_keys, by_shard, flags_of, merge, places, read_blob, shard_count, text_chunks, totals
from marketlens.llm.shingles import mix64, runs
from marketlens.storage import Scratch

ORDER = 4
_U = np.uint64
_BYTE = _U(0xFF)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes and ends: nearest byte before, the two before that, itself; and how many each text has."""
    pad = b"\xff" * (ORDER - 1)
    b = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    key = b.astype(np.uint64)
    for d in range(1, ORDER):
        key[d:] |= b[:-d].astype(np.uint64) << _U(8 * (ORDER - d))
    coded = np.ones(len(b), dtype=bool)
    for i in range(ORDER - 1):
        coded[ends - sizes - (ORDER - 1) + i] = False
    return key[coded], sizes


def _runs(texts: list[bytes]) -> list[tuple[int, int]]:
    return runs([len(t) + ORDER for t in texts], 2_000_000)


def chunk_keys(texts: list[bytes], train: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    parts = []
    for a, b in _runs(texts):
        keys, n = gram_keys(texts[a:b])
        seen = np.unique(keys)
        own, times = np.unique(keys[np.repeat(train[a:b], n)], return_counts=True)
        counts = np.zeros(len(seen), dtype=np.int64)
        counts[np.searchsorted(seen, own)] = times
        parts.append((pack(seen, ascending=True), pack(counts)))
    keys, counts = merge(parts)
    return [(keys, counts, (mix64((keys >> _U(16)) + _U(1)) % _U(shards)).astype(np.int64))]


def _continuations(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams without their farthest byte, how many seen grams extend each, and where each gram lies in them."""
    low = ((keys >> _U(16)) << _U(8)) | (keys & _BYTE)
    distinct, at = np.unique(low, return_inverse=True)
    return distinct, np.bincount(at, weights=counts > 0), at


def discounts(ones: np.ndarray) -> np.ndarray:
    """The discount of counts 0, 1, 2 and 3 or more, from how many grams have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in ones)
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in zip((0.95, 1.95, 2.95), d))])


def interpolate(context: np.ndarray, counts: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted estimates plus what was discounted times ``lower``; contexts never seen give ``lower``."""
    _, of = np.unique(context, return_inverse=True)
    kind = np.minimum(counts, 3).astype(np.int64)
    total = np.bincount(of, weights=counts)[of]
    freed = np.bincount(of, weights=d[kind])[of]
    return np.where(total > 0, (np.maximum(counts - d[kind], 0) + freed * lower) / np.maximum(total, 1), lower)


class LowOrders:
    """The two lowest orders from continuation counts of (byte before, byte), and the discounts of the upper ones."""

    def __init__(self, pairs: np.ndarray, ones: np.ndarray):
        single = (pairs > 0).sum(0).astype(np.float64)
        as_ones = lambda c: np.array([(c == k).sum() for k in (1, 2, 3, 4)])
        p1 = interpolate(np.zeros(256, dtype=np.int64), single, np.full(256, 1 / 256), discounts(as_ones(single)))
        d2 = discounts(as_ones(pairs))
        self.p2 = interpolate(np.repeat(np.arange(256), 256), pairs.reshape(-1), np.tile(p1, 256), d2).reshape(256, 256)
        self.d3, self.d4 = discounts(ones[0]), discounts(ones[1])

    def log2(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        low, more, at = _continuations(keys, counts)
        x = (low & _BYTE).astype(np.int64)
        p3 = interpolate(low >> _U(8), more, self.p2[((low >> _U(16)) & _BYTE).astype(np.int64), x], self.d3)
        return np.log2(interpolate(keys >> _U(8), counts.astype(np.float64), p3[at], self.d4))


def document_perplexity(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = 24_000_000) -> DataFrame:
    """``doc_id, lang, fitted, n_bytes, bits_per_byte, perplexity`` for every row.

    ``trusted`` has the ids (``id_col``) of trusted rows; the half of them with an even hash is fitted on.  Perplexity is per byte, ends included.  Null texts count as empty.  Without
    trusted rows every byte has probability 1/256.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    ids = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    half = ids.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("tag"), F.lit(False).alias("train"))
    shards = shard_count(rows)
    texts_of = scratch.table(text_chunks(rows, chunk_bytes), "texts")
    fitted = scratch.table(places(texts_of, half), "fitted")
    blobs = texts_of.select("chunk", "blob").join(fitted, "chunk", "left")
    n_chunks = texts_of.select("chunk").count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, blob, packed in zip(pdf["chunk"].tolist(), pdf["blob"], pdf["places"]):
                _, _, texts, _ = read_blob(blob)
                yield asked_keys(chunk, chunk_keys(texts, flags_of(packed, len(texts)), shards))

    asked = scratch.table(blobs.mapInPandas(count, CHUNK).select("chunk", "kind", "shard", "keys", "counts"), "chunks")
    summed = scratch.table(totals(asked, n_chunks), "totals")

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs, ones = np.zeros((256, 256), dtype=np.int64), np.zeros((2, 4), dtype=np.int64)
            for k, c in zip(pdf["keys"], pdf["counts"]):
                keys, counts = unpack(k, np.uint64, ascending=True), unpack(c, np.int64)
                low, more, _ = _continuations(keys, counts)
                seen = low[more > 0]
                np.add.at(pairs, (((seen >> _U(16)) & _BYTE).astype(np.int64), (seen & _BYTE).astype(np.int64)), 1)
                for j, c_ in enumerate((more, counts)):
                    ones[j] += [(c_ == n).sum() for n in (1, 2, 3, 4)]
            at = np.flatnonzero(pairs.reshape(-1))
            yield pd.DataFrame({"at": np.concatenate([at, 65536 + np.arange(8)]), "n": np.concatenate([pairs.reshape(-1)[at], ones.reshape(-1)])})

    table = np.zeros(65536 + 8, dtype=np.int64)
    for r in summed.select("keys", "counts").mapInPandas(facts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r["n"]
    low = spark.sparkContext.broadcast(LowOrders(table[:65536].reshape(256, 256).astype(np.float64), table[65536:].reshape(2, 4)))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [pack(low.value.log2(unpack(k, np.uint64, ascending=True), unpack(c, np.int64))) for k, c in zip(pdf["keys"], pdf["counts"])]
            yield pd.DataFrame({"kind": pdf["kind"], "shard": pdf["shard"], "keys": pdf["keys"], "values": made})

    back = answers(asked, summed.mapInPandas(values, "kind int, shard int, keys binary, values binary"), n_chunks, "float64")
    columns = ["doc_id", "lang", "fitted", "n_bytes", "log2_p"]

    def score(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        doc_ids, _, texts, langs = read_blob(own["blob"].iloc[0])
        flags = flags_of(own["places"].iloc[0], len(texts))
        ((keys, _, of),) = chunk_keys(texts, flags, shards)
        v, places = np.zeros(len(keys)), dict(by_shard(of))
        for shard, packed in zip(known["shard"], known["values"]):
            v[places[shard]] = unpack(packed, np.float64)
        out = []
        for a, b in _runs(texts):
            g, n = gram_keys(texts[a:b])
            sums = np.add.reduceat(v[np.searchsorted(keys, g)], np.concatenate([[0], np.cumsum(n)[:-1]]))
            out += [(doc_ids[i], langs[i], bool(flags[i]), int(k) - 1, float(s)) for i, k, s in zip(range(a, b), n, sums)]
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    scored = blobs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, "doc_id long, lang string, fitted boolean, n_bytes long, log2_p double")
    bits = -F.col("log2_p") / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "lang", "fitted", "n_bytes", bits.alias("bits_per_byte"), F.pow(F.lit(2.0), bits).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.965, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, keep`` for every row.

    The threshold of a language is the ``quantile`` (by nearest rank, on perplexities rounded to thousandths) over its
    trusted rows that were not fitted on; the README says by which labelled rows it was chosen.  A language without any takes that of all languages, and without any trusted row
    everything is kept.  Texts without bytes are kept: they have nothing to judge.  Null languages are one language.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.table(document_perplexity(docs, trusted, id_col=id_col, **options), "scored")
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    held = scored.where("not fitted and n_bytes > 0").join(ids, "doc_id", "left_semi")
    bins = held.groupBy("lang", F.round("perplexity", 3).alias("p")).agg(F.count("*").alias("n"))
    bins = bins.unionByName(bins.groupBy("p").agg(F.sum("n").alias("n")).select(F.lit("*all*").alias("lang"), "p", "n"))
    w = Window.partitionBy("lang").orderBy("p")
    ranked = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    limits = scratch.table(ranked.where(F.col("upto") >= F.ceil(F.lit(quantile) * F.col("all"))).groupBy("lang").agg(F.min("p").alias("threshold")), "limits")
    everyone = limits.where("lang = '*all*'").select(F.max("threshold")).first()[0]
    joined = scored.alias("s").join(limits.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    out = joined.select("doc_id", "s.lang", "n_bytes", "perplexity", F.coalesce("threshold", F.lit(everyone).cast("double")).alias("threshold"))
    keep = (F.col("n_bytes") == 0) | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))
