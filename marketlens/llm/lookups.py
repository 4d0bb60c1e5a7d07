"""Counting keys over a corpus and bringing results back to its texts, without a row per occurrence.

Texts are gathered into chunks.  A chunk sends each of its distinct 64-bit keys once, with a count, to the shard
that owns the key; shards add up, compute a value per key, and send the values back to the chunks that asked.
A frequent key is therefore one entry per chunk, whatever its number of occurrences.  Shards that many chunks
write to are summed in lanes first, so a group is bounded by its distinct keys and by the lane's chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.arrays import pack, unpack

_COLUMNS = ["chunk", "kind", "shard", "n", "keys", "counts", "blob"]
CHUNK = "chunk long, kind int, shard int, n long, keys binary, counts binary, blob binary"
#: Chunks whose keys are summed in one lane, and chunks that get their answers in one: each lane of the latter gets a shard's values once.
_LANE, _ANSWER_LANE = 64, 512
#: Bytes of text for each shard, about.
_SHARD_BYTES = 16_000_000
Keys = Callable[[list[bytes], np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def write_blob(ids: list, train: list[bool], texts: list[bytes], tags: list[str | None]) -> bytes:
    known = np.array([i is not None and i == i for i in ids], dtype=np.uint8)
    told = json.dumps(tags).encode()
    head = [np.array([len(texts)], dtype="<i8"), np.array([int(i) if k else 0 for i, k in zip(ids, known)], dtype="<i8"), np.array([len(t) for t in texts], dtype="<i8"), known, np.array(train, dtype=np.uint8)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*[h.tobytes() for h in head], *texts, told]))


def read_blob(blob: bytes) -> tuple[list, np.ndarray, list[bytes], list[str | None]]:
    """Ids, train flags, texts and tags of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    known, train = np.frombuffer(raw, np.uint8, n, 8 + 16 * n), np.frombuffer(raw, np.uint8, n, 8 + 17 * n)
    ends = (8 + 18 * n + np.cumsum(sizes)).tolist()
    texts = [raw[e - s : e] for e, s in zip(ends, sizes.tolist())]
    return [int(i) if k else None for i, k in zip(ids, known)], train.astype(bool), texts, json.loads(raw[ends[-1] if ends else 8 :])


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its keys, in order: one sort, whatever the number of shards."""
    order = np.argsort(shards, kind="stable")
    found, first = np.unique(shards[order], return_index=True)
    for shard, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield shard, order[a:b]


def chunks(docs: DataFrame, keys: Keys, shards: int, chunk_bytes: int) -> DataFrame:
    """Rows of ``CHUNK`` from ``doc_id, text, train``: for each chunk its texts (kind -1), and its distinct keys by kind and shard.

    ``keys`` gives, for texts and their train flags, the keys, counts and shard numbers of each kind, keys ascending.
    """

    def close(chunk: int, ids: list, train: list, texts: list, tags: list) -> pd.DataFrame:
        blob = pd.DataFrame([(chunk, -1, -1, len(texts), None, None, write_blob(ids, train, texts, tags))], columns=_COLUMNS)
        return pd.concat([blob, asked_keys(chunk, keys(texts, np.array(train, dtype=bool)))], ignore_index=True)

    return _gathered(docs, close, CHUNK, chunk_bytes)


def asked_keys(chunk: int, keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """The rows of a chunk's keys, by kind and shard."""
    out = []
    for kind, (k, c, s) in enumerate(keys):
        for shard, own in by_shard(s):
            out.append((chunk, kind, shard, len(own), pack(k[own], ascending=True), pack(c[own].astype(np.int64)), None))
    return pd.DataFrame(out, columns=_COLUMNS)


def text_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, ids, blob`` from ``doc_id, text, train``: texts alone, for keys that depend on which rows are wanted (``places``)."""

    def close(chunk: int, ids: list, train: list, texts: list, tags: list) -> pd.DataFrame:
        told = [int(i) if i is not None and i == i else None for i in ids]
        return pd.DataFrame({"chunk": [chunk], "ids": [told], "blob": [write_blob(ids, train, texts, tags)]})

    return _gathered(docs, close, "chunk long, ids array<long>, blob binary", chunk_bytes)


def places(gathered: DataFrame, wanted: DataFrame) -> DataFrame:
    """``chunk, places``: where in each chunk of ``gathered`` the rows with a wanted ``id`` are.  Ids meet without their texts; a chunk gets a byte or so for each hit."""

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "places": [pack(np.sort(pdf["at"].to_numpy()).astype(np.uint64), ascending=True)]})

    ids = gathered.select("chunk", F.posexplode("ids").alias("at", "id")).where("id is not null")
    return ids.join(wanted.select("id"), "id", "left_semi").groupBy("chunk").applyInPandas(tell, "chunk long, places binary")


def flags_of(packed: bytes | None, n: int) -> np.ndarray:
    """Flags of a chunk's ``n`` rows from its ``places``."""
    flags = np.zeros(n, dtype=bool)
    if packed is not None:
        flags[unpack(packed, np.uint64, ascending=True).astype(np.int64)] = True
    return flags


def _gathered(docs: DataFrame, close: Callable[..., pd.DataFrame], schema: str, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids, train, texts, tags = [], [], [], []
        for pdf in batches:
            for i, t, text, tag in zip(pdf["doc_id"].tolist(), pdf["train"].tolist(), pdf["text"].tolist(), pdf["tag"].tolist()):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                ids.append(i)
                train.append(bool(t))
                texts.append(raw)
                tags.append(tag)
                size += len(raw)
                if size >= chunk_bytes:
                    yield close(chunk, ids, train, texts, tags)
                    chunk, size, ids, train, texts, tags = chunk + 1, 0, [], [], [], []
        if texts:
            yield close(chunk, ids, train, texts, tags)

    return docs.select("doc_id", "text", "train", "tag").mapInPandas(run, schema)


def merge(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys of packed rows and the sums of their counts."""
    k = np.concatenate([unpack(a, np.uint64, ascending=True) for a, _ in rows])
    c = np.concatenate([unpack(b, np.int64) for _, b in rows])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _lanes(n_chunks: int, chunks: int) -> int:
    return max(1, -(-n_chunks // chunks))


def shard_count(texts: DataFrame) -> int:
    """Shards for the column ``text``: as many as its size asks for, and at least one for each shuffle partition."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(16, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _SHARD_BYTES)


def totals(asked: DataFrame, n_chunks: int) -> DataFrame:
    """``kind, shard, keys, counts``: summed over all chunks."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = merge(list(zip(pdf["keys"], pdf["counts"])))
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "keys": [pack(k, ascending=True)], "counts": [pack(c)]})

    schema = "kind int, shard int, keys binary, counts binary"
    lanes = _lanes(n_chunks, _LANE)
    rows = asked.select("kind", "shard", "keys", "counts", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).alias("lane"))
    if lanes > 1:
        rows = rows.groupBy("kind", "shard", "lane").applyInPandas(add, schema)
    return rows.groupBy("kind", "shard").applyInPandas(add, schema)


def answers(asked: DataFrame, valued: DataFrame, n_chunks: int, dtype: str) -> DataFrame:
    """``chunk, kind, shard, values``: for each chunk's keys, in their order, the values of ``valued`` (``kind, shard, keys, values``)."""

    def look_up(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(known):
            keys, values = unpack(known["keys"].iloc[0], np.uint64, ascending=True), unpack(known["values"].iloc[0], dtype)
            for chunk, kind, shard, k in zip(own["chunk"], own["kind"], own["shard"], own["keys"]):
                out.append((chunk, kind, shard, pack(values[np.searchsorted(keys, unpack(k, np.uint64, ascending=True))])))
        return pd.DataFrame(out, columns=["chunk", "kind", "shard", "values"])

    lanes = _lanes(n_chunks, _ANSWER_LANE)
    own = asked.select("chunk", "kind", "shard", "keys", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("long").alias("lane"))
    known = valued.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    both = own.groupBy("kind", "shard", "lane").cogroup(known.groupBy("kind", "shard", "lane"))
    return both.applyInPandas(look_up, "chunk long, kind int, shard int, values binary")
