"""Packing, mixing and media columns against what their results must satisfy."""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, documents, words  # noqa: E402

from marketlens.llm import flac  # noqa: E402
from marketlens.llm.media import describe_media, read_media, store_media  # noqa: E402
from marketlens.llm.mixing import mix_report, mix_segments, mix_texts  # noqa: E402
from marketlens.llm.packing import pack_documents, sweep_rounds  # noqa: E402


def brute_pieces(rows, capacity=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % capacity or capacity
        bounds = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out, key=repr)


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def check_places(found, capacity):
    at = defaultdict(list)
    for r in found:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing_edges(spark, capacity):
    docs = documents()
    found = pack_documents(spark.createDataFrame(docs, SCHEMA), capacity=capacity).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_pieces([d[:2] for d in docs], capacity)
    n = check_places(found, capacity)
    assert n <= best_fit_decreasing([r["length"] for r in found], capacity) * 1.01 + 1


def test_packing_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pack_documents(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    n = check_places(found, 1024)
    assert n <= best_fit_decreasing([r["length"] for r in found], 1024) * 1.01 + 1


def test_packing_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=12))
def test_sweeps_place_everything_once(counts):
    placed = defaultdict(int)
    for _, size, first, n, gap, _, _ in sweep_rounds(counts, 20):
        assert first == placed[size] and n > 0 and (gap is None or gap >= size)
        placed[size] += n
    assert dict(placed) == counts


def brute_targets(sizes: dict, share=1.5, most=2.0, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, budget, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def check_mix(rows: list[tuple], report: list) -> None:
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    target = brute_targets(sizes)
    own = sorted(((r[0], len(words(r[1])), sizes[r[3]], round(target[r[3]], 4)) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in report), key=repr) == own
    taken = defaultdict(int)
    for r in report:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 4)] += r["taken"]
    want = defaultdict(float)
    for s in sizes:
        want[sizes[s], round(target[s], 4)] += target[s]
    for k in want:
        assert abs(taken[k] - want[k]) <= len(sizes)


def test_mixing_edges(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    first = mix_report(df, block_words=32, shard_blocks=8).collect()
    check_mix(docs, first)
    again = mix_report(df.repartition(5), block_words=32, shard_blocks=8).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_mix([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], mix_report(docs).collect())


def test_mixing_segments_are_disjoint_in_a_pass(spark):
    rows, segments = mix_segments(spark.createDataFrame(documents(), SCHEMA), block_words=16, shard_blocks=4)
    sizes = {r["uid"]: r["size"] for r in rows.collect()}
    at = defaultdict(list)
    for s in segments.collect():
        at[s["uid"], s["pass"]].append((s["first_word"], s["n_words"]))
    for (uid, _), spans in at.items():
        end = 0
        for first, n in sorted(spans):
            assert first >= end
            end = first + n
        assert end <= sizes[uid]


def test_mixing_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_report(empty).count() == 0
    assert mix_texts(empty).columns == empty.columns


def test_mixed_texts_keep_columns_and_words(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    report = {r["doc_id"]: r["taken"] for r in mix_report(df).collect() if r["doc_id"] is not None}
    got = defaultdict(int)
    found = mix_texts(df)
    assert found.columns == df.columns
    for r in found.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    repeated = {107, None}
    assert {k: v for k, v in got.items() if k not in repeated} == {k: v for k, v in report.items() if v and k not in repeated}


def test_media_edges(spark):
    docs = documents()
    found = describe_media(read_media(store_media(spark.createDataFrame(docs, SCHEMA), block=256))).collect()
    own = []
    for doc_id, text, *_ in docs:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        own.append((doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(own, key=repr)
    by_payload = defaultdict(set)
    for r in found:
        by_payload[r["payload_sha256"]].add(tuple(r)[5:])
    assert all(len(v) == 1 for v in by_payload.values())


def test_media_empty(spark):
    assert describe_media(read_media(store_media(spark.createDataFrame([], SCHEMA)))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-128, 127), min_size=1, max_size=700), st.sampled_from([16, 100, 4096]), st.booleans())
def test_flac_round_trip(samples, block, linear):
    x = np.array(samples, dtype=np.int64)
    stream = flac.encode(x, block=block, predictor=((7, -3), 2, 5) if linear else None)
    info, blocks = flac.decode(stream)
    assert info["samples"] == len(x)
    assert [at for at, _ in blocks] == list(range(0, len(x), block))
    assert np.concatenate([b for _, b in blocks]).tolist() == samples


def test_flac_smooth_16_bit_uses_predictors():
    t = np.arange(20_000)
    x = (12_000 * np.sin(t / 40) + 500 * np.sin(t / 7)).astype(np.int64)
    for predictor in (None, ((1974, -983), 10, 12)):
        stream = flac.encode(x, width=16, predictor=predictor)
        assert len(stream) < len(x)
        assert np.concatenate([b for _, b in flac.decode(stream)[1]]).tolist() == x.tolist()


def test_flac_damage_is_found():
    stream = bytearray(flac.encode(np.arange(-100, 100, dtype=np.int64) % 50))
    for at in range(len(stream) - 20, len(stream)):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode(bytes(bad))
