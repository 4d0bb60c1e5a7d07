"""Pieces, spans and decoded texts against the ``sentencepiece`` library, with the model's own and with other character maps."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from marketlens.llm import pieces, queries

LETTERS = "abct he▁ \t\n.é€𐍈ｶﾞ①́　\x00\x7fﬁ½Ａ㌔"


def same(own: pieces.PieceModel, library, text: str) -> None:
    ids, starts, ends = own.encode(text)
    proto = library.encode(text, return_type="proto")
    assert [(p.id, p.begin, p.end) for p in proto.pieces] == list(zip(ids.tolist(), starts.tolist(), ends.tolist())), text[:60]
    assert own.decode(ids) == library.decode(ids.tolist())


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def any_ids(n: int, seed: int) -> list[list[int]]:
    r = random.Random(seed)
    return [[r.choice([0, 1, 2, 3, 5, 160, 200, 230, 259, 260, r.randrange(32000)]) for _ in range(r.randint(0, 10))] for _ in range(n)]


def test_pieces_of_the_model():
    own, library = pieces.model(pieces.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for t in [*texts(1500, 1), "a" * 100_000, " " * 100_000, "\t" * 50_000, "word " * 40_000, "ab" * 50_000]:
        same(own, library, t)
    for ids in any_ids(1500, 2):
        assert own.decode(ids) == library.decode(ids), ids


def _message(number: int, body: bytes) -> bytes:
    size, out = len(body), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + body


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_pieces_with_a_character_map(rule, squeeze, dummy):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True).serialized_model_proto()
    compiled = dict(pieces._fields(dict(pieces._fields(made))[3]))[2]
    with open(pieces.default_path(), "rb") as f:
        model = f.read()
    rules = _message(2, compiled) + bytes([3 << 3, dummy, 4 << 3, squeeze])
    model = b"".join(_message(n, rules if n == 3 else v) for n, v in pieces._fields(model))
    own, library = pieces.PieceModel(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in texts(600, 3):
        same(own, library, t)
    for ids in any_ids(300, 4):
        assert own.decode(ids) == library.decode(ids), ids


def test_other_kinds_of_models_are_refused():
    with open(pieces.default_path(), "rb") as f:
        model = f.read()
    with pytest.raises(ValueError):
        pieces.PieceModel(b"".join(_message(n, v + bytes([3 << 3, 1]) if n == 2 else v) for n, v in pieces._fields(model)))


def test_rows_of_every_kind(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "Hé €𐍈", "y"), (None, "  a b  ", None), (3, "  ", "z"), (4, "word " * 30_000, "z"), (4, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string").withColumnRenamed("ids", "starts")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    found = pieces.encode_texts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.ids) for r in found) == sorted((i or 0, len((t or "").encode()), library.encode(t or "")) for i, t, _ in rows)
    for r in found:
        assert len(r.ids) == len(r.starts) == len(r.ends)
    digests = pieces.digests(pieces.encode_texts(docs)).collect()
    assert len(digests) == len(rows) and all(r.covered for r in digests)
    assert pieces.digests(pieces.encode_texts(docs.limit(0))).collect() == []
    back = pieces.decode_ids(spark.createDataFrame([(1, None, "own"), (2, [15359], "own")], "a int, ids array<int>, decoded string")).collect()
    assert [(r.a, r.decoded) for r in back] == [(1, ""), (2, "Hi")]


def test_query_against_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        hexes = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        want.add((r.doc_id, len(ids), *hexes))
    found = queries.op11_sentencepiece(spark, sf_dir).collect()
    assert {tuple(r)[:4] for r in found} == want and all(r.covered for r in found)
