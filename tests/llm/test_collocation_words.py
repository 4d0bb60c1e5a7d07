"""Words of a shard are numbered and hashed as arrays, alike in shards and filters."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd

from marketlens.llm import collocations

ALL = np.full(collocations._BITS // 8, 255, dtype=np.uint8)


def test_python_calls_do_not_grow_with_words():
    def calls(words: int) -> int:
        text = " ".join(f"w{k}" for k in range(words)).encode()
        made = [0]

        def seen(frame, event, arg):
            made[0] += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            found = sum(b.num_rows for b in collocations._shard_counts([("en", text)], 2, [ALL]))
        finally:
            sys.setprofile(None)
        assert found == words - 1
        return made[0]

    assert calls(8000) < calls(1000) + 1000


def test_filters_hold_the_hashes_of_shards():
    parts = [("en", b"A b\x00 c, d\te"), ("de", "ç b.a".encode()), ("en", b""), ("de", b" \t ")]
    shard = collocations._Shard(parts)
    h, names = shard.hashes(), [x.decode() for x in shard.names.to_pylist()]
    assert names[0] == "" and sorted(names[1:]) == sorted(["a", "b\0", "c", "d", "e", "ç", "b", "a"])
    langs = [shard.langs[k] for k in shard.lang_of]
    assert len(set(h[1:].tolist())) == len(names) - 1
    assert collocations._phrase_hashes(pd.Series(langs[1:]), pd.Series(names[1:])).tolist() == h[1:].tolist()
    pairs = [(a, b) for a, b in zip(shard.ids, shard.ids[1:]) if a and b]
    assert [(langs[a], f"{names[a]} {names[b]}") for a, b in pairs] == [("en", "a b\0"), ("en", "b\0 c"), ("en", "d e"), ("de", "ç b")]
    found = collocations._phrase_hashes(pd.Series([langs[a] for a, _ in pairs]), pd.Series([f"{names[a]} {names[b]}" for a, b in pairs]))
    assert found.tolist() == [int(collocations._joined(h[[a]], h[[b]])[0]) for a, b in pairs]
    assert len(collocations._phrase_hashes(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0
    assert collocations._Shard([]).hashes().tolist() == [0]
