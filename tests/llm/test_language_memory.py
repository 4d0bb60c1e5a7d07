"""Words of a slice are worked on in blocks: the same numbers, in bounded memory."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from marketlens.llm import language

LANGS = ["de", "en", "fr"]


def _words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéж", k=r.randint(1, 22))) for _ in range(n)]


def _model() -> language.LanguageModel:
    rng = np.random.default_rng(3)
    counts = {x: (rng.integers(0, 50, 1 << language.BITS), rng.integers(0, 50, len(language._NAMES))) for x in LANGS}
    return language.LanguageModel(counts, 8.0)


def test_labels_of_many_words_take_little_memory():
    words = _words(120_000, 5)
    model, text = _model(), " ".join(words)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        model.label([text], False)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert peak < 60 * len(text), f"{peak / 1e6:.0f} MB for {len(text) / 1e6:.1f} MB of text"


class _Rows:
    """Rows whose task runs here, so that a test can set the size of blocks."""

    def __init__(self, rows: list[tuple]):
        self.pdf = pd.DataFrame(rows, columns=["lang", "text"])

    def mapInPandas(self, run, schema):
        return pd.concat(run(iter([self.pdf])))


def test_blocks_change_nothing(monkeypatch):
    monkeypatch.setattr(language, "summed", lambda found, *_: SimpleNamespace(collect=lambda: found.to_dict("records")))
    model, words = _model(), sorted(set(_words(3000, 6)))
    whole = model.word_scores(words)
    rows = _Rows([(LANGS[k % 3], " ".join(words[k::9] * (1 + k))) for k in range(9)])
    learned = language._learn(rows)
    ids, grams = language.features(words)
    parts = []
    monkeypatch.setattr(language, "_BLOCK", 100)
    for a, _, i, g in language.blocks(words):
        parts.append((i + a, g))
    assert len(parts) > 100
    order = lambda x, y: sorted(zip(x.tolist(), y.tolist()))
    assert order(ids, grams) == order(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert np.array_equal(whole, model.word_scores(words))
    again = language._learn(rows)
    assert sorted(again) == sorted(learned) == LANGS
    assert all(np.array_equal(x, y) for k in LANGS for x, y in zip(learned[k], again[k]))
