"""Language identification of mixed-language text.

The script of a word narrows its candidates to the languages that use it.  A word's score for a language is the log
likelihood of its hashed byte n-grams (one to four bytes, with word ends) under counts learned from labelled text.
Viterbi over the words, with a penalty for every switch, labels spans; the language of most letters is the document's.
The model has ``1 << BITS`` counts per language and script shares: bounded, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.arrays import pack, summed, unpack
from marketlens.llm.shingles import mix64, runs

BITS = 16
UNKNOWN = "und"
#: First and last code point of letters by script; what is in none of them is "other".
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
_NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
_FIRST = np.array([a for _, a, _ in SCRIPTS])
_LAST = np.array([b for _, _, b in SCRIPTS])
_OF = np.array([_NAMES.index(s) for s, _, _ in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of text that are worked on at a time, about; a longer text is worked on alone.
_SLICE = 4_000_000
#: Letters of different words whose n-grams are held at a time, about; each takes some hundred bytes.
_BLOCK = 1 << 17
#: Words times languages whose paths are held at a time; a longer text is worked on alone.
_STEPS = 6_000_000


def script_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    at = np.clip(np.searchsorted(_FIRST, first, side="right") - 1, 0, None)
    return np.where((first >= _FIRST[at]) & (first <= _LAST[at]), _OF[at], len(_NAMES) - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashed n-grams, one entry for each n-gram of each word."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))
    ids, grams = [], []
    code = np.zeros(len(b), dtype=np.uint64)
    for n in range(1, 5):
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        fits = left[: len(code)] >= n
        ids.append(of[: len(code)][fits])
        grams.append((mix64(code[fits] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(ids), np.concatenate(grams)


def blocks(words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of ``words`` and the features of each, numbered from the run's first word."""
    for a, b in runs([len(w) for w in words], _BLOCK):
        yield a, b, *features(words[a:b])


def _slices(texts: list[str | None]) -> list[tuple[int, int]]:
    return runs([len(t) if t else 0 for t in texts], _SLICE)


def _vocabulary() -> defaultdict:
    v: defaultdict = defaultdict()
    v.default_factory = v.__len__
    return v


def _learn(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of n-grams and of scripts for each language of ``lang, text`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in (b[i:j] for b in batches for i, j in _slices(b["text"].tolist())):
            vocabulary = _vocabulary()
            times: dict[str, list] = defaultdict(list)
            for lang, text in zip(pdf["lang"], pdf["text"]):
                times[lang].append(np.array([vocabulary[w] for w in _WORD.findall(text.lower())], dtype=np.int32))
            if not vocabulary:
                continue
            words = list(vocabulary)
            script = script_of(words)
            seen = {lang: np.bincount(np.concatenate(of), minlength=len(words)) for lang, of in times.items()}
            for lang in seen:
                total = held.setdefault(lang, np.zeros((1 << BITS) + len(_NAMES), dtype=np.int64))
                total[1 << BITS :] += np.bincount(script, weights=seen[lang], minlength=len(_NAMES)).astype(np.int64)
            for a, b, ids, grams in blocks(words):
                for lang, n in seen.items():
                    held[lang][: 1 << BITS] += np.bincount(grams, weights=n[a:b][ids], minlength=1 << BITS).astype(np.int64)
        if held:
            yield pd.DataFrame({"lang": list(held), "counts": [pack(c) for c in held.values()]})

    found = summed(rows.mapInPandas(run, "lang string, counts binary"), "lang", "string").collect()
    model = {r["lang"]: unpack(r["counts"], np.int64) for r in found}
    return {k: (v[: 1 << BITS], v[1 << BITS :]) for k, v in model.items() if v[: 1 << BITS].any()}


class LanguageModel:
    """Learned tables, and the labelling of texts with them."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], penalty: float, smoothing: float = 0.5, script_share: float = 0.01):
        self.languages = sorted(counts)
        grams = np.array([counts[x][0] for x in self.languages], dtype=np.float64).reshape(len(self.languages), 1 << BITS)
        scripts = np.array([counts[x][1] for x in self.languages], dtype=np.float64).reshape(len(self.languages), len(_NAMES))
        self.logp = np.log((grams + smoothing) / (grams.sum(1, keepdims=True) + smoothing * (1 << BITS))).T.astype(np.float32).copy()
        uses = scripts >= script_share * np.maximum(1, scripts.sum(1, keepdims=True))
        self.candidates = np.where(uses.any(0), uses, True).T
        self.penalty = penalty

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: its n-grams' mean log likelihood times its length, 0 for the best language, down to -12."""
        found = np.empty((len(words), len(self.languages)), dtype=np.float32)
        for a, b, ids, grams in blocks(words):
            n = np.bincount(ids, minlength=b - a)
            s = np.empty((b - a, len(self.languages)), dtype=np.float64)
            for k in range(len(self.languages)):
                s[:, k] = np.bincount(ids, weights=self.logp[grams, k], minlength=b - a)
            s *= (n / 4.0 / np.maximum(1, n))[:, None]
            s[~self.candidates[script_of(words[a:b])]] = -np.inf
            best = s.max(1, keepdims=True)
            s = np.maximum(s - best, -12.0)
            s[~np.isfinite(s)] = -12.0
            found[a:b] = s
        return found

    def paths(self, sequences: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """The best language of each word of each sequence of word numbers; many sequences step together."""
        out: list = [np.zeros(0, dtype=np.int8)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(order):
            longest = len(sequences[order[at]])
            own = order[at : at + max(1, min(512, _STEPS // (longest * scores.shape[1])))]
            at += len(own)
            lengths = np.array([len(sequences[i]) for i in own])
            words = np.zeros((longest, len(own)), dtype=np.int32)
            for j, i in enumerate(own):
                words[: lengths[j], j] = sequences[i]
            active = np.searchsorted(-lengths, -np.arange(longest), side="left")
            stayed = np.ones((longest, len(own), scores.shape[1]), dtype=bool)
            source = np.zeros((longest, len(own)), dtype=np.int8)
            v = scores[words[0]].copy()
            for t in range(1, longest):
                a = active[t]
                now = v[:a]
                top = now.argmax(1)
                jump = now[np.arange(a), top] - self.penalty
                keep = now >= jump[:, None]
                stayed[t, :a], source[t, :a] = keep, top
                v[:a] = np.where(keep, now, jump[:, None]) + scores[words[t, :a]]
            state = v.argmax(1)
            path = np.zeros((longest, len(own)), dtype=np.int8)
            for t in range(longest - 1, -1, -1):
                a = active[t]
                here = state[:a]
                path[t, :a] = here
                if t:
                    state[:a] = np.where(stayed[t, np.arange(a), here], here, source[t, :a])
            for j, i in enumerate(own):
                out[i] = path[: lengths[j], j]
        return out

    def label(self, texts: list[str | None], with_spans: bool) -> pd.DataFrame:
        """``lang, score, spans`` of each text."""
        vocabulary = _vocabulary()
        sequences = [np.array([vocabulary[w] for w in _WORD.findall(t.lower())], dtype=np.int32) if t else np.zeros(0, np.int32) for t in texts]
        words = list(vocabulary)
        letters = np.array([sum(c.isalpha() for c in w) for w in words], dtype=np.int64)
        lang, score, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if self.languages and words:
            found = self.paths(sequences, self.word_scores(words))
            for i, (s, p) in enumerate(zip(sequences, found)):
                if not len(s) or not (n := np.bincount(p, weights=letters[s], minlength=len(self.languages))).any():
                    continue
                k = int(n.argmax())
                lang[i], score[i] = self.languages[k], float(n[k] / n.sum())
                if with_spans:
                    cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist()]
                    places = [m.span() for m in _WORD.finditer(texts[i].lower())]
                    ends = [*cuts[1:], len(p)]
                    spans[i] = [{"start": places[a][0], "end": places[b - 1][1], "lang": self.languages[p[a]]} for a, b in zip(cuts, ends)]
        return pd.DataFrame({"lang": lang, "score": score, "spans": spans})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = 8.0) -> LanguageModel:
    """A model of all rows with a label and a text; the number of different labels must be small."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return LanguageModel(_learn(rows), penalty)


def identify(model: LanguageModel, docs: DataFrame, text: Column, with_spans: bool = True) -> Column:
    """A struct ``lang, score, spans`` for the text column of ``docs``.

    ``lang`` is a learned label, or ``und`` (score 0, no spans) where the text is null or has no letter, or nothing was learned.
    ``score`` is the share of the letters that lie in spans of ``lang``.  Spans are half-open code point ranges
    of the lower-cased text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "lang string, score double, spans array<struct<start: int, end: int, lang: string>>"

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = texts.tolist()
            parts = [sent.value.label(rows[i:j], with_spans) for i, j in _slices(rows) or [(0, 0)]]
            yield pd.concat(parts, ignore_index=True)

    # Else a filter on the label would label every text a second time.
    return label.asNondeterministic()(text)
