"""Collocations: phrases that occur far more often than their parts would by chance, mined from position bitmaps.

A shard is a few megabytes of text.  It gives every word a compressed bitmap of its positions: the 8-bit blocks that are
not empty.  A phrase is extended by shifting its bitmap by one position and taking the AND with the bitmaps of the words
in the same blocks; the popcount of what is left is how often the longer phrase occurs.  Positions between pieces belong
to no word, so no phrase crosses them.  Phrases are extended depth-first, a bounded batch of first words at a time, and
popcounts are summed over shards.

Phrases are counted one length at a time.  A phrase can only be frequent if the phrases inside it are, so a shard leaves
out what the filter of the length before rules out: a bitmap of fixed size (16 MB) of frequent phrases' hashes, which may
let others pass but holds back none.  The more it is filled, the more passes; counts are exact in any case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shingles import _MULT, mix64, runs
from marketlens.storage import Scratch

#: Bytes of text in a shard; a longer text is cut at words.
_ROOM = 4_000_000
#: Bits of a filter, and bytes of the pages that it is put together from.
_BITS, _PAGE = 1 << 27, 4096
#: Blocks of bitmaps that are extended together.
_BATCH = 1 << 16

_U = np.uint64
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_MARKS = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
#: What the tokens of a blob are besides words.
_NO_WORDS = pa.array([b"", b"\n"], pa.large_binary())
_SPACE = pa.scalar(b" ", pa.large_binary())
_EDGE = re.compile(rb"[ \t.,;:!?\n-\r]")


# Words of a shard ---------------------------------------------------------------------------------------------------


def _chunks(raw: bytes, words: int, room: int) -> Iterator[bytes]:
    """A text in parts of about ``room`` bytes, each beginning with the last ``words - 1`` words before it, if they are of the same piece."""
    begin, carried = 0, b""
    while len(raw) - begin > room and (m := _EDGE.search(raw, begin + room)):
        part = carried + raw[begin : m.start()]
        yield part
        last = part[max(part.rfind(bytes([b])) for b in _ENDS) + 1 :].replace(b"\t", b" ")
        carried = b" ".join(last.rsplit(None, words - 1)[-(words - 1) :]) if words > 1 else b""
        begin = m.start()
    yield carried + raw[begin:]


class _Shard:
    """Numbered words of parts of texts; 0 stands between pieces.  Words of different languages have different numbers."""

    def __init__(self, parts: list[tuple[str, bytes]]):
        of_lang: dict[str, list[bytes]] = defaultdict(list)
        for lang, raw in parts:
            of_lang[lang].append(raw)
        self.langs = list(of_lang)
        names, lang_of, ids, used = [pa.array([b""], pa.large_binary())], [np.zeros(1, dtype=np.int32)], [], 1
        for k, raws in enumerate(of_lang.values()):
            blob = b"\n".join(raws).lower().translate(_TO_MARKS).replace(b"\n", b" \n ")
            tokens = pc.split_pattern(pa.array([blob], pa.large_binary()), b" ").flatten().dictionary_encode()
            word = ~pc.is_in(tokens.dictionary, _NO_WORDS).to_numpy(zero_copy_only=False)
            blank = pc.equal(tokens.dictionary, b"").to_numpy(zero_copy_only=False)
            found = np.where(word, np.cumsum(word) + used - 1, -1 * blank).astype(np.int32)[tokens.indices.to_numpy()]
            ids += [found[found >= 0], np.zeros(1, dtype=np.int32)]
            names.append(tokens.dictionary.filter(pa.array(word)))
            lang_of.append(np.full(len(names[-1]), k, dtype=np.int32))
            used += len(names[-1])
        self.names = pa.concat_arrays(names)
        self.lang_of = np.concatenate(lang_of)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)

    def hashes(self) -> np.ndarray:
        of_lang = _hashes(np.array([x.encode() for x in self.langs], dtype=object))
        return _of_language(_hashes(self.names.to_numpy(zero_copy_only=False)), of_lang[self.lang_of]) if self.langs else np.zeros(1, dtype=np.uint64)


def _hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of texts, the same in every process."""
    return pd.util.hash_array(words, categorize=False)


def _of_language(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix64(word ^ (lang * _MULT))


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mix64(h * _MULT + word)


def _phrase_hashes(langs: pd.Series, phrases: pd.Series) -> np.ndarray:
    """The hash of each phrase; all have the same number of words."""
    lang = _hashes(langs.to_numpy(dtype=object))
    words = np.array(phrases.str.split(" ").tolist(), dtype=object)
    h = [_of_language(_hashes(w), lang) for w in words.T]
    out = h[0] if h else lang
    for w in h[1:]:
        out = _joined(out, w)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & _U(_BITS - 1)
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


# Bitmaps ------------------------------------------------------------------------------------------------------------


class _Bitmaps:
    """Position bitmaps of words: rows (word, block, mask) in order of words, and the same in order of blocks."""

    def __init__(self, ids: np.ndarray):
        at = np.flatnonzero(ids)
        order = np.argsort(ids[at], kind="stable")
        at = at[order]
        word, block = ids[at], at >> 3
        first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])))) if len(at) else at
        self.word, self.block = word[first], block[first]
        self.mask = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else np.zeros(0, dtype=np.uint8)
        by = np.argsort(self.block, kind="stable")
        self._word, self._mask = self.word[by], self.mask[by]
        self._begin = np.concatenate(([0], np.cumsum(np.bincount(self.block, minlength=(len(ids) >> 3) + 2))))

    def extended(self, of: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrase, next word, block and mask of every place where a phrase's bitmap, moved by one position, meets a word's."""
        stay, over = mask << 1, mask >> 7
        a, b = np.flatnonzero(stay), np.flatnonzero(over)
        of, block, mask = np.concatenate((of[a], of[b])), np.concatenate((block[a], block[b] + 1)), np.concatenate((stay[a], over[b]))
        begin = self._begin[block]
        n = self._begin[block + 1] - begin
        row = np.repeat(np.arange(len(of)), n)
        other = np.arange(len(row)) + np.repeat(begin - np.cumsum(n) + n, n)
        both = mask[row] & self._mask[other]
        hit = np.flatnonzero(both)
        row, other = row[hit], other[hit]
        return of[row], self._word[other], block[row], both[hit]


def _phrases(ids: np.ndarray, words: int, h: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers, a row for each phrase of ``words`` words, and how often each occurs."""
    allowed = _passes(filters[0], h)
    allowed[0] = False
    maps = _Bitmaps(np.where(allowed[ids], ids, 0))
    edges = np.flatnonzero(np.diff(maps.word, prepend=-1))
    for first in np.split(edges, np.flatnonzero(np.diff(edges // _BATCH)) + 1):
        if not len(first):
            continue
        end = edges[np.searchsorted(edges, first[-1]) + 1] if first[-1] != edges[-1] else len(maps.word)
        rows = slice(first[0], end)
        phrase = maps.word[first][:, None]
        of, block, mask = np.repeat(np.arange(len(first)), np.diff(np.append(first, end))), maps.block[rows], maps.mask[rows]
        hashes = [h[phrase[:, 0]]]
        for depth in range(2, words + 1):
            of, word, block, mask = maps.extended(of, block, mask)
            order = np.argsort(of * np.int64(len(h)) + word, kind="stable")
            of, word, block, mask = of[order], word[order], block[order], mask[order]
            starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])))) if len(of) else of
            parent, last = of[starts], word[starts]
            # Hashes of the phrase itself and of every tail of it that has two words or more, longest first.
            hashes = [*(_joined(x[parent], h[last]) for x in hashes), h[last]]
            phrase = np.concatenate((phrase[parent], last[:, None]), axis=1)
            times = np.add.reduceat(_POPCOUNT[mask], starts) if len(starts) else np.zeros(0, dtype=np.int64)
            good = np.ones(len(starts), dtype=bool)
            if depth < words:
                good &= _passes(filters[depth - 1], hashes[0])
            if depth > 2:
                good &= _passes(filters[depth - 2], hashes[1])
            sizes = np.diff(np.append(starts, len(of)))
            held = np.repeat(good, sizes)
            of, block, mask = np.repeat(np.cumsum(good) - 1, sizes)[held], block[held], mask[held]
            phrase, times, hashes = phrase[good], times[good], [x[good] for x in hashes]
        yield phrase, times


def _shard_counts(parts: list[tuple[str, bytes]], words: int, filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    shard = _Shard(parts)
    langs = pa.array(shard.langs, pa.string())
    names = shard.names

    def rows(lang: np.ndarray, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        lang_col = pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), langs).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang_col, phrase.cast(pa.binary()), pa.array(times, pa.int64())], ["lang", "phrase", "f"])

    if words == 1:
        times = np.bincount(shard.ids, minlength=len(names))[1:]
        totals = np.bincount(shard.lang_of[1:], weights=times, minlength=len(langs)).astype(np.int64)
        yield rows(shard.lang_of[1:], names[1:], times)
        yield rows(np.arange(len(langs)), pa.array([b""] * len(langs), pa.binary()), totals)
        return
    for phrase, times in _phrases(shard.ids, words, shard.hashes(), filters):
        text = pc.binary_join_element_wise(*(names.take(pa.array(phrase[:, k])) for k in range(words)), _SPACE)
        yield rows(shard.lang_of[phrase[:, 0]], text, times)


# Jobs ---------------------------------------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, words: int, filters: list, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, phrase, f`` of phrases of ``words`` words; those of one word have besides, as the phrase '', the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [b.value for b in filters]
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            for a, b in runs(sizes, _ROOM):
                texts = zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist())
                if sizes[a] <= _ROOM:
                    yield from _shard_counts(list(texts), words, bits)
                else:
                    for lang, raw in texts:
                        for part in _chunks(raw, words, _ROOM):
                            yield from _shard_counts([(lang, part)], words, bits)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = texts.where("text is not null").mapInArrow(run, "lang string, phrase binary, f long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def _filter_of(frequent: DataFrame):
    """A broadcast filter of the hashes of phrases: ``_BITS`` bits, whatever their number."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = _phrase_hashes(pdf["lang"], pdf["phrase"])
            at = (h & _U(_BITS - 1)).astype(np.int64)
            yield pd.DataFrame({"page": at // (8 * _PAGE), "at": at % (8 * _PAGE)})

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for page, ats in pdf.groupby("page")["at"]:
                at = ats.to_numpy()
                np.bitwise_or.at(held.setdefault(page, np.zeros(_PAGE, dtype=np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"page": list(held), "bits": [b.tobytes() for b in held.values()]})

    spread = frequent.select("lang", "phrase").where("phrase != ''").mapInPandas(bits, "page int, at int").repartition(F.col("page"))
    out = np.zeros((_BITS // 8 // _PAGE, _PAGE), dtype=np.uint8)
    for r in spread.mapInPandas(pages, "page int, bits binary").toLocalIterator():
        out[r.page] = np.frombuffer(r.bits, dtype=np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out.reshape(-1))


def frequent_phrases(docs: DataFrame, scratch: Scratch, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> list[DataFrame]:
    """Stored tables ``lang, phrase, f`` of the phrases of 1, 2, ... words that occur at least ``least`` times in a language."""
    filters: list = []
    levels: list[DataFrame] = []
    for words in range(1, max_words + 1):
        counts = phrase_counts(docs, words, filters, lang_col, text_col)
        levels.append(scratch.table(counts.where((F.col("f") >= least) | (F.col("phrase") == "")), f"words{words}"))
        if words < max_words:
            filters.append(_filter_of(levels[-1]))
    return levels


def _parts(w: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, first, n), " ")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score, frequency and text.

    A phrase of 2 to ``max_words`` words that occurs ``a >= least`` times is cut after each of its words into parts that occur ``l`` and ``r`` times; it
    has the lowest score floor(1000000 a a / (l r)) of all cuts.  Phrases that lie in a longer one which occurs at least ``inside`` percent as often go.
    ``n`` counts all words of the language.  A null language is ``und``; null, empty and blank texts have no words; an empty table gives no rows.  Rows
    that repeat count again, in any order; other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    levels = frequent_phrases(docs, scratch, max_words, least, lang_col, text_col)
    known = levels[0].where("phrase != ''")
    for level in levels[1:-1]:
        known = known.unionByName(level)
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionByName(level)
    w = F.split("phrase", " ")
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.size(w).alias("size"))

    longer = candidates.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    longer = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: _parts(F.col("w"), i, F.col("k")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    held = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < inside * F.col("a"), F.lit(True)))

    cut = held.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _parts(F.col("w"), F.lit(1), F.col("k")).alias("_first"), _parts(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cut.withColumn("_num", F.lit(1000000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("_den", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("cast(_num div _den as bigint)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    worst = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("_lane"))

    # Ranks in two steps: the first of each lane, then of the lanes of a language, so a large language is not one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lanes = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_lane").orderBy(*order))).where(F.col("rank") <= top)
    ranked = lanes.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
