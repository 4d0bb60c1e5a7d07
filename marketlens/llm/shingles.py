"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A text's set holds the
hash of every run of ``width`` consecutive words; a text with fewer words (but at least one) has one
shingle, its whole word sequence.  A null, empty or blank text has the empty set.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)
_STEP_INV = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int, which: int) -> np.ndarray:
    """The first n powers of the step, or of its inverse; kept between batches."""
    if len(_powers[which]) < n:
        p = np.full(max(n, 1 << 20), (_STEP, _STEP_INV)[which], dtype=np.uint64)
        p[0] = 1
        _powers[which] = np.cumprod(p)
    return _powers[which][:n]


def runs(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Consecutive runs of texts of at most ``room`` bytes together; a longer text is a run of its own."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > room:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if sizes else []


def word_hashes(blob: bytes, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``blob`` and the number of words of each document.

    ``doc_starts`` are the offsets at which documents begin; a white-space byte stands between documents.
    """
    b = np.frombuffer(blob.lower(), dtype=np.uint8)
    n_docs = len(doc_starts)
    edge = np.diff(np.concatenate(([0], (~_SPACE[b]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(n_docs, dtype=np.int64)
    prefix = np.zeros(len(b) + 1, dtype=np.uint64)
    np.multiply(_BYTE[b], _power(len(b), 0), out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    h = (prefix[ends] - prefix[starts]) * _power(len(b) + 1, 1)[starts]
    h = mix64(h ^ ((ends - starts).astype(np.uint64) * _MULT))
    first = np.searchsorted(starts, doc_starts, side="left")
    return h, np.diff(np.append(first, len(starts)))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return [s for a, b in runs([len(r) for r in raw], 1_000_000) for s in _run_sets(raw[a:b], width)]


def _run_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    doc_starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    h, n_words = word_hashes(b"\n".join(raw), doc_starts)
    last = np.cumsum(n_words)
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for i in range(width):
        rolled = rolled * _MULT + h[i : i + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for end, n in zip(last.tolist(), n_words.tolist()):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            x = _U(n)
            with np.errstate(over="ignore"):
                for w in h[end - n : end]:
                    x = x * _MULT + w
            out.append(mix64(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
