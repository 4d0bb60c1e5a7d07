"""Small documents with the cases that every operator must handle, and plain Python helpers."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, piece string, n int, size string"


def remainder(doc_id, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Rows of ``SCHEMA``: nulls, empty and very long texts, copies, repeated rows, and columns named like the operators' own."""
    rng = random.Random(seed)
    vocabulary = {"en": "the cat and dog ran over this hill with that thing".split(), "de": "der hund und die katze über den berg läuft ganz".split(), "ru": "кот и собака бежали через гору вместе с ней".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(vocabulary))
        text = " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(1, 90)))
        out.append((i, text, lang, rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    base = " ".join(f"w{k}" for k in range(80))
    near = base.replace("w40", "W40x")
    long = " ".join(f"long{k % 997}" for k in range(30_000))
    out += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n", "en", "b", 3), (103, base, "en", "a", len(base)), (104, base.upper(), "en", "b", len(base)), (105, near, "en", "c", len(near))]
    out += [(106, long, "en", "a", len(long)), (107, base, "en", "a", len(base)), (107, base, "en", "a", len(base)), (None, base, None, None, len(base)), (108, "one two", "en", "b", 7), (109, "One\ttwo", "en", "b", 7), (110, "123 !! 4", "en", "c", 8)]
    return [(*r, 7, "x", 1, "y") for r in out]
