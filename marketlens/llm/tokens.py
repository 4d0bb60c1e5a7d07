"""Token ids of a public byte-level BPE vocabulary, whose file's place is a parameter.

The ids are those that ``tokenizers`` gives for the ``.json`` file with ``add_special_tokens=False``: strings of added
tokens in a text become those tokens.  The ``.tiktoken`` file of the same name, which must lie beside it, holds the
same vocabulary and is several times as fast.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space (the property, as the pattern means it) that are too long for the pattern's look-ahead.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


class Encoder:
    """A vocabulary; ``ids`` gives the ids of a text as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self._bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        out, done = [], 0
        if len(text) >= 100_000:
            # The pattern takes a run of white space whole at the end of a text, else without its last character, and begins anew behind it.
            for run in _LONG_BLANK.finditer(text):
                end = run.end() if run.end() == len(text) else run.end() - 1
                out += self._bpe.encode(text[done : run.start()], allowed_special="all")
                out += self._bpe._encode_single_piece(text[run.start() : end])
                done = end
        return np.asarray(out + self._bpe.encode(text[done:], allowed_special="all"), dtype="<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per file and worker process."""
    return Encoder(path)


def default_path() -> str:
    """The vocabulary file that comes with the installed tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
