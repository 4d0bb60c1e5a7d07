"""Token ids against the ``tokenizers`` library."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm.tokens import default_path, encoder

LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
PIECES = st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "  ", "\n\n", "\t", "\x85", "\u00a0", "\u200b", "\u2028", "'ll", "'S", "été", "ß", "语言", "１２", "½", "e\u0301", "😀", "\x00", "word", " word", "12"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=12).map("".join))
def test_same_ids_as_the_library(text):
    assert encoder(default_path()).ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_500_000 + "a", "\t " * 800_000, "a" + "\n" * 2_000_000 + "b", "x  " + "　" * 300_000 + "<|endoftext|>" + " " * 200_000 + " y", "a" * 2_000_000], ids=["blanks", "tabs", "lines", "mixed", "letters"])
def test_very_long_runs(text):
    assert encoder(default_path()).ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
