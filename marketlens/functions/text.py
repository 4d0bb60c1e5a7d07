"""Column expressions over text."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructType

from marketlens.constants import BLANKS, LINE_BREAK


def lines(text: Column) -> Column:
    """Trimmed non-empty lines; inner no-break spaces become spaces."""
    parts = F.transform(F.split(text, LINE_BREAK), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.replace(x, F.lit("\xa0"), F.lit(" ")))


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    def plain(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f")

    return s.map(plain)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def name_key(name: Column, ascii_only: bool = False) -> Column:
    """The key that names are looked up by: accents, case, quotes, punctuation and a leading "the" do not count."""
    plain = F.lower(name if ascii_only else _nfkd(name))
    words = F.trim(F.regexp_replace(F.regexp_replace(plain, "['’‘`]", ""), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, "^the ", "")


def clean_name(name: Column) -> Column:
    """Compatibility forms unified, runs of blanks collapsed."""
    return F.btrim(F.regexp_replace(_nfkc(name), r"\s+", " "))


def without_separators(name: Column) -> Column:
    return F.regexp_replace(name, "[-·‧・.]", "")


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mentions(words_of_text: Column, words_of_name: Column) -> Column:
    """Whole-word containment of a name in a text, both as ``words`` gives them."""
    return (words_of_name != "") & F.contains(F.concat(F.lit(" "), words_of_text, F.lit(" ")), F.concat(F.lit(" "), words_of_name, F.lit(" ")))


def price_of(text: Column) -> Column:
    """The first number of a price text; 0 is a price, no number is null."""
    return F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet runs as a formula, quoted where needed."""
    safe = F.when(F.rlike(value, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(F.rlike(safe, F.lit('[",\r\n]')), quoted).otherwise(safe), F.lit(""))


def tsv_cell(value: Column) -> Column:
    flat = F.trim(F.regexp_replace(value, r"[\t\r\n]+", " "))
    return F.coalesce(F.when(F.rlike(flat, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), flat)).otherwise(flat), F.lit(""))


def markdown_cell(value: Column) -> Column:
    flat = F.regexp_replace(F.replace(value, F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")
    return F.when(value.isNull() | (value == ""), "—").otherwise(flat)


def file_name(item: Column, label: Column) -> Column:
    return F.concat(F.regexp_replace(F.concat_ws("_", item, label), "[^A-Za-z0-9 _-]", "_"), F.lit(".csv"))


def longest_run(text: Column, char: str) -> Column:
    """Length of the longest run of a character; a fence around the text must be longer."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)"), F.lit(1)), F.length)), F.lit(0))


@F.pandas_udf(StructType().add("digest", BinaryType()).add("size", IntegerType()).add("grams", BinaryType()))
def reading(text: pd.Series) -> pd.DataFrame:
    """A text without blanks as its digest, its number of characters, and its distinct character bigrams as ascending numbers; a null text is empty."""

    def told(x: str | None) -> tuple[bytes, int, bytes]:
        codes = np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = codes[(codes != 32) & ((codes < 9) | (codes > 13))]
        grams = np.unique(codes[:-1].astype("<u8") << np.uint64(32) | codes[1:])
        return hashlib.sha256(codes.tobytes()).digest(), len(codes), grams.tobytes()

    return pd.DataFrame([told(x) for x in text], columns=["digest", "size", "grams"])


@F.pandas_udf(DoubleType())
def bigram_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the bigrams of two readings; without any there is none."""

    def of(x: bytes | None, y: bytes | None) -> float:
        if not x or not y:
            return 0.0
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common)

    return pd.Series([of(x, y) for x, y in zip(a, b)], dtype="float64")


def key_distance(a: Column, b: Column) -> Column:
    """Hamming distance of equally long keys; null for others."""
    differs = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(differs))


def tone_quality(r: Column, g: Column, b: Column) -> Column:
    """The item quality that a lettering colour stands for."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    delta = (most - least).cast("double")
    sat = F.try_divide(delta, most.cast("double"))
    turn = F.when(most == r, F.try_divide(g - b, delta)).when(most == g, F.try_divide(b - r, delta) + 2).otherwise(F.try_divide(r - g, delta) + 4) * 60
    hue = F.when(turn < 0, turn + 360).otherwise(turn)
    return (
        F.when(most < 150, None).when(sat < 0.15, "white").when(hue.between(190, 270) & (sat >= 0.3), "blue").when(hue.between(80, 160) & (sat >= 0.4), "green")
        .when(hue.between(30, 52) & (sat <= 0.6), "gold").when((hue > 52) & (hue <= 65), F.when(sat < 0.31, "gold").otherwise("yellow"))
    )


def allowed_edits(length: Column, cjk: bool = False, wide: bool = False, loose: bool = False) -> Column:
    """How many edits a name of a length may be away."""
    if cjk:
        base = F.when(length <= 2, 0).when(length <= 4, 1).otherwise(F.when(F.lit(wide) & (length >= 6), 3).otherwise(2))
        most = F.when(length >= 4, F.floor(length / 2)).otherwise(0)
    else:
        base = F.when(length <= 5, 1).otherwise(2) + int(wide)
        most = F.round(length * 0.4)
    return (F.greatest(base, most) if loose else base).cast("int")


def money(value: Column) -> Column:
    """Dollars with two decimals, or four for less than a cent; exact halves go up."""
    small = F.format_string("$%.4f（約 %.2f 美分）", value, value * 100)
    return F.when(value <= 0, "$0").when(value >= 0.01, F.format_string("$%.2f", value)).otherwise(small)


def pairs(text: Column, separator: str = "&") -> Column:
    """The ``name=value`` parts of a text as an array of ``name, value``, in order, repeats kept; parts without a name or ``=`` are left out."""
    parts = F.filter(F.split(text, separator), lambda x: F.locate("=", x) > 1)
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.substr(x, F.locate("=", x) + 1).alias("value")))


def goal_safe(text: Column) -> Column:
    """Whether a text may stand in a quoted goal: no quotation mark, no control and no format character."""
    return ~F.rlike(text, F.lit(r'["\p{Cc}\p{Cf}]'))


def shown(text: Column, most: int = 6000) -> tuple[Column, Column]:
    """The first ``most`` characters of a text, and whether that is the ``whole`` or it was ``cut``."""
    return F.substring(text, 1, most), F.when(F.length(text) > most, "cut").otherwise("whole")
