"""Affix lines of read item texts: which dictionary entry a line shows, its number, and rows that lack a condition."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import constants as C


@dataclass(frozen=True)
class Affix:
    """An entry: its words, its kind (``number``, ``percent`` or ``bool``), and the largest number that it can have."""

    key: str
    words: tuple[str, ...]
    english: str
    kind: str = "number"
    abbreviation: str | None = None
    ceiling: int | None = None


def value_digits(line: Column) -> Column:
    """The digits of a line's number: signed before percent before any, bracketed tokens and counts like ``2x`` aside."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(line, C.BRACKETED_TOKEN, " ")), r"^\s*\d+\s*[xX*×]\s*", "")
    found = [F.regexp_extract(bare, p, 1) for p in (r"[+-]\s*(\d+)", r"(\d+)\s*%", r"(\d+)")] + [F.regexp_extract(line, r"(\d+)", 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def read_numbers(rows: DataFrame, line: Column, percent: Column, ceiling: Column) -> DataFrame:
    """Adds ``min, confident``: a percentage that shows no ``%`` had the sign read as digits, which are taken off again.

    One or two digits go by what the number ends in; a number so repaired that is still above ``ceiling`` loses up to two
    more.  Repaired numbers, those that lack their sign and those above the ceiling are unsure.  Null ceilings bound nothing.
    """
    raw, n, bound = F.col("_raw"), F.length("_raw"), F.col("_in.ceiling")
    last, two = F.right(raw, F.lit(1)), F.right(raw, F.lit(2))
    cut = lambda k: F.left(raw, F.greatest(n - k, F.lit(0)))
    one_off = (n >= 3) & (last.isin("0", "5") | (last.isin("6", "9") & (n >= 4))) & (cut(1).try_cast("decimal(38,0)") >= 1)
    off = F.when((n == 3) & (last == "6"), 1).when((n >= 3) & two.isin(*C.MISREAD_PERCENT), 2).when(one_off, 1).otherwise(0)
    number = lambda k: F.coalesce(cut(F.col("_off") + k).try_cast("double"), F.lit(0.0))
    own = F.struct(line.alias("line"), F.coalesce(percent & ~F.contains(line, F.lit("%")), F.lit(False)).alias("unmarked"), ceiling.cast("double").alias("ceiling"))
    # Each step as a generator's row: what it is made of is worked out once, not again wherever it is used.
    once_for = lambda c: F.explode(F.array(c))
    out = rows.withColumn("_in", own).withColumn("_raw", once_for(value_digits(F.col("_in.line")))).withColumn("_off", once_for(off))
    out = out.withColumn("_cuts", once_for(F.array(number(0), number(1), number(2))))
    at = lambda k: F.get("_cuts", F.lit(k))
    once = (at(0) > bound) & (at(1) >= 1) & (F.col("_off") > 0)
    fixed = F.when(once & (at(1) > bound) & (at(2) >= 1), at(2)).when(once, at(1)).otherwise(at(0))
    out = out.withColumn("min", F.when(raw.isNull(), None).when(F.col("_in.unmarked"), fixed).otherwise(raw.try_cast("double")))
    sure = F.col("min").isNotNull() & ~F.col("_in.unmarked") & (bound.isNull() | (F.col("min") <= bound))
    return out.withColumn("confident", sure).drop("_in", "_raw", "_off", "_cuts")


def choose_entry(line: Column, joined: Column, entries: list[Affix]) -> Column:
    """Place in ``entries`` of the one with the longest word in the line, else of the only one with the closest abbreviation."""
    lengths = []
    for i, e in enumerate(entries):
        found = [F.when(F.contains(joined, F.lit(w)), len(w)) for w in e.words] + [F.when(F.contains(F.lower(line), F.lit(e.english.lower())), len(e.english))]
        if e.key in C.LEECH:
            found.insert(0, F.when(F.rlike(joined, F.lit(C.LEECH[e.key])), 10))
        lengths.append(F.struct(F.array_max(F.array(*found)).alias("size"), F.lit(-i).alias("at")))
    by_word = F.array_max(F.filter(F.array(*lengths), lambda x: x["size"].isNotNull()))
    shown = F.upper(F.regexp_extract(line, r"\(([A-Za-z]{2,5})\)", 1))
    near = [F.struct(F.levenshtein(shown, F.lit(e.abbreviation.upper())).alias("off"), F.lit(i).alias("at")) for i, e in enumerate(entries) if e.abbreviation]
    by_short = F.lit(None).cast("int")
    if near:
        close = F.filter(F.array(*near), lambda x: x["off"] <= 1)
        best = F.filter(close, lambda x: x["off"] == F.array_min(close)["off"])
        by_short = F.when((shown != "") & (F.size(best) == 1), F.get(best, F.lit(0))["at"])
    return F.coalesce(-by_word["at"], by_short)


def parse_affixes(lines: DataFrame, entries: list[Affix], id_col: str = "page_id") -> DataFrame:
    """``page_id, key, kind, line, pos, min, confident``: conditions that texts show, from lines with ``pos`` and ``line``.

    Requirement lines and hints are no affixes.  Of two lines of one entry the first counts, even where it shows no
    number and so gives no condition.  Null lines are ignored; ``entries`` is a dictionary of at most hundreds.
    """
    clean = F.trim(F.regexp_replace("line", r"\s+", " "))
    rows = lines.select(id_col, "pos", clean.alias("line")).withColumn("joined", F.regexp_replace("line", C.CJK_GAP, ""))
    rows = rows.where(~F.rlike("joined", F.lit(C.NOT_AN_AFFIX)) & ~F.rlike("joined", F.lit(C.REQUIREMENT)))
    # As a generator's row the choice is made once, not again wherever it is used.
    rows = rows.withColumn("at", F.explode(F.array(choose_entry(F.col("line"), F.col("joined"), entries)))).where("at is not null")
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("at"))
    rows = rows.select(id_col, "pos", "line", of([e.key for e in entries], "string").alias("key"), of([e.kind for e in entries], "string").alias("kind"), of([e.ceiling for e in entries], "double").alias("ceiling"))
    first = rows.groupBy(id_col, "key").agg(F.min_by(F.struct("line", "kind", "ceiling", "pos"), "pos").alias("r")).select(id_col, "key", "r.*")
    flag = F.col("kind") == "bool"
    out = read_numbers(first, F.col("line"), F.col("kind") == "percent", F.col("ceiling"))
    out = out.select(id_col, "key", "kind", "line", "pos", F.when(~flag, F.col("min")).alias("min"), (flag | F.col("confident")).alias("confident"))
    return out.where(flag | F.col("min").isNotNull())


def is_name_line(joined: Column) -> Column:
    """Whether a line is an item's name or type: one to six Chinese characters and no digit, but none of the words that affixes have."""
    n = F.length(F.regexp_replace(joined, C.NO_CJK, ""))
    return ~F.rlike(joined, F.lit(C.AFFIX_WORDS)) & (n > 0) & (n <= 6) & ~F.rlike(joined, F.lit("[0-9]"))


def unmapped_lines(lines: DataFrame, entries: list[Affix], id_col: str = "page_id") -> DataFrame:
    """``page_id, pos, line``: lines that look like affixes but are in no dictionary entry; requirement lines, hints, names and blank lines are left out."""
    clean = F.trim(F.regexp_replace("line", r"\s+", " "))
    rows = lines.select(id_col, "pos", clean.alias("line")).where("line != ''").withColumn("joined", F.regexp_replace("line", C.CJK_GAP, ""))
    rows = rows.where(~F.rlike("joined", F.lit(C.NOT_AN_AFFIX)) & ~F.rlike("joined", F.lit(C.REQUIREMENT)) & ~is_name_line(F.col("joined")))
    return rows.where(choose_entry(F.col("line"), F.col("joined"), entries).isNull()).select(id_col, "pos", "line")


def condition_pattern(name: str) -> str:
    """The pattern of whole lines that show a condition: its placeholders are numbers, the rest is literal."""
    parts = re.split(r"\{\{[^}]*\}\}", name)
    return "(?i)^" + r"[+-]?[0-9]+(?:\.[0-9]+)?".join(re.escape(p) for p in parts) + "$"


def lacks_condition(affixes: Column, conditions: list[str]) -> Column:
    """Whether any condition is shown by no affix; null affixes show nothing."""
    def shown(pattern: str) -> Column:
        return F.coalesce(F.exists(affixes, lambda a: F.coalesce(F.rlike(a, F.lit(pattern)), F.lit(False))), F.lit(False))

    lacking = F.lit(False)
    for c in conditions:
        lacking = lacking | ~shown(condition_pattern(c))
    return lacking
