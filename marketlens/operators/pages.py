"""Page text to listing cards and finished trades: running segment ids, no loops over lines.

Operators of lines take ``lines``: one row per line with a page key, its position and the line, and share one window
per page.  Cards and trades of whole pages (``page_cards``, ``all_trades``) take the texts: a page's lines stay an array in
its row, so nothing is sorted, and a task holds one page at a time, whatever the number of its lines in all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens import constants as C
from marketlens.functions import text as T


def page_lines(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``key, pos, line``; empty and null texts have no lines.  They are left out after the explosion: before it, the lines would be made twice."""
    return pages.select(F.col(key), F.posexplode_outer(T.lines(F.col(text))).alias("pos", "line")).where("pos IS NOT NULL")


def settled_pages(reads: DataFrame, quiet_ms: int = 500, cap_ms: int = 5000) -> DataFrame:
    """``page, ts, text, settled, changes``: when each page counts as read, with its text then, from reads ``page`` (one load of a page) ``, ts (ms), text``.

    A page is ``settled`` once its text has not changed for ``quiet_ms``; if that has not happened ``cap_ms`` after its first read, it is told then, unsettled.  A change
    at that very moment comes too late.  Reads without a change of the text do not matter.  Null texts are empty; rows without a page or a time are left out.
    """
    rows = reads.select(F.col("page").cast("string").alias("page"), F.col("ts").cast("long").alias("ts"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("page IS NOT NULL AND ts IS NOT NULL")
    w = Window.partitionBy("page").orderBy("ts", "text")
    before = F.lag("text").over(w)
    changed = rows.withColumn("_new", before.isNull() | (before != F.col("text"))).withColumn("_cap", F.min("ts").over(Window.partitionBy("page")) + cap_ms).where("_new")
    dated = changed.withColumn("n", (F.row_number().over(w) - 1).cast("long")).withColumn("_next", F.lead("ts").over(w)).withColumn("_quiet", F.col("ts") + quiet_ms)
    ok = (F.col("_quiet") < F.col("_cap")) & F.coalesce(F.col("_next") >= F.col("_quiet"), F.lit(True))
    at_cap = F.max(F.when(F.col("ts") < F.col("_cap"), F.struct("n", "text")))
    told = dated.groupBy("page", "_cap").agg(F.min(F.when(ok, F.struct("_quiet", "n", "text"))).alias("s"), at_cap.alias("c"))
    return told.select(
        "page", F.coalesce("s._quiet", "_cap").alias("ts"), F.coalesce("s.text", "c.text").alias("text"), F.col("s").isNotNull().alias("settled"), F.coalesce("s.n", "c.n").alias("changes")
    )


def between(lines: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """Lines strictly between the first line where ``first`` holds and the next where ``last`` does; both must exist."""
    w = Window.partitionBy(key)
    start = F.min(F.when(first, F.col("pos"))).over(w)
    marked = lines.withColumn("_start", start)
    end = F.min(F.when(last & (F.col("pos") > F.col("_start")), F.col("pos"))).over(w)
    return marked.withColumn("_end", end).where("pos > _start and pos < _end").drop("_start", "_end")


def listing_lines(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Lines after the last search notice and before the end of the listing."""
    w = Window.partitionBy(key)
    start = F.coalesce(F.max(F.when(F.contains("line", F.lit(C.LISTING_START)), F.col("pos"))).over(w), F.lit(-1))
    marked = lines.withColumn("_start", start)
    stop = (F.contains("line", F.lit(C.LISTING_END)) | (F.col("line") == "HELP")) & (F.col("pos") > F.col("_start"))
    return marked.withColumn("_end", F.min(F.when(stop, F.col("pos"))).over(w)).where("pos > _start and (_end is null or pos < _end)").drop("_start", "_end")


def segments(lines: DataFrame, closes: Column, key: str = "page_id") -> DataFrame:
    """Adds ``seg``, counted from 0: a line where ``closes`` holds ends its segment; an unfinished tail is dropped."""
    w = Window.partitionBy(key).orderBy("pos")
    closed = F.when(closes, 1).otherwise(0)
    seg = F.coalesce(F.sum(closed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_closed = F.sum(closed).over(Window.partitionBy(key))
    return lines.withColumn("seg", seg).withColumn("_closed", all_closed).where("seg < _closed").drop("_closed")


def _gathered(lines: DataFrame, *by: str) -> DataFrame:
    """``by, lines``: the lines of each group as an array, in order of position."""
    rows = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_rows"))
    return rows.select(*by, F.col("_rows.line").alias("lines"))


def _where(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """The place, from 0, of the first line where ``holds`` is true; null if there is none."""
    return (F.nullif(F.array_position(F.transform(lines, holds), True), F.lit(0)) - 1).cast("int")


def _places(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """The places of all lines where ``holds`` is true."""
    return F.filter(F.transform(lines, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def _cut(lines: Column, first: Column, upto: Column) -> Column:
    """Lines from place ``first`` on, without ``upto``; null limits give nothing."""
    return F.when(upto > first, F.slice(lines, first + 1, upto - first)).otherwise(F.array().cast("array<string>"))


def _is_time(line: Column, pattern: str) -> Column:
    """Whether a line is a time, by its last character first: no other ends an alternative of the patterns."""
    return F.right(line, F.lit(1)).isin(*"oOwW0123456789前剛日") & F.rlike(line, F.lit(pattern))


def page_cards(pages: DataFrame, key: str = "page_id", item: str | None = None, text: str = "text") -> DataFrame:
    """``cards`` of whole texts: the lines of ``listing_lines``, in ``segments`` that end with a time, which no noise line is."""
    rows = pages.select(key, T.lines(F.col(text)).alias("lines"))
    rows = rows.withColumn("_from", F.coalesce(F.array_max(_places(F.col("lines"), lambda x: F.contains(x, F.lit(C.LISTING_START)))), F.lit(-1)) + 1)
    rows = rows.select(key, _cut(F.col("lines"), F.col("_from"), F.size("lines")).alias("lines"))
    rows = rows.withColumn("_upto", F.coalesce(_where(F.col("lines"), lambda x: F.contains(x, F.lit(C.LISTING_END)) | (x == "HELP")), F.size("lines")))
    rows = rows.select(key, F.filter(_cut(F.col("lines"), F.lit(0), F.col("_upto")), lambda x: ~F.lower(x).isin(*C.NOISE_LINES)).alias("lines"))
    rows = rows.withColumn("_ends", _places(F.col("lines"), lambda x: _is_time(x, C.CARD_TIME)))
    after = lambda j: F.coalesce(F.get("_ends", j - 1), F.lit(-1)) + 1
    parts = rows.select(key, F.posexplode_outer(F.transform("_ends", lambda e, j: _cut(F.col("lines"), after(j), e + 1))).alias("seg", "lines"))
    return _cards(parts.where("seg IS NOT NULL"), key, item)


def cards(lines: DataFrame, key: str = "page_id", item: str | None = None) -> DataFrame:
    """One row per listing card with its fields, from ``segments``; noise lines count nowhere.

    With a known ``item`` the item line is the first that has it, without regard to case; a card without it keeps the given
    name.  Else it is the first like ``2 X Name``, and its name counts.  The seller and the rating in parentheses are the first
    two lines of a card; where the item line was found without a known name, they are the nearest rating above it and
    the line above that, and a card without either is none.  What stands between the item line and the marker are its properties.
    """
    return _cards(_gathered(lines.where(~F.lower("line").isin(*C.NOISE_LINES)), key, "seg"), key, item)


def _cards(rows: DataFrame, key: str, item: str | None) -> DataFrame:
    """Cards from ``key, seg, lines``, a segment's lines as an array without noise."""
    kept, at, mark = F.col("lines"), F.col("_item"), F.col("_mark")
    is_item = (lambda x: F.contains(F.lower(x), F.lit(item.lower()))) if item else (lambda x: F.rlike(x, F.lit(r"^[0-9]+\s*[xX]\s+(.+)$")))
    rating = lambda x: x.startswith("(") & x.endswith(")")
    value = lambda x: x.startswith("High Rune Value:")
    rows = rows.withColumns({"seg": F.col("seg").cast("long"), "_item": _where(kept, is_item), "_mark": _where(kept, lambda x: x.isin(*C.CARD_MARKERS))})
    rows = rows.withColumn("_top", F.lit(0) if item else F.when(at.isNull(), 0).otherwise(F.array_max(_places(_cut(kept, F.lit(0), at), rating)) - 1))
    rows = rows.withColumns({"_second": F.get(kept, F.col("_top") + 1), "_asks": _cut(kept, mark, F.size(kept) - 1)})
    rows = rows.select(
        key, "seg",
        F.get(kept, F.col("_top")).alias("seller"),
        F.when(rating(F.col("_second")), F.col("_second")).alias("rating"),
        F.element_at(kept, -1).alias("posted_time"),
        F.get(kept, at).alias("item_line"),
        _cut(kept, at + 1, mark).alias("mid"),
        F.filter("_asks", lambda x: ~value(x) & (x != "Trading For")).alias("asks"),
        F.try_element_at(F.filter("_asks", value), F.lit(-1)).alias("high_rune_value"),
        F.when(F.array_contains(kept, "Make an Offer"), 1).otherwise(0).alias("offer"),
    )
    # Each of these is used many times below: its own projection computes it once.
    rows = rows.withColumn("low", F.lower(F.array_join("mid", " "))).withColumn("asked", F.trim(F.array_join("asks", " ")))
    mid_text = F.col("low")
    tagless = F.transform("mid", lambda x: F.trim(F.regexp_replace(x, "•+$", "")))
    defense = F.regexp_extract(mid_text, r"\+?([0-9]+)\s*defense", 1).try_cast("int")
    terms = F.filter("mid", lambda x: F.reduce(F.array(*[F.lit(t) for t in C.STAT_TERMS]), F.lit(False), lambda a, t: a | F.contains(F.lower(x), t)))
    listed = F.lit(True) if item else F.col("item_line").isNull() | (F.col("seller").isNotNull() & F.col("rating").isNotNull())
    return rows.where(listed).select(
        key, "seg", "seller", "rating", "posted_time",
        (F.coalesce("item_line", F.lit(item)) if item else F.when(F.col("item_line").isNotNull(), F.regexp_extract("item_line", r"^[0-9]+\s*[xX]\s+(.+)$", 1))).alias("item_name"),
        platform(mid_text).alias("platform"), *environment(mid_text),
        F.contains(mid_text, F.lit("ethereal")).alias("is_ethereal"), F.contains(mid_text, F.lit("unidentified")).alias("is_unidentified"), defense.alias("defense"),
        F.concat(F.when(defense.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(defense.cast("string"), F.lit(" Defense")))), terms).alias("stats"),
        F.filter(tagless, lambda x: (x != "") & ~F.lower(x).isin(*C.CARD_TAGS)).alias("affixes"),
        F.when(F.col("asked") != "", F.col("asked")).when(F.col("offer") == 1, "Make an Offer").otherwise("Unknown").alias("ask"),
        "high_rune_value",
    )


def platform(low: Column) -> Column:
    """The first of the four platforms in lower-case text."""
    names = (("pc", "PC"), ("playstation", "Playstation"), ("xbox", "Xbox"), ("switch", "Switch"))
    out = F.lit(None).cast("string")
    for word, label in reversed(names):
        out = F.when(F.contains(low, F.lit(word)), F.lit(label)).otherwise(out)
    return out


def environment(low: Column) -> list[Column]:
    """Mode, ladder and game version in lower-case text."""
    has = lambda w: F.contains(low, F.lit(w))
    return [
        F.when(has("hardcore"), "Hardcore").when(has("softcore"), "Softcore").alias("mode"),
        F.when(has("non ladder"), "Non Ladder").when(has("ladder"), "Ladder").alias("ladder"),
        F.when(has("classic (base game)"), "Classic (Base Game)").when(has("reign of the warlock"), "Reign of the Warlock").when(has("lord of destruction"), "Lord of Destruction").alias("game_version"),
    ]


def or_price(received: Column) -> Column:
    """Joins what was given: an upper-case OR binds its neighbours, the rest is a list; an OR in front counts for nothing."""

    def step(acc: Column, x: Column) -> Column:
        added = F.when((acc == "") | acc.endswith(" OR "), F.concat(acc, x)).otherwise(F.concat(acc, F.lit(", "), x))
        return F.when(x != "OR", added).when(acc == "", acc).otherwise(F.concat(acc, F.lit(" OR ")))

    done = F.aggregate(received, F.lit(""), step)
    return F.when(done == "", "Unknown").otherwise(done)


def _finished(lines: Column, starts: Column) -> Column:
    """From each start line to the next, the lines up to the first time line, with it; null without one."""
    starting = C.TRADE_START.lower()
    block = lambda s, j: _cut(lines, s, F.coalesce(F.get(starts, j + 1), F.size(lines)))
    over = lambda b: F.slice(b, 1, _where(b, lambda x: _is_time(x, C.TRADE_TIME) & (F.lower(x) != starting)) + 1)
    return F.transform(F.transform(starts, block), over)


def _told(line: Column) -> Column:
    """Whether a line of a trade is none of its own words."""
    return ~F.lower(line).isin("i give", C.TRADE_START.lower()) & ~F.lower(line).startswith("high rune value")


def _token(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "•+$", ""))


def _given(token: Column) -> Column:
    return (token != "") & ~F.lower(token).isin(*C.TRADE_TAGS) & (token != "Additional Item(s)")


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds ``found``, the ``block`` (from 1) and ``lines`` of each finished trade, to rows with ``lines``."""
    rows = rows.withColumn("_starts", _places(F.col("lines"), lambda x: F.lower(x) == C.TRADE_START.lower()))
    rows = rows.withColumn("_done", _finished(F.col("lines"), F.col("_starts"))).drop("_starts")
    some = lambda b: F.exists(F.slice(b["lines"], 1, F.size(b["lines"]) - 1), lambda x: _told(x) & _given(_token(x)))
    numbered = F.transform("_done", lambda b, j: F.struct((j + 1).cast("long").alias("block"), b.alias("lines")))
    return rows.withColumn("found", F.filter(numbered, lambda b: b["lines"].isNotNull() & some(b))).drop("_done")


def _trades(rows: DataFrame, key: str) -> DataFrame:
    """Fields of trades from ``key, block, lines, marked``: the lines up to the time, or the item, price and time at a marker."""
    body = F.slice("lines", 1, F.size("lines") - 1)
    rows = rows.withColumn("_body", F.when(F.col("marked"), F.array().cast("array<string>")).otherwise(body))
    rows = rows.withColumn("_give", F.coalesce(_where(F.col("_body"), lambda x: F.lower(x) == "i give"), F.size("_body")))
    rows = rows.withColumns({"_front": F.filter(_cut(F.col("_body"), F.lit(0), F.col("_give")), _told), "_back": F.filter(_cut(F.col("_body"), F.col("_give"), F.size("_body")), _told)})
    rows = rows.withColumns({"_gave": F.filter(F.transform("_front", _token), _given), "_received": F.filter(F.transform("_back", _token), _given)})
    rows = rows.withColumn("_low", F.transform("_front", F.lower))
    known = lambda f: F.filter(F.transform("_low", f), lambda v: v.isNotNull())
    last = lambda k: F.try_element_at(known(lambda x: environment(x)[k]), F.lit(-1))
    item = F.when(F.size("_gave") > 0, F.array_join("_gave", ", ")).otherwise("Unknown")
    marked = lambda i, other: F.when(F.col("marked"), F.get("lines", F.lit(i))).otherwise(other)
    return rows.select(
        key, "block", marked(0, item).alias("item"), marked(1, or_price(F.col("_received"))).alias("price"), F.element_at("lines", -1).alias("trade_time"),
        F.get(known(trade_platform), F.lit(0)).alias("platform"), last(0).alias("mode"), last(1).alias("ladder"), last(2).alias("game_version"),
    )


def trades(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per finished trade: what was given and received, when, and where.

    A block runs from its start line to the first time line before the next start; without a time line, or with nothing
    on either side, it is none.
    """
    return _trades(_blocks(_gathered(lines, key)).select(key, F.inline_outer("found")).where("block IS NOT NULL").withColumn("marked", F.lit(False)), key)


def trade_platform(line: Column) -> Column:
    low = F.lower(line)
    parts = F.transform(F.split(low, "•"), F.trim)
    return F.when(F.array_contains(parts, "pc"), "PC").when(F.contains(low, F.lit("nintendo switch")), "Switch").when(F.contains(low, F.lit("playstation")), "Playstation").when(F.contains(low, F.lit("xbox")), "Xbox")


def marker_trades(lines: DataFrame, key: str = "page_id", closes: Column | None = None) -> DataFrame:
    """``key, pos, item, price, trade_time``: the line before a marker and the two after it.

    Markers are those of finished trades, without regard to case, or the lines where ``closes`` holds.  Nothing before the
    first line is ``Unknown``, nothing after the last is empty.
    """
    w = Window.partitionBy(key).orderBy("pos")
    closes = F.lower("line").isin(*[m.lower() for m in C.TRADE_DONE_MARKERS]) if closes is None else closes
    beside = lambda k, d: F.coalesce(F.lead("line", k).over(w), F.lit(d))
    near = lines.select(key, "pos", "line", F.coalesce(F.lag("line").over(w), F.lit("Unknown")).alias("item"), beside(1, "").alias("price"), beside(2, "").alias("trade_time"))
    return near.where(closes).drop("line")


def all_trades(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``key, block, item, price, trade_time, platform, mode, ladder, game_version`` of whole texts: trades in blocks, and of pages without any, by
    markers as in ``marker_trades``, whose line's position is the ``block``."""
    rows = _blocks(pages.select(key, T.lines(F.col(text)).alias("lines")))
    done = _places(F.col("lines"), lambda x: F.lower(x).isin(*[m.lower() for m in C.TRADE_DONE_MARKERS]))
    beside = lambda i, d: F.coalesce(F.get("lines", i), F.lit(d))
    marked = F.transform(done, lambda i: F.struct(i.cast("long").alias("block"), F.array(beside(i - 1, "Unknown"), beside(i + 1, ""), beside(i + 2, "")).alias("lines")))
    none = F.size("found") == 0
    parts = rows.select(key, none.alias("marked"), F.explode_outer(F.when(none, marked).otherwise(F.col("found"))).alias("p"))
    return _trades(parts.where("p IS NOT NULL").select(key, "marked", "p.block", "p.lines"), key)
