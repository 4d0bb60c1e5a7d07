"""What a visit to a site brings: cookies, product addresses, sign-in walls, the checks of a market read, cached sources, keys that expire."""

from __future__ import annotations

import re
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import outcomes
from marketlens.operators.scan import Fold, fold_sessions

#: Names in a cookie header that are attributes, not cookies.
COOKIE_ATTRIBUTES = ("domain", "expires", "httponly", "max-age", "path", "partitioned", "priority", "samesite", "secure")
#: What a page says that wants a sign-in, in lower case; the latter count only where nothing was read.
SIGN_IN_PROMPTS = ("please sign in to view offers", "please sign in")
SIGN_IN_HINTS = ("sign in", "login")
_BLANK = " \t\n\r\f\x0b"
DAY = 86400


def cookie_pairs(raw: Column, loud: bool = True) -> Column:
    """``name, value`` structs of a cookie header in order, repeats kept; attributes and parts without a name are skipped.

    A null or blank header has no pairs.  Any other without one raises, or gives null if not ``loud``.
    """
    raw = F.coalesce(raw, F.lit(""))
    strip = lambda c: F.btrim(c, F.lit(_BLANK))
    parts = F.filter(F.split(raw, ";"), lambda x: F.contains(x, F.lit("=")))
    at = lambda x: F.instr(x, "=")
    pairs = F.transform(parts, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("name"), strip(F.substr(x, at(x) + 1)).alias("value")))
    pairs = F.filter(pairs, lambda p: (p["name"] != "") & ~F.lower(p["name"]).isin(*COOKIE_ATTRIBUTES))
    none = F.raise_error(F.lit("a cookie header needs a name=value pair")) if loud else F.lit(None)
    return F.when(strip(raw) == "", F.filter(pairs, lambda p: F.lit(False))).when(F.size(pairs) > 0, pairs).otherwise(none)


def product_address(url: Column, hosts: tuple[str, ...], base: str, sections: tuple[str, ...]) -> list[Column]:
    """``root``, the path of a product's own page, and ``section``, which of ``sections`` of it the address shows; null where it is none.

    ``base`` is the path that products are under.  Hosts are compared without case.
    """
    host, part = "|".join(re.escape(h) for h in hosts), "|".join(re.escape(s) for s in sections)
    pattern = f"^(?i:https?://(?:{host})){re.escape(base)}/([^/?#]+)(?:/({part}))?/?(?:[?#].*)?$"
    of = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return [F.concat(F.lit(f"{base}/"), of(1)).alias("root"), of(2).alias("section")]


def recent_read(text: Column, trades: Column) -> Column:
    """``code, mode, blocked, reason`` of a view of finished trades: its text, and how many trades were read from it.

    A prompt to sign in blocks whatever was read; a hint of one only where nothing was.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    says = lambda words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    none = F.coalesce(trades, F.lit(0)) == 0
    wall = says(SIGN_IN_PROMPTS)
    blocked = wall | none
    code = F.when(wall | (none & says(SIGN_IN_HINTS)), "login_required")
    reason = F.when(wall, "需要登入 (Please sign in to view offers)").when(none & says(SIGN_IN_HINTS), "未偵測到成交數據或需要登入").when(none, "無成交紀錄")
    return F.struct(code.alias("code"), F.when(blocked, "B").otherwise("A").alias("mode"), blocked.alias("blocked"), reason.alias("reason"))


def market_checks(item: Column, title: Column, text: Column, trading_root: Column, trading_section: Column, trading_status: Column, recent_root: Column, recent_section: Column, recent_status: Column) -> dict[str, Column]:
    """The eight checks of a market read, in order, for ``market.checks_summary``.

    ``item``, ``title`` and ``text`` are those of the view of finished trades, as ``text.words``; roots and sections are those of ``product_address``.
    """
    blocked = trading_status.eqNullSafe(F.lit("BLOCKED")) | recent_status.eqNullSafe(F.lit("BLOCKED"))
    return {
        "product_page": recent_root.isNotNull(),
        "item_match": outcomes.item_matches(item, title, text),
        "same_product": trading_root == recent_root,
        "trading_view": trading_root.isNotNull() & trading_section.isNull(),
        "recent_view": recent_root.isNotNull() & (recent_section == "recent"),
        "trading_rows_ok": trading_status == "PASSED",
        "recent_rows_ok": recent_status == "PASSED",
        "not_blocked": ~blocked,
    }


def cached_or_fetched(sources: DataFrame, copies: DataFrame, fetched: DataFrame, now: int, ttl_s: int = 7 * DAY) -> DataFrame:
    """``source, body, used`` for every row of ``sources``: a source's newest copy (``copy``) while it is young and not empty, else what was ``fetched``.

    ``copies`` have ``source, fetched_at`` (seconds) ``, body``, ``fetched`` one ``source, body`` for each source that was asked.  Where that is
    missing, null or empty there is an ``error`` and no body: an old copy is never fallen back on.
    """
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    newest = copies.groupBy("source").agg(F.max(F.struct("fetched_at", F.col("body").alias("copied"))).alias("c")).select("source", "c.*")
    both = sources.select("source").join(newest, "source", "left").join(fetched.select("source", F.col("body").alias("got")), "source", "left")
    used = F.when((F.lit(now) - F.col("fetched_at") < ttl_s) & full("copied"), "copy").when(full("got"), "fetched").otherwise("error")
    return both.withColumn("used", used).select("source", F.when(F.col("used") == "copy", F.col("copied")).when(F.col("used") == "fetched", F.col("got")).alias("body"), "used")


def fingerprint(state: dict[str, Column]) -> Column:
    """Equal for equal states, whatever the order of their fields."""
    fields = F.struct(*[state[k].alias(k) for k in sorted(state)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


class ExpiringKeys(Fold):
    """Rows ``ts, command, value, seconds, condition`` of one key, see ``expiring_keys``."""

    columns = "ts long, command string, value string, seconds long, condition string"
    state = "value string, ends long"
    unit = 1000

    def start(self) -> list:
        return [None, None]

    def step(self, s: list, row: tuple, _parts: MutableMapping) -> str | None:
        ts, command, value, seconds, condition = row
        condition = (condition or "").upper()
        if command not in ("set", "expire", "get", "del") or condition not in ("", "NX", "XX", "GT", "LT"):
            raise ValueError(f"unsupported command: {command} {condition}")
        if s[1] is not None and s[1] <= ts:
            s[:] = self.start()
        if command == "get":
            return s[0]
        there, held = s[0] is not None, s[1]
        ends = None if seconds is None else ts + seconds
        if command == "set":
            if condition == "NX" and there:
                return "0"
            s[:] = value, ends
            return "1"
        if not there:
            return "0"
        if command == "del":
            s[:] = self.start()
            return "1"
        refused = {"": ends is None, "NX": held is not None, "XX": held is None, "GT": held is None or ends <= held, "LT": held is not None and ends >= held}
        if refused[condition]:
            return "0"
        s[1] = ends
        return "1"

    def ends(self, s: list, last: int, idle: int | None) -> int | None:
        return last if s[0] is None else s[1]


def expiring_keys(commands: DataFrame) -> DataFrame:
    """``session, ts, result`` of ``session, ts`` (seconds) ``, command, value, seconds, condition``, one session for each key, in order of time;
    times of a key should differ.

    ``set`` stores a value, with a time to live if ``seconds`` are given and without one else; with condition ``NX`` only where there is none.
    ``expire`` sets a time to live, with ``NX`` only where there is none, with ``XX`` where there is one, with ``GT`` or ``LT`` if it ends later or earlier than
    that one (a key without one never ends).  ``get`` and ``del`` do what they say.  A key is gone from the second its time ends.  The result is
    the value, or ``1`` where something was done, else ``0`` (``get``: null).  Any other command or condition is an error, not a null.
    """
    return fold_sessions(commands, ExpiringKeys()).withColumnRenamed("state", "result")


def _sessions(rows: DataFrame, schema: str, start, step) -> DataFrame:
    """Folds sorted rows; ``start()`` makes a session's state, ``step(state, row)`` gives a tuple of new columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.session != session:
                    session, state = row.session, start()
                out.append((row.session, row.ts, *step(state, row)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition("session").sortWithinPartitions("session", "ts").mapInPandas(run, schema)


def form_edits(edits: DataFrame, limit: int = 8) -> DataFrame:
    """``session, ts, key, command, done`` of a form's edits ``session, ts, key, command, unavailable``, one session for each form: whether each changed it.

    ``add`` gives a key that the form lacks, switched off; ``remove`` takes it away.  ``on`` is refused for a key that is ``unavailable`` and where
    ``limit`` are on already; ``off``, ``min`` and ``max`` need the key to be there.  Times of a form should differ.
    """

    def step(s: dict, e) -> tuple:
        there, lit = e.key in s["on"], s["on"].get(e.key, False)
        if e.command == "add":
            done = not there
        elif e.command == "on":
            done = there and not lit and not bool(e.unavailable) and sum(s["on"].values()) < limit
        elif e.command in ("remove", "off", "min", "max"):
            done = there and (e.command != "off" or lit)
        else:
            raise ValueError(f"unsupported command: {e.command}")
        if done and e.command == "remove":
            del s["on"][e.key]
        elif done and e.command in ("add", "on", "off"):
            s["on"][e.key] = e.command == "on"
        return e.key, e.command, done

    rows = edits.select(F.col("session").cast("string").alias("session"), F.col("ts").cast("long").alias("ts"), "key", "command", F.coalesce("unavailable", F.lit(False)).alias("unavailable"))
    return _sessions(rows, "session string, ts long, key string, command string, done boolean", lambda: {"on": {}}, step)


def edited_forms(edits: DataFrame, limit: int = 8) -> DataFrame:
    """``session, key, on, min, max`` after all ``edits`` (as for ``form_edits``, and a text ``value``); a value that is no number from 0 up is no limit."""
    done = form_edits(edits, limit).where("done").drop("done")
    value = edits.select(F.col("session").cast("string").alias("session"), F.col("ts").cast("long").alias("ts"), F.col("value").try_cast("double").alias("number"))
    rows = done.join(value, ["session", "ts"])
    number = F.when((F.col("number") >= 0) & (F.col("number") < float("inf")), F.col("number"))
    # Nothing from before a key's last addition counts.
    of = lambda *c: F.col("command").isin(*c)
    last = lambda v, *c: F.max(F.when(of("add", "remove", *c), F.struct("ts", v.alias("v"))))["v"]
    fresh = of("add")
    state = rows.groupBy("session", "key").agg(
        F.max_by("command", F.when(of("add", "remove"), F.col("ts"))).alias("there"), last(of("on"), "on", "off").alias("on"),
        last(F.when(~fresh, number), "min").alias("min"), last(F.when(~fresh, number), "max").alias("max"),
    )
    return state.where("there = 'add'").drop("there")
