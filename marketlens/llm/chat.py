"""Chat formatting in budgeted windows.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  Control strings in roles and texts get a backslash
after their first character, one more than they have, so no text can pass for a mark and everything can be
read back.

Turns go in order of ``turn`` into windows of at most ``budget`` tokens, as they are estimated: a quarter of the bytes, which may be far fewer than a vocabulary gives.  The prefix sum of turn tokens is cut into cells of what
the budget leaves beside the system turn and twice ``history``: a turn belongs to the cell that its first token lies in, so every
window is known without the one before it.  A turn that runs over its cell's end by more than ``history`` could is a window of
its own.  Every window begins with the system turn (the conversation's first, if its role is system) and with as many of the
turns before it as ``history`` tokens hold, which prefix sums tell too.  The loss mask covers assistant texts, each in the first window that has it; repeats are masked out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strings that templates of chat models use as marks.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>", "</SYS>")
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
WINDOW = "conv_id long, window int, text string, n_tokens long, n_repeated int, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def _spans(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """``conv_id, window, n, repeat, role, text, tokens``: what each window holds, in order of ``n``, from prefix sums of turn tokens.

    ``n`` is a turn's place in its conversation, 0 for a system turn that is repeated.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("n", F.row_number().over(order)).withColumn("first", F.first(F.struct("role", "text", "tokens")).over(order))
    led = F.col("first.role") == "system"
    leads = led & (F.col("n") == 1)
    placed = placed.withColumn("system", F.when(led, F.col("first.tokens")).otherwise(0)).withColumn("own", F.when(leads, 0).otherwise(F.col("tokens")))
    at = Window.partitionBy("conv_id").orderBy("n")
    placed = placed.withColumn("before", F.sum("own").over(at) - F.col("own"))
    placed = placed.withColumn("room", F.greatest(F.lit(budget - 2 * history) - F.col("system"), F.lit(max(history, 1))))
    cell = lambda x: F.floor(x / F.col("room"))
    alone = (F.col("own") > history) & (cell(F.col("before") + F.col("own") - 1) > cell(F.col("before")))
    placed = placed.withColumn("alone", alone).withColumn("cell", 2 * cell(F.col("before")) + F.col("alone").cast("long"))
    placed = placed.withColumn("starts", ~F.lag("cell").over(at).eqNullSafe(F.col("cell")))
    placed = placed.withColumn("window", (F.sum(F.col("starts").cast("int")).over(at) - 1).cast("int"))
    reach = F.when(F.col("alone"), F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - F.col("own") - F.col("system")))).otherwise(history)
    start = F.when(F.col("starts"), F.struct("window", (F.col("before") - reach).alias("since")))
    # The windows that begin within reach after a turn: a turn has seven tokens or more, so this list is as short as the history.
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(1, max(history, 1))
    placed = placed.withColumn("ahead", F.collect_list(start).over(ahead))
    entry = lambda window, repeat, of, n: F.struct(window.cast("int").alias("window"), F.lit(repeat).alias("repeat"), of["role"].alias("role"), of["text"].alias("text"), of["tokens"].cast("long").alias("tokens"), n.cast("int").alias("n"))
    turn = {c: F.col(c) for c in ("role", "text", "tokens")}
    again = F.transform(F.filter("ahead", lambda w: ~leads & (w["since"] <= F.col("before"))), lambda w: entry(w["window"], True, turn, F.col("n")))
    lead = F.when(led & F.col("starts") & (F.col("window") > 0), F.array(entry(F.col("window"), True, F.col("first"), F.lit(0)))).otherwise(F.array())
    return placed.select("conv_id", F.explode(F.concat(F.array(entry(F.col("window"), False, turn, F.col("n"))), again, lead)).alias("e")).select("conv_id", "e.*")


@dataclass
class _Open:
    """The window being written."""

    key: tuple
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    tokens: int = 0
    repeated: int = 0
    loss: list[dict] = field(default_factory=list)

    def add(self, role: str, text: str, tokens: int, repeat: bool) -> None:
        head, body = f"<|turn|>{escape(role)}<|text|>", escape(text)
        if not repeat and role == "assistant":
            self.loss.append({"start": self.chars + len(head), "end": self.chars + len(head) + len(body)})
        self.parts.append(f"{head}{body}<|end|>")
        self.chars += len(self.parts[-1])
        self.tokens += tokens
        self.repeated += repeat

    def row(self) -> tuple:
        return *self.key, "".join(self.parts), self.tokens, self.repeated, self.loss


def _id(x) -> int | None:
    return None if pd.isna(x) else int(x)


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history: int = 256) -> DataFrame:
    """One row per window: ``conv_id, window, text, n_tokens, n_repeated, loss``.

    ``n_repeated`` turns at the front are repeats; ``loss`` are half-open code point spans of ``text``.  A turn's tokens are
    estimated as a quarter of its formatted bytes, rounded up.  A turn over the budget has a window of its own, longer
    than the budget; a system turn that leaves no room makes each window longer by what is missing.  Null texts and roles count
    as empty, null turns come first, rows with the same turn are all kept and go by role and text.  Rows with a null
    conversation form one conversation.  A conversation is sorted and summed by one task, which spills; its windows are written by many,
    each holding one window at a time.  Other columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    tokens = F.ceil((F.octet_length("role") + F.octet_length("text") + 26) / F.lit(4)).cast("long")
    spans = _spans(rows.withColumn("tokens", tokens), budget, history).repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, held = None, []
        for pdf in batches:
            for conv, window, repeat, role, text, n in zip(pdf["conv_id"], pdf["window"], pdf["repeat"], pdf["role"], pdf["text"], pdf["tokens"]):
                key = _id(conv), int(window)
                if w is None or w.key != key:
                    if w is not None:
                        held.append(w.row())
                    w = _Open(key)
                w.add(role, text, int(n), bool(repeat))
                if len(held) >= 500:
                    yield _frame(held)
                    held = []
        if w is not None:
            yield _frame([*held, w.row()])

    return spans.mapInPandas(run, WINDOW)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "window", "text", "n_tokens", "n_repeated", "loss"]).astype({"conv_id": "Int64"})


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds ``turns``: the turns that a window adds, unescaped, and ``targets``: the texts under its loss mask, unescaped."""

    @F.pandas_udf("turns array<struct<role: string, text: string>>, targets array<string>")
    def parse(text: pd.Series, repeated: pd.Series, loss: pd.Series) -> pd.DataFrame:
        turns, targets = [], []
        for t, skip, spans in zip(text, repeated, loss):
            found = _TURN.findall(t)
            turns.append([{"role": unescape(a), "text": unescape(b)} for a, b in found[skip:]])
            targets.append([unescape(t[s["start"] : s["end"]]) for s in spans])
        return pd.DataFrame({"turns": turns, "targets": targets})

    return windows.withColumn("_read", parse("text", "n_repeated", "loss")).select(*windows.columns, "_read.turns", "_read.targets")


def conversation_digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from read windows, in order, as a stream."""
    rows = read.select("conv_id", "window", "turns", "targets", F.length("text").cast("long").alias("chars"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_at, out = False, []
        for pdf in batches:
            for c, turns, targets, chars in zip(pdf["conv_id"], pdf["turns"], pdf["targets"], pdf["chars"]):
                c = _id(c)
                if not open_at or c != conv:
                    if open_at:
                        out.append((conv, n, told.hexdigest(), loss_n, loss.hexdigest(), total))
                    open_at, conv, n, loss_n, total, told, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for t in turns:
                    told.update(f"{t['role']}\n{t['text']}\n".encode("utf-8", "surrogatepass"))
                n += len(turns)
                for t in targets:
                    loss.update(t.encode("utf-8", "surrogatepass"))
                    loss_n += len(t)
                total += int(chars)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
                out = []
        if open_at:
            out.append((conv, n, told.hexdigest(), loss_n, loss.hexdigest(), total))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
