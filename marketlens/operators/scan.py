"""A scan session: stable frames, held panels, admitted keys, fallback reads, content keys.

What depends on everything admitted before is a fold.  A fold is a small class with typed state; the batch operators here give it the rows of a
session in order, sorted inside their partition and read as a stream, and ``streaming.scan_session`` gives it the same rows as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators import ledger


def alike(a: str, b: str, tolerance: float) -> bool:
    """Whether two keys of one length differ in at most a share of their places."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= tolerance * len(a)


class Fold:
    """Columns of a row (``ts`` first) and of the state, and what a row does.

    ``unit`` is how many milliseconds a step of ``ts`` has.  A session that was quiet for longer than its idle time begins anew, if it has one.
    """

    columns: str
    state: str
    unit = 1

    def start(self) -> list:
        raise NotImplementedError

    def step(self, s: list, row: tuple, parts: MutableMapping) -> str | None:
        raise NotImplementedError

    def ends(self, s: list, last: int, idle: int | None) -> int | None:
        """From when on a state is as good as a new one; null: never."""
        return None if idle is None else last + idle


class StableFrames(Fold):
    """Rows ``ts, x, y, width, height, hash, key``: what a frame of a session does, see ``stable_frames``."""

    columns = "ts long, x int, y int, width int, height int, hash string, key string"
    state = "used long, streak int, told boolean, x int, y int, width int, height int, hash string, held_x int, held_y int, held_width int, held_height int, held_key string"

    def __init__(self, least_ms: int = 66, stable: int = 2, same_px: int = 2, held_px: int = 6, held_share: float = 0.25):
        self.least_ms, self.stable, self.same_px, self.held_px, self.held_share = least_ms, stable, same_px, held_px, held_share

    def start(self) -> list:
        return [None, 0, False, *[None] * 10]

    def step(self, s: list, row: tuple, _parts: MutableMapping) -> str:
        ts, *box, digest, key = row
        if s[0] is not None and ts - s[0] < self.least_ms:
            return "skipped"
        s[0] = ts
        if box[0] is None:
            s[1:] = self.start()[1:]
            return "none"
        near = lambda other, px: other[0] is not None and all(abs(a - b) <= px for a, b in zip(other, box))
        if near(s[8:12], self.held_px) and alike(key, s[12], self.held_share):
            return "held"
        if near(s[3:7], self.same_px) and s[7] == digest:
            s[1] += 1
        else:
            s[1:8] = [1, False, *box, digest]
        if s[1] < self.stable or s[2]:
            return "waiting"
        s[2], s[8:] = True, [*box, key]
        return "emitted"


class KeyIndex:
    """Keys by their parts: of two keys of one length that differ in at most ``n`` places, ``n + 1`` parts, one part is equal.

    ``parts`` maps a length, a part's number and the bucket of its characters to the keys that have them, one after another as bytes, so that only these
    are compared, all at once.  Buckets bound the number of entries.  Keys are of characters up to U+00FF, one byte each.
    """

    buckets = 4096

    def __init__(self, share: float, parts: MutableMapping[tuple[int, int, int], bytes]):
        self.share, self.parts = share, parts

    def _cuts(self, key: str) -> list[tuple[int, int, int]]:
        n, raw = max(1, min(int(self.share * len(key)) + 1, len(key))), key.encode("latin-1")
        return [(len(key), i, zlib.crc32(raw[len(key) * i // n : len(key) * (i + 1) // n]) % self.buckets) for i in range(n)]

    def near(self, key: str) -> bool:
        """Whether a key that differs in at most the share of its places is there."""
        raw = np.frombuffer(key.encode("latin-1"), dtype=np.uint8)
        for cut in self._cuts(key):
            there = self.parts.get(cut)
            if there is not None and (not key or ((np.frombuffer(there, dtype=np.uint8).reshape(-1, len(raw)) != raw).sum(axis=1) <= self.share * len(raw)).any()):
                return True
        return False

    def add(self, key: str) -> None:
        for cut in self._cuts(key):
            self.parts[cut] = self.parts.get(cut, b"") + key.encode("latin-1")

    def forget(self, key: str) -> None:
        raw = np.frombuffer(key.encode("latin-1"), dtype=np.uint8)
        for cut in self._cuts(key):
            there = self.parts.get(cut)
            if there is None:
                continue
            rows = np.frombuffer(there, dtype=np.uint8).reshape(-1, max(1, len(raw)))
            left = rows[(rows != raw).any(axis=1)].tobytes() if key else b""
            if left:
                self.parts[cut] = left
            else:
                del self.parts[cut]


class Admission(Fold):
    """Rows ``ts, event, key``: what happens to a key that asks for admission, see ``admitted_keys``."""

    columns = "ts long, event string, key string"
    state = "waiting long"

    def __init__(self, share: float = 8 / 64, most: int = 300):
        self.share, self.most = share, most

    def start(self) -> list:
        return [0]

    def step(self, s: list, row: tuple, parts: MutableMapping) -> str:
        _, event, key = row
        seen = KeyIndex(self.share, parts)
        if event == "taken":
            s[0] = max(0, s[0] - 1)
            return "taken"
        if event == "failed":
            if key is not None:
                seen.forget(key)
            return "forgotten"
        if key is not None and seen.near(key):
            return "skipped"
        if s[0] >= self.most:
            return "dropped"
        s[0] += 1
        if key is not None:
            seen.add(key)
        return "queued"


class FallbackReads(Fold):
    """Rows ``ts, event, hash, key, panel, busy``: whether a slow reader runs on a frame, see ``fallback_reads``."""

    columns = "ts long, event string, hash string, key string, panel boolean, busy boolean"
    state = "ran long, streak int, hash string, key string, resolved boolean"

    def __init__(self, least_ms: int = 3000, backoff_ms: int = 20_000, still: int = 2, share: float = 0.25):
        self.least_ms, self.backoff_ms, self.still, self.share = least_ms, backoff_ms, still, share

    def start(self) -> list:
        return [None, 0, None, None, False]

    def step(self, s: list, row: tuple, _parts: MutableMapping) -> str:
        ts, event, digest, key, panel, busy = row
        if event == "rescued":
            s[4] = s[3] is not None
            return "rescued" if s[4] else "ignored"
        if panel:
            s[1], s[2] = 0, None
            return "panel"
        s[1], s[2] = (s[1] + 1 if s[1] and s[2] == digest else 1), digest
        if s[1] < self.still or busy:
            return "waiting"
        if s[0] is not None and ts - s[0] < self.least_ms:
            return "limited"
        if s[3] is not None and key is not None and alike(key, s[3], self.share) and (s[4] or ts - s[0] < self.backoff_ms):
            return "known"
        s[0], s[3], s[4] = ts, key, False
        return "run"


def typed_rows(pdf: pd.DataFrame, columns: str) -> Iterator[tuple]:
    """The rows of a fold's columns with null as None and whole numbers as such, which pandas makes floats where there are nulls."""
    out = []
    for name, kind in (c.split() for c in columns.split(", ")):
        values = pdf[name].astype(object).where(pdf[name].notna(), None).tolist()
        out.append([None if v is None else int(v) for v in values] if kind in ("int", "long") else values)
    return zip(*out)


def fold_sessions(rows: DataFrame, fold: Fold, idle: int | None = None) -> DataFrame:
    """``session, ts, state``: a fold over each session's rows in order of time (and of the other columns, nulls first, where times are equal).

    One task reads a session, row by row, and holds its state.  ``idle`` is in units of ``ts``.
    """
    names = [c.split()[0] for c in fold.columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, parts, last = object(), None, {}, None
        for pdf in batches:
            out = []
            for who, row in zip(pdf["session"].tolist(), typed_rows(pdf, fold.columns)):
                if who != session or (ends := fold.ends(state, last, idle)) is not None and row[0] > ends:
                    session, state, parts = who, fold.start(), {}
                out.append(fold.step(state, row, parts))
                last = row[0]
            yield pd.DataFrame({"session": pdf["session"], "ts": pdf["ts"], "state": out})

    typed = rows.select(F.col("session").cast("string"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in fold.columns.split(", ")]).where("session IS NOT NULL AND ts IS NOT NULL")
    return typed.repartition("session").sortWithinPartitions("session", *names).mapInPandas(run, "session string, ts long, state string")


def stable_frames(frames: DataFrame, least_ms: int = 66, stable: int = 2, same_px: int = 2, held_px: int = 6, held_share: float = 0.25) -> DataFrame:
    """``session, ts, state`` of frames ``session, ts (ms), x, y, width, height, hash, key`` (no panel: null ``x``).

    Frames less than ``least_ms`` after the last one used are ``skipped``.  A panel that stays within ``same_px`` of where its run began,
    with one hash, is told (``emitted``) once, in its ``stable``-th frame.  What stays near the panel that was told last, in place and in
    key, is ``held``.  A frame without a panel (``none``) forgets everything.  Rows without a session or a time are left out.
    """
    return fold_sessions(frames, StableFrames(least_ms, stable, same_px, held_px, held_share))


def admitted_keys(jobs: DataFrame, share: float = 8 / 64, most: int = 300) -> DataFrame:
    """``session, ts, state`` of ``session, ts, event, key``: ``queued``, ``skipped`` (like a key that was seen), ``dropped`` (the queue is full), or what
    another event did.

    ``add`` events ask for admission, first for likeness, then for room; ``taken`` takes the oldest job out of the queue; ``failed`` forgets its key.
    An ``add`` without a key is an upload: it only needs room.
    """
    return fold_sessions(jobs, Admission(share, most))


def fallback_reads(frames: DataFrame, least_ms: int = 3000, backoff_ms: int = 20_000, still: int = 2, share: float = 0.25) -> DataFrame:
    """``session, ts, state`` of ``session, ts (ms), event, hash, key, panel, busy``: when a slow reader runs on frames that show no panel.

    It runs (``run``) on a picture that stood still for ``still`` frames, while nothing else is read (else ``waiting``), at most every ``least_ms`` (else ``limited``),
    and not on the picture of its last run, by likeness of keys, if that run rescued it or is less than ``backoff_ms`` ago (``known``).  A ``panel`` ends a still
    picture; a ``rescued`` event says that the last run found something, and is ``ignored`` where none ran.
    """
    return fold_sessions(frames, FallbackReads(least_ms, backoff_ms, still, share))


def dark_runs(frames: DataFrame, by: list[str], order: list[Column], grey: Column, run: int = 30, dark: float = 5.0) -> DataFrame:
    """Adds ``black``: the frame ends a run of ``run`` frames whose mean grey is below ``dark``."""
    marked = ledger.streaks(frames.withColumn("dark", grey < dark), by, order, ["dark"])
    return marked.withColumn("black", F.col("dark") & (F.col("streak") >= run)).drop("island")


def grid_hash(cells: Column) -> Column:
    """A digit per cell: 1 where it is at least the mean of all."""
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)
    return F.array_join(F.transform(cells, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def content_key(cells: Column, levels: int = 6) -> Column:
    """A digit per cell: its grey (0 to 255) in one of ``levels`` levels."""
    return F.array_join(F.transform(cells, lambda x: F.least(F.lit(levels - 1), F.floor(x / (256 / levels))).cast("string")), "")


def queue_eta(waiting: Column, seconds: Column, read: Column) -> Column:
    """Whole seconds until a queue is read, 1 at least; null before anything was read."""
    return F.greatest(F.lit(1), F.round(F.try_divide(waiting * seconds, read)).cast("long"))


def frame_rate(seconds: DataFrame, by: list[str], order: list[Column], frames: Column, last: int = 6, least: int = 3) -> DataFrame:
    """Adds ``fps``: the mean over the seconds with frames of the last ``last``, null for fewer than ``least`` of them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)
    moving = F.when(frames > 0, frames)
    return seconds.withColumn("fps", F.when(F.count(moving).over(w) >= least, F.avg(moving).over(w)))
