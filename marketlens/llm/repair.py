"""Repair of conversation structure by error-correcting Earley parsing.

A weighted role grammar says which sequences of roles are whole.  Besides reading a row as it is (keep), its error productions give a row another
role (rerole), take it as nothing (delete) or make a row from nothing (insert).  A column of the chart holds one item for each nonterminal that is
expected next, with the least (cost, audit) that leads there; audits are strings of the edits' initials.  The grammar is right-linear, so a production
is completed only where its last nonterminal is: items need no origins, and the completed chart's best final item is the repair.

Rows of a conversation are charted in blocks of bounded length.  A block is parsed once for each nonterminal that it may begin with; the tables of
blocks, costs and the order of audits alone, are then put together.  Inserts come before the row that follows them, so two different audits of
the same rows never begin each other, and their order is known from the first block in which they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.storage import Scratch

#: Characters between words.
_BLANKS = r"\x20\x09-\x0D"
#: Rows of a conversation in a block, and the longest blocks whose tables are remembered.
_BLOCK, _REMEMBERED = 1024, 64


@dataclass(frozen=True)
class RoleGrammar:
    """Right-linear productions: of each nonterminal, role initials and the nonterminals that follow; ``final`` ones may also end.

    ``made`` are the roles that rerole and insert may give, by initial; a nonterminal has at most one production with one of these, and at most
    one for each initial.  ``truncated`` is added for every truncated row that stays.
    """

    start: str
    productions: dict[str, dict[str, str]]
    final: frozenset[str]
    made: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    def __post_init__(self):
        if any(sum(t in self.made for t in p) > 1 for p in self.productions.values()):
            raise ValueError("a nonterminal has several productions with roles that can be made")
        if self.insert <= 0 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insert costs something, no edit gives anything")

    def key(self) -> tuple:
        return self.start, tuple((x, tuple(p.items())) for x, p in self.productions.items()), tuple(sorted(self.final)), tuple(self.made.items()), self.rerole, self.delete, self.insert, self.truncated


#: A system turn or none, then any number of exchanges of a user and an assistant turn; a system turn only before exchanges.
EXCHANGES = RoleGrammar("begin", {"begin": {"s": "led", "u": "asked"}, "led": {"u": "asked"}, "asked": {"a": "answered"}, "answered": {"u": "asked"}}, frozenset({"begin", "answered"}))

Items = dict[str, tuple[int, str]]


def _predicted(g: RoleGrammar, column: Items) -> Items:
    """A column with the items that inserts lead to."""
    out, fresh = dict(column), list(column)
    while fresh:
        x = fresh.pop()
        cost, audit = out[x]
        for t, y in g.productions[x].items():
            item = cost + g.insert, audit + "I"
            if t in g.made and (y not in out or item < out[y]):
                out[y] = item
                fresh.append(y)
    return out


def _scanned(g: RoleGrammar, column: Items, initial: str, flag: str) -> Items:
    """The next column: every item keeps, reroles or deletes the row."""
    out: Items = {}
    extra = g.truncated if flag == "t" else 0
    for x, (cost, audit) in column.items():
        steps = [(x, (cost + g.delete, audit + "D"))]
        if flag != "d":
            for t, y in g.productions[x].items():
                if t == initial:
                    steps.append((y, (cost + extra, audit + "K")))
                if t in g.made:
                    steps.append((y, (cost + g.rerole + extra, audit + "R")))
        for y, item in steps:
            if y not in out or item < out[y]:
                out[y] = item
    return out


def _block_table(g: RoleGrammar, pattern: str) -> list[tuple[str, str, int, int, str]]:
    """From which nonterminal to which, at what cost, with the how manieth audit of those with that beginning, and the audit.

    ``pattern`` has two characters a row: the initial of its role, and d (has to go), t (is truncated) or a dot.
    """
    out = []
    for begin in g.productions:
        column: Items = {begin: (0, "")}
        for k in range(0, len(pattern), 2):
            column = _scanned(g, _predicted(g, column), pattern[k], pattern[k + 1])
        order = {audit: k for k, audit in enumerate(sorted(a for _, a in column.values()))}
        out += [(begin, end, cost, order[audit], audit) for end, (cost, audit) in column.items()]
    return out


_by_key: dict[tuple, RoleGrammar] = {}


@lru_cache(maxsize=20_000)
def _remembered(key: tuple, pattern: str) -> list[tuple[str, str, int, int, str]]:
    return _block_table(_by_key[key], pattern)


def block_table(g: RoleGrammar, pattern: str) -> list[tuple[str, str, int, int, str]]:
    if len(pattern) > 2 * _REMEMBERED:
        return _block_table(g, pattern)
    key = g.key()
    _by_key[key] = g
    return _remembered(key, pattern)


def joined_tables(g: RoleGrammar, tables: list[list[tuple]]) -> tuple[int, int, list[tuple[str, str]]]:
    """Cost and number of inserts at the end of the best whole parse, and where each block begins and ends in it; tables have (begin, end, cost, order)."""
    column = {g.start: (0, 0)}
    back: list[dict[str, str]] = []
    for table in tables:
        best: dict[str, tuple[int, int, int, str]] = {}
        for begin, end, cost, order in table:
            if begin in column:
                item = column[begin][0] + cost, column[begin][1], order, begin
                if end not in best or item < best[end]:
                    best[end] = item
        ranks = {k: n for n, k in enumerate(sorted((rank, order) for _, rank, order, _ in best.values()))}
        column = {end: (cost, ranks[rank, order]) for end, (cost, rank, order, _) in best.items()}
        back.append({end: begin for end, (_, _, _, begin) in best.items()})
    ends = []
    for x, (cost, rank) in column.items():
        for y, (more, audit) in _predicted(g, {x: (0, "")}).items():
            if y in g.final:
                ends.append((cost + more, rank, len(audit), x))
    cost, _, inserts, at = min(ends)
    path = []
    for step in reversed(back):
        path.append((step[at], at))
        at = step[at]
    return cost, inserts, path[::-1]


# Rows ---------------------------------------------------------------------------------------------------------------


def _slim(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, copies, initial, blank, truncated, first``: equal rows of a conversation and turn as one; ``first`` is whether no earlier turn
    has this role and text."""
    keys = ["conv_id", "turn", "role", "digest"]
    rows = turns.groupBy(*keys).agg(F.count("*").alias("copies"), F.any_value("blank").alias("blank"), F.any_value("truncated").alias("truncated"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("p")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "p")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    return met.select(*keys, "copies", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", F.col("p.turn").eqNullSafe(F.col("turn")).alias("first"))


def _marked(turns: DataFrame) -> DataFrame:
    """The rows with nulls as one blank, their texts' digests and faults."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text")).select(
        "*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (~F.rlike("text", F.lit(f"[^{_BLANKS}]"))).alias("blank"),
        (~F.rlike("text", F.lit(rf"[.!?][{_BLANKS}]*\z"))).alias("truncated"),
    )


_TABLE = pa.list_(pa.struct([("begin", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("order", pa.int32()), ("audit", pa.string())]))
_BLOCK_FIELDS = [
    ("part", pa.int64()), ("block", pa.int64()), ("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("table", _TABLE),
]
_BLOCK_DDL = (
    "part long, block long, conv_id long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, turns long, first_turn long, "
    "last_turn long, table array<struct<begin: string, end: string, cost: long, order: int, audit: string>>"
)
_LEGAL = {"su", "ua", "au"}


def _batches(rows: Iterator[tuple], fields: list[tuple], room: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(fields)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == room:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, len(b), 2000):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 2000).columns))


def _charted(g: RoleGrammar, rows: Iterator[tuple], part: int, block_rows: int) -> Iterator[tuple]:
    """Blocks of sorted slim rows."""
    made, conv, pattern, facts = 0, None, [], {}

    def block() -> tuple:
        f = facts
        return part, made, conv, f["b"], f["d"], f["t"], f["i"], f["first"], f["last"], f["turns"], f["from"], f["to"], block_table(g, "".join(pattern))

    for conv_id, turn, _, _, copies, initial, blank, truncated, first in rows:
        for k in range(copies):
            if pattern and (conv_id != conv or len(pattern) == block_rows):
                yield block()
                made, pattern = made + 1, []
            if not pattern:
                conv, facts = conv_id, {"b": 0, "d": 0, "t": 0, "i": 0, "first": initial, "last": None, "turns": 0, "from": None, "to": None}
            again = k > 0 or not first
            flag = "d" if blank or again else "t" if truncated else "."
            facts["b"] += blank
            facts["d"] += again and not blank
            facts["t"] += flag == "t"
            facts["i"] += facts["last"] is not None and facts["last"] + initial not in _LEGAL
            facts["last"] = initial
            if turn is not None:
                facts["turns"] += turn != facts["to"]
                facts["from"] = turn if facts["from"] is None else facts["from"]
                facts["to"] = turn
            pattern.append((initial or "\0") + flag)
    if pattern:
        yield block()


_PLAN_FIELDS = [
    ("part", pa.int64()), ("block", pa.int64()), ("conv_id", pa.int64()), ("begin", pa.string()), ("end", pa.string()), ("inserts", pa.int64()), ("gaps", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
]
_PLAN_DDL = "part long, block long, conv_id long, begin string, end string, inserts long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _planned(g: RoleGrammar, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The blocks of each conversation with where its best parse passes; the last one has the conversation's facts."""

    def conversation(blocks: list[tuple]) -> Iterator[tuple]:
        cost, inserts, path = joined_tables(g, [[(t["begin"], t["end"], t["cost"], t["order"]) for t in b[12]] for b in blocks])
        sums = [sum(b[k] for b in blocks) for k in range(3, 7)]
        turns, low, high, last = 0, None, None, None
        for b in blocks:
            sums[3] += last is not None and last + b[7] not in _LEGAL
            last = b[8]
            if b[9]:
                turns += b[9] - (high == b[10])
                low, high = b[10] if low is None else low, b[11]
        gaps = 0 if low is None else high - low + 1 - turns
        for b, (begin, end) in zip(blocks, path):
            yield (b[0], b[1], b[2], begin, end, *((inserts, gaps, *sums, cost) if b is blocks[-1] else (0, 0, 0, 0, 0, 0, 0)))

    held: list[tuple] = []
    for row in rows:
        if held and row[2] != held[0][2]:
            yield from conversation(held)
            held = []
        held.append(row)
    if held:
        yield from conversation(held)


def plan_repairs(marked: DataFrame, grammar: RoleGrammar, scratch: Scratch, block_rows: int = _BLOCK) -> DataFrame:
    """The audit of each block of rows in the cheapest repair of its conversation, with the facts of the conversation at its last block."""

    def chart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_charted(grammar, _rows(batches), TaskContext.get().partitionId(), block_rows), _BLOCK_FIELDS)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_planned(grammar, _rows(batches)), _PLAN_FIELDS)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    # Rows are sorted over all partitions, so one conversation may lie in many of them.
    slim = _slim(marked).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = scratch.table(slim.mapInArrow(chart, _BLOCK_DDL), "blocks")
    bare = blocks.withColumn("table", F.transform("table", lambda t: t.withField("audit", F.lit(""))))
    plans = bare.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "block").mapInArrow(plan, _PLAN_DDL)
    audits = blocks.select(F.col("part").alias("_p"), F.col("block").alias("_b"), "table")
    met = plans.join(audits, (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")))
    chosen = F.element_at(F.filter("table", lambda t: (t["begin"] == F.col("begin")) & (t["end"] == F.col("end"))), 1)
    return met.select(*[c for c, _ in _PLAN_FIELDS if c not in ("begin", "end")], F.concat(chosen["audit"], F.repeat(F.lit("I"), F.col("inserts").cast("int"))).alias("audit"))


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edited(g: RoleGrammar, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that a repair leaves."""
    at = g.start
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        t = role[:1] if edit == "K" else next(t for t in g.productions[at] if t in g.made)
        yield edit, role if edit == "K" else g.made[t], text
        at = g.productions[at][t]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int], str, Iterator[tuple[str, str]]]]:
    """Conversation, facts, audit and the rows, which are read as they are asked for: first come the blocks of the audit, then the rows in order."""
    stream = _rows(batches)
    row = next(stream, None)
    while row is not None:
        conv, facts, audit = row[0], [0] * len(_FACTS), []
        while row is not None and row[0] == conv and row[1] == 0:
            audit.append(row[2])
            facts = [a + b for a, b in zip(facts, row[3:9])]
            row = next(stream, None)

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[0] == conv and row[1] == 1:
                held, row = row, next(stream, None)
                yield held[9], held[10]

        yield conv, facts, "".join(audit), rows()
        while row is not None and row[0] == conv:  # conversations without rows, and rows that nobody asked for
            row = next(stream, None)


def _gathered(turns: DataFrame, grammar: RoleGrammar, every: DataFrame | None, block_rows: int) -> DataFrame:
    """The blocks' audits and the rows of each conversation, in this order, in one partition; a row of kind 2 for what is in ``every``."""
    spark: SparkSession = turns.sparkSession
    scratch = Scratch(spark, "repair")
    marked = _marked(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    plans = plan_repairs(marked, grammar, scratch, block_rows)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), "audit", *_FACTS, none("string").alias("role"), none("string").alias("text"), "part", "block", none("long").alias("turn"), none("binary").alias("digest"))
    empty = [none("string").alias("audit"), *[none("long").alias(c) for c in _FACTS]]
    rows = marked.select("conv_id", F.lit(1).alias("kind"), *empty, "role", "text", none("long").alias("part"), none("long").alias("block"), "turn", "digest")
    both = heads.unionByName(rows)
    if every is not None:
        ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        both = both.unionByName(ids.select("conv_id", F.lit(2).alias("kind"), *empty, *[none(k).alias(c) for c, k in (("role", "string"), ("text", "string"), ("part", "long"), ("block", "long"), ("turn", "long"), ("digest", "binary"))]))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "part", "block", "turn", "role", "digest")]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "audit", *_FACTS, "role", "text")


def repair_turns(turns: DataFrame, grammar: RoleGrammar = EXCHANGES, block_rows: int = _BLOCK) -> DataFrame:
    """``conv_id, place, role, text, edit`` (K, R or I): the rows of each conversation (``conv_id, turn, role, text``) after the cheapest repair.

    Rows are taken by turn (nulls first), then role, then their text's digest.  A row is blank if it has nothing but white space, else duplicate if its
    role and text were seen before in its conversation; both have to be deleted.  Else it is truncated unless it ends with one of ``.!?`` and white space.
    Of equally cheap repairs the one with the least audit counts.  A row with an empty role cannot be kept.  Null roles and texts are one blank, null ids are a conversation, an empty table has none.
    Other columns are not read.  A conversation of which nothing stays has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((c, k, role, text, edit) for c, _, audit, rows in _conversations(batches) for k, (edit, role, text) in enumerate(_edited(grammar, audit, rows)))
        yield from _batches(made, [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())], 200)

    return _gathered(turns, grammar, None, block_rows).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def repair_digests(turns: DataFrame, every: DataFrame | None = None, grammar: RoleGrammar = EXCHANGES, block_rows: int = _BLOCK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: the facts and the repair of each conversation, as ``repair_turns``.

    Conversations of ``every`` without rows have zeros, the empty audit and the digest of nothing.  The digest is of ``role:text`` of the repaired rows, joined by
    line ends; it reads a conversation in order, row by row, and holds no more than its audit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, facts, audit, rows in _conversations(batches):
                digest = hashlib.sha256()
                for k, (_, role, text) in enumerate(_edited(grammar, audit, rows)):
                    digest.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield conv, *facts, audit, digest.hexdigest()

        yield from _batches(made(), [("conv_id", pa.int64()), *((c, pa.int64()) for c in _FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return _gathered(turns, grammar, every, block_rows).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in _FACTS)}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame, modulo: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by crc32 of ``conv_id:turn`` modulo ``modulo``: 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user.  Nulls of these columns count as one blank in texts, roles and in what the remainder is taken of."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate: Column = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(modulo))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
