"""Repairs of conversations against brute force over all edits, and against SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from marketlens.llm import repair
from marketlens.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import rows_of_spark, rows_of_sql

GRAMMAR = re.compile(r"(s?(ua)+)?")
INSERTS = ["", "u", "a", "uu", "ua", "au", "aa"]


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, str]:
    """Cost, audit and initials of the best of all edits of (initial, has to go, truncated), at most two inserts at a place."""
    choices = []
    for initial, gone, cut in rows:
        extra = 3 * cut
        choices.append([(4, "D", "")] + ([] if gone else [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")]))
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(INSERTS, repeat=len(rows) + 1):
            made = "".join(g + e[2] for g, e in itertools.zip_longest(gaps, edits, fillvalue=(0, "", "")))
            if GRAMMAR.fullmatch(made):
                cost = sum(e[0] for e in edits) + 3 * sum(map(len, gaps))
                audit = "".join("I" * len(g) + e[1] for g, e in itertools.zip_longest(gaps, edits, fillvalue=(0, "", "")))
                if best is None or (cost, audit) < best[:2]:
                    best = cost, audit, made
    return best


@pytest.mark.parametrize("seed", range(12))
def test_charts_against_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice("suaax"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 3))]
    patterns = [i + ("d" if gone else "t" if cut else ".") for i, gone, cut in rows]
    want = cheapest(rows)
    for size in (1, 2, 5):
        blocks = ["".join(patterns[k : k + size]) for k in range(0, len(patterns), size)]
        tables = [repair.block_table(repair.EXCHANGES, b) for b in blocks]
        cost, inserts, path = repair.joined_tables(repair.EXCHANGES, [[t[:4] for t in table] for table in tables])
        audit = "".join(t[4] for table, (a, b) in zip(tables, path) for t in table if t[:2] == (a, b)) + "I" * inserts
        assert (cost, audit) == want[:2]
        initials = "".join(role[:1] for _, role, _ in repair._edited(repair.EXCHANGES, audit, iter([(i, "") for i, _, _ in rows])))
        assert initials == want[2]


def test_long_charts_do_not_depend_on_blocks():
    r = random.Random(3)
    for _ in range(40):
        patterns = [r.choice("suaax") + r.choice("d..t") for _ in range(r.randint(1, 60))]
        found = set()
        for size in (1, 3, 7, 100):
            tables = [repair.block_table(repair.EXCHANGES, "".join(patterns[k : k + size])) for k in range(0, len(patterns), size)]
            cost, inserts, path = repair.joined_tables(repair.EXCHANGES, [[t[:4] for t in table] for table in tables])
            found.add((cost, "".join(t[4] for table, (a, b) in zip(tables, path) for t in table if t[:2] == (a, b)) + "I" * inserts))
        assert len(found) == 1


def by_hand(conversations: list[tuple]) -> set[tuple]:
    """The contract row by row, for conversations of at most three rows after damage."""
    out = set()
    for conv in {c[0] for c in conversations}:
        rows = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [] if fate == 0 else [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        facts, seen = [], set()
        for _, role, text in rows:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            facts.append((blank, not blank and (role, text) in seen, not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)))
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, made = cheapest([(role[:1] or "\0", b or d, c) for (_, role, _), (b, d, c) in zip(rows, facts)])
        texts, left, j = [], iter(rows), 0
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                texts.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[made[j]]}:{text}")
                j += 1
        out.add((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(b for b, _, _ in facts), sum(d for _, d, _ in facts), sum(c and not b and not d for b, d, c in facts),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        ))
    return out


def drawn(n: int) -> list[tuple]:
    r = random.Random(n)
    out = []
    for conv in [None, *range(n)]:
        for k in range(r.choice([1, 2, 2, 3])):
            role = r.choice(["system", "user", "assistant", "assistant", None, "", "tool"])
            out.append((conv, r.choice([k, k, 2 * k, None]), role, r.choice(["a b.", "a b", "  \t", "", None, "é!\n ", "x?"])))
    return out


@pytest.mark.parametrize("block_rows", [1, 2, 1024])
def test_rows_of_every_kind(spark, block_rows):
    rows = drawn(40)
    few = {c for c, k in ((c, sum(1 for x in rows if x[0] == c)) for c in {r[0] for r in rows}) if k <= 2} | {None}
    rows = [r for r in rows if r[0] in few and not (r[0] is None and r[1] is None)][:90]
    convs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id int, turn int, role string, text string, audit string, kind int").repartition(4)
    found = repair.repair_digests(repair.damaged(convs), every=convs, block_rows=block_rows).collect()
    assert {tuple(r) for r in found} == by_hand(rows) and len(found) == len({r[0] for r in rows})


def test_repaired_turns_are_what_the_digest_reads(spark, sf_dir):
    turns = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    made: dict = {}
    for r in sorted(repair.repair_turns(turns).collect(), key=lambda r: (r.conv_id, r.place)):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair_digests(turns, block_rows=3).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(made.get(r.conv_id, [])).encode()).hexdigest()


def test_one_long_conversation_in_many_partitions(spark):
    r = random.Random(8)
    rows = [(1, k // 2, r.choice(["user", "assistant"]), r.choice(["same.", f"own {k}.", f"cut {k}", ""])) for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {tuple(x) for b in (100, 1024) for x in repair.repair_digests(turns, block_rows=b).collect()}
    assert len(found) == 1 and len(next(iter(found))[7]) >= 3000


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digests(repair.damaged(none), every=none).collect() == [] and repair.repair_turns(none).collect() == []


def test_grammars_that_leave_a_choice_are_refused():
    with pytest.raises(ValueError):
        repair.RoleGrammar("x", {"x": {"u": "x", "a": "x"}}, frozenset({"x"}))


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert rows_of_spark(QUERIES["op12_conversation_repair"](spark, sf_dir)) == rows_of_sql(ORACLE_SQL["op12_conversation_repair"], sf_dir)
