"""Chat windows, URL filters and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, documents, words  # noqa: E402
from test_pairs import brute_groups  # noqa: E402

import corpus_pipeline  # noqa: E402
from marketlens.llm import chat, queries, url_filter  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, tokens long, n int"


def brute_digests(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations() -> list[tuple]:
    marks = "<|turn|>user<|text|></s>[INST] <\\|end|> [/INST] <|end|>"
    rows = [(1, 0, "system", "be brief"), *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 13)) for k in range(1, 60)]]
    rows += [(2, 0, "user", marks), (2, 1, "assistant", marks), (3, 0, "assistant", None), (3, None, None, "x"), (None, 0, "user", "no id"), (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "y" * 20_000), (5, 0, "<|text|>", "")]
    return [(*r, 1, 2) for r in rows]


def test_chat_round_trip_and_digests(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    windows = chat.format_conversations(df, budget=128, history=40)
    found = chat.conversation_digests(chat.read_windows(windows)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_digests(conversations())


def test_chat_windows_keep_to_their_budget(spark):
    windows = chat.read_windows(chat.format_conversations(spark.createDataFrame(conversations(), TURNS), budget=128, history=40)).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3
    for k, w in enumerate(windows):
        assert w["n_tokens"] <= 128 and w["text"].startswith("<|turn|>system<|text|>be brief<|end|>")
        assert w["n_repeated"] >= (1 if k else 0) and "".join(w["targets"]) == "".join(t["text"] for t in w["turns"] if t["role"] == "assistant")


def test_chat_empty(spark):
    assert chat.conversation_digests(chat.read_windows(chat.format_conversations(spark.createDataFrame([], TURNS)))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", ">", "[", "a", "end|>", "turn"]), max_size=12).map("".join))
def test_chat_escapes_are_reversible(text):
    told = chat.escape(text)
    assert chat.unescape(told) == text
    assert not any(c in told for c in chat.CONTROLS)


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = queries.op6_chat_windows(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_digests(rows)


URLS = [
    None, "", "no scheme", "http://EXAMPLE.org/es/x?q#f", "https://a.example.org/en/12", "https://notexample.org/es/", "ftp://x.com/fr/a", "http://spam.net", "http://a.b.spam.net/deep/er?x", "http://myspam.net/",
    "http://part.io/ads/banner/1", "http://part.io/adsense", "http://part.io/", "x://y://part.io/ads", "http://part.io//ads//z", "http://", "http:///ads", "http://part.io?u=/ads", "http://spam.net.evil.com/",
]
LISTED = ["spam.net", "http://Part.io/ads/", "part.io/" + "/".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopq"), None, "/nothing"]


def brute_verdict(url: str | None) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = m[1].lower(), m[2]
    best = None
    for what, rule in queries.URL_RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = what, rule
    if best:
        return url, host, path, best[1], best[0]
    segments = [x for x in path.split("/") if x]
    for entry in LISTED:
        if entry and (e := entry.split("://")[-1].strip("/").lower()) and not entry.startswith("/"):
            name, *own = e.split("/")
            if (host == name or host.endswith("." + name)) and segments[: len(own)] == own:
                return url, host, path, None, "block"
    return url, host, path, None, "allow"


def test_url_verdicts(spark):
    urls = [*URLS, "http://part.io/" + "/".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopq") + "/end"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, rule string")
    found = url_filter.judge_urls(pages, queries.URL_RULES, spark.createDataFrame([(x,) for x in LISTED], "entry string")).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in found} == {i: brute_verdict(u)[1:] for i, u in enumerate([*urls, *urls])}
    assert len(found) == 2 * len(urls)


def test_url_empty_list_and_table(spark):
    empty = spark.createDataFrame([], "entry string")
    pages = spark.createDataFrame([(1, "http://spam.net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages, [], empty).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), [], empty).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage against brute force on what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert out.columns == columns
        if name == "language":
            kept = {r["doc_id"]: r["lang"] for r in out.collect()}
            assert len(kept) >= 0.9 * sum(any(c.isalpha() for c in t or "") for _, t in given)
            assert None not in kept.values()
        if name == "exact_dedup":
            strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
            best = {}
            for d, t in given:
                key = (t or "").translate(strip)
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
            assert {r["doc_id"] for r in out.collect()} == {d for _, d in best.values()}
        if name == "near_dedup":
            assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in brute_groups(given)}
        if name == "mixing":
            sizes = {d: len(words(t)) for d, t in given}
            got = defaultdict(int)
            for r in out.collect():
                got[r["doc_id"]] += len(words(r["text"]))
            assert all(n <= 2 * sizes[d] for d, n in got.items())
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in given}
        docs = out
        if name != "packing":
            given = [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_pipeline_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([d[:5] for d in documents()], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_chat_query_and_its_sql(spark, sf_dir):
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from oracle import rows_of_spark, rows_of_sql

    assert rows_of_spark(queries.op6_chat_windows(spark, sf_dir)) == rows_of_sql(queries.ORACLE_SQL["op6_chat_windows"], sf_dir)


def test_chat_windows_by_plain_prefix_sums(spark):
    """Budget 128, history 40: windows, repeats and tokens of each conversation as a loop over its turns finds them."""
    want = []
    by = defaultdict(list)
    for conv, turn, role, text, *_ in conversations():
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns = [(r, t, -(-(len(r.encode()) + len(t.encode()) + 26) // 4)) for *_, r, t in sorted(turns)]
        system = turns[0][2] if turns[0][0] == "system" else 0
        room, before, rows, last, held = max(128 - 80 - system, 40), 0, [], None, []
        for n, (_, _, k) in enumerate(turns):
            own = 0 if system and n == 0 else k
            cell = before // room, own > 40 and (before + own - 1) // room > before // room
            if cell != last:
                reach = min(40, max(0, 128 - own - system)) if cell[1] else 40
                past = [q for q, at in held if at >= before - reach]
                rows.append([conv, len(rows), (system if rows else 0) + sum(past), len(past) + bool(system and rows)])
                last = cell
            rows[-1][2] += k
            if own:
                held.append((k, before))
            before += own
        want += map(tuple, rows)
    found = chat.format_conversations(spark.createDataFrame(conversations(), TURNS), budget=128, history=40)
    assert sorted(map(tuple, found.select("conv_id", "window", "n_tokens", "n_repeated").collect()), key=repr) == sorted(want, key=repr)
