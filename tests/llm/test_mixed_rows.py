"""Mixed texts: whole documents stay whole, and rows lie as the splitting tree deals them."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import words  # noqa: E402

from marketlens.llm.mixing import mix_segments, mix_texts  # noqa: E402

SCHEMA = "doc_id long, text string, source string"
SMALL = {"block_words": 16, "shard_blocks": 8}


def _docs(spark):
    rows = [(i, "  " + "\n ".join(f"d{i}w{k}" for k in range(1 + 37 * i % 90)) + "\t", "ab"[i % 2]) for i in range(40)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_documents_taken_whole_keep_their_text(spark):
    rows, df = _docs(spark)
    found = mix_texts(df, weights=(1,), share=2.0, **SMALL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter({(d, t): 2 for d, t, _ in rows})


def test_rows_are_runs_of_words_by_shard_and_place(spark):
    rows, df = _docs(spark)
    own, segments = mix_segments(df, **SMALL)
    ids = {r["uid"]: r["doc_id"] for r in own.collect()}
    spans = defaultdict(list)
    for s in segments.collect():
        spans[ids[s["uid"]], s["pass"]].append((s["first_word"], s["n_words"], s["shard"], s["place"]))
    want, merged = [], 0
    for (doc_id, _), parts in spans.items():
        runs = []
        for first, n, shard, place in sorted(parts):
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1][1] += n
                merged += 1
            else:
                runs.append([first, n, shard, place])
        text = words(rows[doc_id][1])
        want += [((shard, place), doc_id, text[a : a + n]) for a, n, shard, place in runs]
    assert merged and len({w[0][0] for w in want}) > 2
    found = mix_texts(df, **SMALL)
    assert found.columns == df.columns
    parts = [[(r["doc_id"], words(r["text"])) for r in p] for p in found.rdd.glom().collect()]
    at = {(d, tuple(w)): k for k, d, w in want}
    twice = [k for k, n in Counter((d, tuple(w)) for _, d, w in want).items() if n > 1]
    assert Counter((d, tuple(w)) for p in parts for d, w in p) == Counter((d, tuple(w)) for _, d, w in want)
    home = defaultdict(set)
    for i, p in enumerate(parts):
        known = [at[d, tuple(w)] for d, w in p if (d, tuple(w)) not in twice]
        assert known == sorted(known)
        for shard, _ in known:
            home[shard].add(i)
    assert all(len(v) == 1 for v in home.values())
