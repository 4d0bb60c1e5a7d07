"""Pipeline stages decide by row, whatever the ids."""

from __future__ import annotations

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(tag: str, n: int = 40) -> str:
    return " ".join(f"{tag}{k}" for k in range(n))


def _rows(pairs: list[tuple]) -> list[tuple]:
    return [(d, t, "en", "a", len(t)) for d, t in pairs]


def _stage(spark, name: str, pairs: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame(_rows(pairs), SCHEMA).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    given = [(None, _text("u")), (None, _text("v")), (1, _text("a")), (1, _text("a")), (3, _text("c")), (5, _text("x")), (5, _text("c")), (None, _text("a"))]
    want = [(None, _text("u")), (None, _text("v")), (1, _text("a")), (3, _text("c")), (5, _text("x"))]
    assert _stage(spark, "exact_dedup", given) == sorted(want, key=repr)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    near = lambda tag: _text(tag, 80).replace(f"{tag}40 ", "other ")
    given = [(None, _text("u", 80)), (None, near("u")), (None, _text("v", 80)), (1, _text("a", 80)), (1, _text("a", 80)), (None, near("a")), (3, _text("c", 80)), (5, _text("x", 80)), (5, near("c")), (7, _text("y", 80)), (7, _text("z", 80)), (None, ""), (8, "")]
    found = _stage(spark, "near_dedup", given)
    group_u = [r for r in found if r in [(None, _text("u", 80)), (None, near("u"))]]
    assert len(group_u) == 1
    want = [(None, _text("v", 80)), (1, _text("a", 80)), (3, _text("c", 80)), (5, _text("x", 80)), (7, _text("y", 80)), (7, _text("z", 80)), (None, ""), (8, "")]
    assert found == sorted(want + group_u, key=repr)


def _stored_mb(folder) -> float:
    return sum(f.stat().st_size for f in folder.rglob("*.parquet")) / 1e6


def test_stages_store_no_copy_of_the_texts_of_files(spark, tmp_path):
    """What a stage leaves in the shared folder is far less than the texts, which lie in files already."""
    import random
    from pathlib import Path

    rng = random.Random(2)
    pairs = [(k % 500, " ".join(f"{rng.randrange(16**8):08x}" for _ in range(300))) for k in range(1000)]
    spark.createDataFrame(_rows(pairs), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    given = _stored_mb(tmp_path / "docs")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for name in ("exact_dedup", "near_dedup", "mixing"):
        docs, before = spark.read.parquet(f"{tmp_path}/docs"), _stored_mb(shared)
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        texts = {r["text"] for r in out.collect()}
        assert name == "mixing" or texts == {t for _, t in pairs}
        assert _stored_mb(shared) - before < 0.3 * given, name


def test_rows_of_files_are_numbered_once_each(spark, tmp_path):
    from pyspark.sql import functions as F

    from marketlens.storage import Scratch, numbered

    spark.range(1000).withColumn("_metadata", F.lit("own")).repartition(4).write.parquet(f"{tmp_path}/rows")
    docs = spark.read.parquet(f"{tmp_path}/rows")
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, n in ((docs, 1000), (twice, 2000), (docs.union(docs), 2000), (spark.range(10).toDF("id"), 10), (docs.where("id < 0"), 0), (docs.join(twice.drop("_metadata"), "id"), 2000)):
        found = numbered(df, Scratch(spark, "test"))
        assert found.columns == [*df.columns, "_row"]
        one, two = ([tuple(r) for r in found.collect()] for _ in range(2))
        assert len({r[-1] for r in one}) == len(one) == n and sorted(one) == sorted(two)
