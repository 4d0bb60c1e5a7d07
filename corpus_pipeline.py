"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Each stage works on all rows that the one before it kept.  Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import exact_dedup, jaccard_join, language, mixing, packing
from marketlens.llm.queries import remainder
from marketlens.storage import Scratch, numbered


def _kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``rows`` whose ``_row`` is in ``kept``, without it."""
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*[c for c in rows.columns if c != "_row"])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of whose letters less than half are in one language; labels the rest."""
    model = language.train(docs.where(F.coalesce(remainder(4) != 2, F.lit(True))))
    # As two structs, so that no column of the input clashes.
    found = docs.select(F.struct(*docs.columns).alias("row"), language.identify(model, docs, F.col("text"), with_spans=False).alias("found"))
    sure = found.where((F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= 0.5))
    of = lambda c: F.coalesce("row.lang", "found.lang") if c == "lang" else F.col("row")[c]
    return sure.select(*[of(c).alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    rows = numbered(docs, Scratch(spark, "exact-rows"))
    return _kept(rows, exact_dedup.exact_duplicates(rows, carry=("_row",)).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id (null ids last), then the first as read."""
    rows = numbered(docs, Scratch(spark, "near-rows"))
    groups = jaccard_join.jaccard_groups(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    best = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("best"))
    return _kept(rows, best.select("best._row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixing.mix_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models and draws of the stages are not expressible in SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
