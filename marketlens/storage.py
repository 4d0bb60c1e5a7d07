"""Intermediate tables in the folder that all executors share.

A stored table cuts lineage: when an executor is lost, only the running stage is repeated.  The folder is
``spark.checkpoint.dir``; only where a local session leaves it unset is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; raises where a cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="marketlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """A new subfolder of the shared folder for one run of an operator.

    ``table`` writes a DataFrame there as Parquet and returns it as read back.  Tables that a returned lazy
    result still reads must stay; ``drop`` and ``keep`` delete those that nothing needs any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/marketlens/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held[id(out)] = out, path  # the table is held too, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(id(t))

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these, which a lazy result still reads."""
        kept = {id(t) for t in tables}
        for key in [k for k in self._held if k not in kept]:
            self._delete(key)

    def _delete(self, key: int) -> None:
        if key in self._held:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self._held.pop(key)[1])
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(docs: DataFrame, scratch: Scratch, name: str = "_row") -> DataFrame:
    """``docs`` with a number of each row, the same at every reading, whatever its ids.

    Rows of Parquet files are numbered by file and place in it and are read from there again; others, or rows that are not
    each a row of a file of their own, are stored first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        placed = docs.select(*docs.columns, at["file_path"].alias("_file"), at["row_index"].alias("_place"))
    except AnalysisException:
        return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    number = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "_file string, _first long")
    out = placed.join(F.broadcast(number), "_file").select(*docs.columns, (F.col("_first") + F.col("_place")).alias(name))
    if out.groupBy(name).count().where("count > 1").limit(1).count():
        return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return out
