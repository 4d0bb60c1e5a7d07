"""Writing what was read: spreadsheets, reports, and results that only a passed verification publishes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as T


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: one spreadsheet line per row, without its head."""
    return rows.select(F.concat_ws(",", *[T.csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A folder of part files with CR LF line ends, each beginning with a byte order mark and the head, so each opens by itself."""
    head = "\ufeff" + ",".join(columns)

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and len(b):
                lines = b.column(0)
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([f"{head}\r\n{lines[0].as_py()}"]), lines.slice(1).cast(pa.string())])], ["value"])
                first = False
            yield b

    # Each part's first line carries the head: parts stay apart, nothing is gathered.
    csv_lines(rows, columns).mapInArrow(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def markdown_line(columns: list[str]) -> Column:
    """A row as a line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[T.markdown_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |"))


def fenced(text: Column, fence: str = "`") -> Column:
    """A text between fences that are longer than any run of the fence's character in it."""
    marks = F.repeat(F.lit(fence), F.greatest(F.lit(3), T.longest_run(text, fence) + 1))
    return F.concat(marks, F.lit("\n"), text, F.lit("\n"), marks)


_GENERATION, _MANIFESTS = "generation-", "manifests"


class Published:
    """A folder of published tables that is switched from one state to the next in one step.

    Tables are written under a new generation, which nobody reads yet.  A manifest, a small numbered file, then names the generation and its tables; it is written beside
    the others and renamed, and a rename to a name that exists fails, so of two writers one wins and the other raises.  Readers follow the manifest with the highest number.
    A job that dies before the rename leaves the old state, after it the new one.  Generations that no kept manifest names are deleted by ``sweep``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, under: str) -> list[str]:
        path = self._path(f"{self.folder}/{under}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names(_MANIFESTS) if n.endswith(".json")]

    def _read(self, manifest: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{_MANIFESTS}/{manifest}").collect()))

    def state(self) -> dict | None:
        """The newest manifest: ``number, passed, generation, tables``; null where nothing was published."""
        found = self._manifests()
        return self._read(found[-1]) if found else None

    def table(self, name: str) -> DataFrame | None:
        """A published table, or null if the last verification did not pass or never was."""
        state = self.state()
        if state is None or name not in state["tables"]:
            return None
        return self.spark.read.parquet(f"{self.folder}/{_GENERATION}{state['generation']}/{name}")

    def write(self, generation: str, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{_GENERATION}{generation}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def switch(self, generation: str, passed: bool, tables: list[str], after: int) -> None:
        """The one step by which readers see another state; ``after`` is the number of the manifest that it follows."""
        target = self._path(f"{self.folder}/{_MANIFESTS}/{after + 1:020d}.json")
        made = self._path(f"{self.folder}/{_MANIFESTS}/.{generation}.tmp")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps({"number": after + 1, "passed": passed, "generation": generation, "tables": sorted(tables)}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise ConcurrentPublish(f"another job published state {after + 1} of {self.folder}")

    def sweep(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` manifests, generations that none of these names, and what failed jobs left.  No job may be publishing meanwhile; readers of older states
        fail, so keep as many as are still read."""
        found = self._manifests()
        for name in [*found[: -keep or None], *(n for n in self._names(_MANIFESTS) if not n.endswith(".json"))]:
            self._fs.delete(self._path(f"{self.folder}/{_MANIFESTS}/{name}"), False)
        named = {self._read(n)["generation"] for n in found[-keep:]} if keep else set()
        for name in self._names(""):
            if name.startswith(_GENERATION) and name.removeprefix(_GENERATION) not in named:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class ConcurrentPublish(RuntimeError):
    """Two jobs published at once; this one's state is not seen."""


def publish(verification: DataFrame, tables: dict[str, DataFrame], folder: str) -> bool:
    """Publishes ``verification`` always, and the tables only if every row of it has ``passed``; else none are published any more.  Returns whether they
    were.  An empty verification has not passed.  Readers see the state before or after, never a part, whenever the job dies; see ``Published``."""
    if "verification" in tables:
        raise ValueError("the verification is published beside the tables, under this name")
    target = Published(verification.sparkSession, folder)
    state = target.state()
    generation = uuid.uuid4().hex
    stored = target.write(generation, "verification", verification)
    passed = bool(stored.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False))).first()[0])
    if passed:
        for name, rows in tables.items():
            target.write(generation, name, rows)
    target.switch(generation, passed, ["verification", *(tables if passed else [])], state["number"] if state else 0)
    return passed
