"""Saved scans of a key/value store and saved replies of a site, as Spark data sources.

A folder holds files of JSON lines; each file is a partition, and a stream takes the files that came since its last batch, in order of their names.
Tests on names are pushed into the readers, so lines of other names are not even decoded.  Files are read by their URI with Arrow's file systems.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

#: Fixed value: how much of a reply that is no success is kept.
HEAD = 300


@dataclass
class _File(InputPartition):
    uri: str


@dataclass(frozen=True)
class Names:
    """Which values of the name column are asked for: each of the tests has to hold."""

    equal: tuple[frozenset[str], ...] = ()
    prefixes: tuple[str, ...] = ()

    def holds(self, name: str) -> bool:
        return all(name in e for e in self.equal) and all(name.startswith(p) for p in self.prefixes)


def _files(uri: str) -> list[str]:
    """The files of a folder by name, without hidden ones."""
    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    prefix = uri.rstrip("/")
    return sorted(f"{prefix}/{f.base_name}" for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _lines(uri: str) -> Iterator[str]:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (w.decode() for w in whole if w.strip())
        if rest.strip():
            yield rest.decode()


class _Reader(DataSourceReader):
    def __init__(self, source: _JsonFolder):
        self.source, self.names = source, Names()

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.source.named,) and isinstance(f.value, str):
                self.names = Names((*self.names.equal, frozenset([f.value])), self.names.prefixes)
            elif isinstance(f, In) and f.attribute == (self.source.named,) and all(isinstance(v, str) for v in f.value):
                self.names = Names((*self.names.equal, frozenset(f.value)), self.names.prefixes)
            elif isinstance(f, StringStartsWith) and f.attribute == (self.source.named,):
                self.names = Names(self.names.equal, (*self.names.prefixes, f.value))
            else:
                yield f

    def partitions(self) -> list[_File]:
        return [_File(u) for u in _files(self.source.uri)]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is not None:  # Spark reads a folder without files as one partition that is None
            yield from self.source.rows(partition.uri, self.names)


class _StreamReader(DataSourceStreamReader):
    """The offset is the name of the last file that was taken; files must come in order of their names."""

    def __init__(self, source: _JsonFolder):
        self.source = source

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = _files(self.source.uri)
        return {"after": found[-1] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(u) for u in _files(self.source.uri) if start["after"] < u <= end["after"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from self.source.rows(partition.uri, Names())

    def commit(self, end: dict) -> None:
        pass


class _JsonFolder(DataSource):
    named = ""

    @property
    def uri(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError(f"{self.name()} needs the path of a folder")
        return path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}"

    def rows(self, uri: str, names: Names) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self)


class StoreScan(_JsonFolder):
    """Lines ``{"cursor": n, "key": "...", "fields": {...}}`` of scans, as ``key, fields, cursor``; a scan may give a key several times."""

    named = "key"

    @classmethod
    def name(cls) -> str:
        return "store_scan"

    def schema(self) -> str:
        return "key string, fields map<string, string>, cursor long"

    def rows(self, uri: str, names: Names) -> Iterator[tuple]:
        for line in _lines(uri):
            row = json.loads(line)
            if names.holds(row["key"]):
                yield row["key"], {k: None if v is None else str(v) for k, v in row["fields"].items()}, row.get("cursor", 0)


class SavedReplies(_JsonFolder):
    """Lines ``{"path": "...", "status": n, "body": "..."}`` of replies, as ``path, status, body, head``: the body of a success that is JSON, else the first ``HEAD`` characters."""

    named = "path"

    @classmethod
    def name(cls) -> str:
        return "saved_replies"

    def schema(self) -> str:
        return "path string, status int, body string, head string"

    def rows(self, uri: str, names: Names) -> Iterator[tuple]:
        for line in _lines(uri):
            row = json.loads(line)
            if not names.holds(row["path"]):
                continue
            body, status = row.get("body") or "", row["status"]
            try:
                good = 200 <= status < 300 and json.loads(body) is not None
            except json.JSONDecodeError:
                good = False
            yield row["path"], status, body if good else None, None if good else body[:HEAD]


def register(spark: SparkSession) -> None:
    """Makes ``store_scan`` and ``saved_replies`` formats of ``spark.read`` and ``spark.readStream``, with tests on names pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (StoreScan, SavedReplies):
        spark.dataSource.register(source)


def records(scan: DataFrame, needed: str = "limit") -> DataFrame:
    """``key, fields`` of a scan, each key once as it was given last, without those that lack the ``needed`` field.  Of rows with one cursor the one with the greatest fields counts."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    last = scan.groupBy("key").agg(F.max(F.struct("cursor", text.alias("text"))).alias("r"))
    return last.select("key", F.from_json("r.text", "map<string, string>").alias("fields")).where(F.map_contains_key("fields", needed))
