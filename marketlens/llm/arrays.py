"""Packed columns of numbers for shuffles, and sums of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers by byte planes, compressed; ascending ones as differences."""
    if ascending and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data)
    values = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=dtype) if ascending else values


def summed(rows: DataFrame, key: str, kind: str, values: str = "counts", lanes: int = 16) -> DataFrame:
    """One row per ``key`` with the sum of its packed int64 arrays; partial sums first, so no group is unbounded."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = unpack(pdf[values].iloc[0], np.int64).copy()
        for v in pdf[values].iloc[1:]:
            total += unpack(v, np.int64)
        return pd.DataFrame({key: [pdf[key].iloc[0]], values: [pack(total)]})

    schema = f"{key} {kind}, {values} binary"
    partial = rows.withColumn("_lane", F.pmod(F.xxhash64(values), F.lit(lanes))).groupBy(key, "_lane").applyInPandas(add, schema)
    return partial.groupBy(key).applyInPandas(add, schema)
