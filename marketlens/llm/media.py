"""Media columns: payloads stored losslessly as FLAC and read back as PCM blocks with sample offsets.

A payload is a text's UTF-8 bytes and then bytes 0 up to a positive multiple of ``PAD``.  Byte ``b`` is the signed
8-bit sample ``b - 128``; PCM blocks hold unsigned 8-bit samples, so they are the payload's bytes again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import flac

PAD = 64
BLOCKS = "array<struct<sample_offset: long, n_samples: int, pcm: binary>>"


#: Rows that are worked on at a time.
_SLICE = 1000


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), _SLICE):
            yield b[k : k + _SLICE]


def payload(text: str | None) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, media`` for every row; null texts count as empty.  Equal texts give equal media."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            made: dict = {}
            for t in pdf["text"]:
                if t not in made:
                    p = payload(t)
                    made[t] = (len(t.encode("utf-8", "surrogatepass")) if t else 0, flac.encode(np.frombuffer(p, dtype=np.uint8).astype(np.int64) - 128, block=block))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [made[t][0] for t in pdf["text"]], "media": [made[t][1] for t in pdf["text"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds ``blocks``: the PCM blocks of each stream, each with the offset of its first sample.

    Expects a column ``media``; other columns stay.  A null stream has null blocks.  A stream whose
    checksums do not hold raises ``FlacError`` rather than giving other samples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            made: dict = {}
            out = []
            for s in pdf["media"]:
                if s is None:
                    out.append(None)
                    continue
                key = hashlib.sha256(s).digest()
                if key not in made:
                    made[key] = [{"sample_offset": at, "n_samples": len(x), "pcm": (x + 128).astype(np.uint8).tobytes()} for at, x in flac.decode(bytes(s))[1]]
                out.append(made[key])
            yield pdf.assign(blocks=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInPandas(run, f"{kinds}, blocks {BLOCKS}")


def describe_media(read: DataFrame) -> DataFrame:
    """Digests and features of what was read back: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``.

    The feature is the mean level, the root mean square around it, and the number of sign changes of the samples.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    def facts(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for row in blocks:
            digest, size, tail, total, square, signs, last = hashlib.sha256(), 0, b"", 0, 0, 0, None
            for b in row:
                pcm = bytes(b["pcm"])
                digest.update(pcm)
                x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
                size, tail = size + len(pcm), (tail + pcm)[-PAD:]
                total, square = total + int(x.sum()), square + int((x * x).sum())
                up = x >= 0
                signs += int((up[1:] != up[:-1]).sum()) + (last is not None and bool(up[0]) != last)
                last = bool(up[-1])
            mean = total / size
            out.append((size, digest.hexdigest(), zlib.crc32(tail), f"mean={mean:.4f};rms={max(0.0, square / size - mean * mean) ** 0.5:.4f};sign_changes={signs}"))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    stored = read.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), facts("blocks").alias("f"))
    return stored.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "media_bytes", "media_sha256", "f.feature")
