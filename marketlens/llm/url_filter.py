"""URL filters: a blocked Bloom filter in front of an exact join.

The list holds canonical URL entries: a host, or a host and a path prefix that ends at a path segment.  A URL's
candidate entries are its host and the host's parents, each with every path prefix.  A blocked Bloom filter of
fixed size (32-byte blocks, eight bits per entry, one in each word) is built from the list by a bit-wise
aggregation and broadcast; URLs none of whose candidates pass are done.  The few that pass meet the list
in an exact join, which removes false positives.  A larger list only lets more of them through to the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocks of 32 bytes that the filter has at most: 8 MB.
MOST_BLOCKS = 1 << 18
_BITS_PER_ENTRY = 16


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``(verdict, host/path)`` rules that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def candidates(host: Column, path: Column, max_parts: int) -> Column:
    """All entries that would cover a URL: hosts from the URL's own to its parents, by path prefixes.

    Entries look like ``host/`` or ``host/a/b``; a trailing slash and a file's ending are not part of one.
    Entries have at most ``max_parts`` labels and path segments, counted from the right and the left: as many as the longest of the list.
    """
    labels = F.slice(F.split(host, r"\."), -max_parts, max_parts)
    labels = F.when(F.size(F.split(host, r"\.")) <= max_parts, F.split(host, r"\.")).otherwise(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(max_parts)), "."))
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, max_parts)
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("/"), p))))
    return F.when(host != "", both).otherwise(F.array().cast("array<string>"))


def canonical(entry: Column) -> Column:
    """A listed entry or URL in the form of ``candidates``: no scheme, lower-case host, no empty path segments."""
    bare = F.regexp_replace(entry, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(bare, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(bare, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(host != "", F.concat(host, F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/")))


def _block_and_bits(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.shiftrightunsigned(h, 40), F.lit(blocks))
    return block, [F.pmod(F.shiftrightunsigned(h, 5 * i), F.lit(32)) for i in range(8)]


def bloom_filter(entries: DataFrame) -> tuple[np.ndarray, int]:
    """Words of the filter, eight 32-bit ones a block, of the column ``entry``, and the number of blocks."""
    n = entries.count()
    blocks = int(min(MOST_BLOCKS, 1 << max(0, (n * _BITS_PER_ENTRY // 256).bit_length())))
    block, bits = _block_and_bits(F.xxhash64("entry"), blocks)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))).alias(f"w{i}") for i, b in enumerate(bits)]
    rows = entries.groupBy(block.alias("block")).agg(*words).collect()
    table = np.zeros((blocks, 8), dtype=np.uint32)
    for r in rows:
        table[r["block"]] = [r[f"w{i}"] for i in range(8)]
    return table, blocks


def listed(urls: DataFrame, key: str, host: Column, path: Column, listing: DataFrame, entry_col: str = "entry") -> DataFrame:
    """The distinct ``key`` of rows that an entry of ``listing`` covers."""
    entries = listing.select(canonical(F.col(entry_col)).alias("entry")).where("entry is not null").distinct()
    words, blocks = bloom_filter(entries)
    sent = urls.sparkSession.sparkContext.broadcast(words)
    parts = F.greatest(F.size(F.split("entry", "/")), F.size(F.split(F.substring_index("entry", "/", 1), r"\.")))
    longest = entries.agg(F.max(parts)).first()[0] or 1

    @F.pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        x = h.to_numpy(dtype=np.int64).view(np.uint64)
        rows = sent.value[((x >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)]
        hit = np.ones(len(x), dtype=bool)
        for i in range(8):
            hit &= (rows[:, i] >> ((x >> np.uint64(5 * i)) % np.uint64(32)).astype(np.uint32)) & 1 == 1
        return pd.Series(hit)

    probes = urls.select(F.col(key).alias("_key"), F.explode(candidates(host, path, longest)).alias("entry"))
    probes = probes.withColumn("_hash", F.xxhash64("entry")).where(may_hold("_hash")).drop("_hash")
    return probes.join(entries, "entry", "left_semi").select("_key").distinct()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listing: DataFrame, id_col: str = "page_id", url_col: str = "url", entry_col: str = "entry") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    The longest fitting rule decides; where none fits, a URL that ``listing`` covers is blocked and any other
    allowed.  A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Repeated rows are judged each; an empty list blocks nothing.  Other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("rule", rule).withColumn("own", verdict)
    open_urls = judged.where("rule is null and host != ''").select("host", "path")
    keyed = open_urls.withColumn("key", F.struct("host", "path"))
    hits = listed(keyed, "key", F.col("host"), F.col("path"), listing, entry_col).select(F.col("_key.host").alias("host"), F.col("_key.path").alias("path"), F.lit(True).alias("hit"))
    return judged.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("hit") & F.col("rule").isNull(), "block").otherwise("allow")).alias("verdict")
    )
