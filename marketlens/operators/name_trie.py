"""Edit-distance joins by tries: all names of one length, in blocks of bounded size, are walked once for many pieces.

A piece meets the blocks of the lengths within its reach, a few rows in all, whatever the edits allowed.  Inside a block every prefix of names is
one node; a piece carries a row of edit distances to a node and goes no further where all of them are above what the names allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a block, pieces that meet it in one group, and rows of distances that are worked on at a time.
BLOCK, GROUP, _ROWS = 20_000, 50_000, 400_000


def _codes(texts: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(texts), size)


class Trie:
    """Distinct names of one length: level ``d`` has a node for each prefix of ``d`` characters, named by the first name that has it."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.size = len(self.names[0])
        self.chars = _codes(self.names, self.size)
        order = np.lexsort(self.chars.T[::-1]) if self.size else np.arange(len(self.names))
        self.chars, self.names = self.chars[order], [self.names[i] for i in order]
        differ = self.chars[1:] != self.chars[:-1]
        # How many characters each name shares with the one before it.
        shared = np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), self.size))) if self.size else np.array([-1])
        self.levels = [np.flatnonzero(shared < d) if d else np.zeros(1, dtype=np.int64) for d in range(self.size + 1)]

    def near(self, pieces: list[str], allowed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of pieces of one length and of names, and their distances, where these are at most ``allowed``."""
        together = max(1, _ROWS // len(self.names))
        for k in range(0, len(pieces), together):
            some = pieces[k : k + together]
            length = len(some[0])
            text = _codes(some, length)
            piece, node, rows = np.arange(len(some)), np.zeros(len(some), dtype=np.int64), np.tile(np.arange(length + 1, dtype=np.int16), (len(some), 1))
            steps = np.arange(length + 1, dtype=np.int16)
            for d in range(self.size):
                begin = np.searchsorted(self.levels[d + 1], self.levels[d])
                n = np.diff(np.append(begin, len(self.levels[d + 1])))[node]
                came = np.repeat(np.arange(len(node)), n)
                child = np.arange(len(came)) + np.repeat(begin[node] - np.cumsum(n) + n, n)
                char = self.chars[self.levels[d + 1][child], d]
                before, piece = rows[came], piece[came]
                rows = np.empty_like(before)
                rows[:, 0] = d + 1
                np.minimum(before[:, 1:] + 1, before[:, :-1] + (text[piece] != char[:, None]), out=rows[:, 1:])
                rows = np.minimum.accumulate(rows - steps, axis=1) + steps
                live = rows.min(axis=1) <= allowed
                piece, node, rows = piece[live], child[live], rows[live]
            found = rows[:, -1] <= allowed
            yield piece[found] + k, self.levels[self.size][node[found]], rows[found, -1]


def _met(key: tuple, pieces: pd.DataFrame, names: pd.DataFrame, limit: int) -> pd.DataFrame:
    out = []
    if len(pieces) and len(names):
        trie, allowed = Trie(names["name"].tolist()), int(names["allowed"].iloc[0])
        for _, group in pieces.groupby(pieces["piece"].str.len()):
            texts = group["piece"].tolist()
            for piece, name, distance in trie.near(texts, allowed):
                # The block's names are in order, so the first of a piece by distance and number are its best ones.
                order = np.lexsort((name, distance, piece))
                piece, name, distance = piece[order], name[order], distance[order]
                rank = np.arange(len(piece)) - np.searchsorted(piece, piece)
                out += [(texts[p], trie.names[n], int(d)) for p, n, d in zip(piece[rank < limit], name[rank < limit], distance[rank < limit])]
    return pd.DataFrame(out, columns=["piece", "name", "distance"]).assign(size=key[0])


def near_names(pieces: DataFrame, names: DataFrame, allowed: Column, limit: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``piece, name, distance, size``: for every distinct ``piece`` the closest ``limit`` names of each block of ``name``, at most ``allowed`` edits away.

    ``allowed`` is over the length of a name, ``size``; names for which it is null or negative are never met.  Null pieces and names are left out.  The numbers of names
    and of pieces of each length, of which there are few, decide how many blocks and groups there are, so that neither side of a group grows with its table.
    """
    own = names.where("name IS NOT NULL").select("name").distinct().withColumn("size", F.length("name")).withColumn("allowed", allowed.cast("int")).where("allowed >= 0")
    asked = pieces.where("piece IS NOT NULL").select("piece").distinct().withColumn("length", F.length("piece"))
    blocks = own.groupBy("size", "allowed").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    most = F.coalesce(F.max("allowed"), F.lit(0))
    reach = blocks.agg(most).first()[0]
    lengths = asked.groupBy("length").agg(F.count("*").alias("n"))
    sizes = lengths.select("n", "length", F.explode(F.sequence(F.greatest(F.lit(0), F.col("length") - reach), F.col("length") + reach)).alias("size")).join(blocks, "size")
    groups = sizes.where(F.abs(F.col("length") - F.col("size")) <= F.col("allowed")).groupBy("size", "allowed", "blocks").agg(F.ceil(F.sum("n") / F.lit(group)).cast("int").alias("groups"))
    groups = groups.select("size", F.col("allowed").alias("within"), "blocks", "groups")
    # Every name goes to one block, for each group of pieces; every piece to one group, for each block.
    named = own.join(groups, "size").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks"))).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    spread = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("length") - reach), F.col("length") + reach))).join(groups, "size")
    spread = spread.where(F.abs(F.col("length") - F.col("size")) <= F.col("within")).withColumn("group", F.pmod(F.xxhash64("piece"), F.col("groups")))
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = lambda df: [F.col("size").cast("int").alias("size"), F.col("block").cast("int").alias("block"), F.col("group").cast("int").alias("group")]
    left = spread.select(*keys(spread), "piece").groupBy("size", "block", "group")
    right = named.select(*keys(named), "name", "allowed").groupBy("size", "block", "group")
    return left.cogroup(right).applyInPandas(lambda key, a, b: _met(key, a, b, limit), "piece string, name string, distance int, size int")
