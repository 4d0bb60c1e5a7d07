"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Incidence: texts are gathered into chunks.  A chunk sends each n-gram of its sets once to the column block that
   owns the n-gram's hash range; blocks add up in how many sets it lies and send a one-byte rank back.
   The number of blocks follows the text's size, so a block holds about as many n-grams at any scale.
   Documents with equal sets (by a 128-bit digest) are one node from here on.
2. Ranks order n-grams from rare to frequent.  If two sets reach the threshold, they share an n-gram among the
   first ``n - ceil(t * n) + 1`` of either; of these only n-grams that lie in two sets are multiplied.
   A node whose rare n-grams are its own takes no part any more.
3. Product: size and position bounds discard pairs that cannot reach the threshold.  In each column the nodes
   are first paired with a few pivots only.  Overlaps counted over both prefixes discard most pairs; for those left the
   n-grams of one node meet blocks of other nodes' n-grams, and the accumulated counts decide.
   Links give components.  What is then left of a column are pairs of nodes in different components.  For a few turns
   the minority meets pivots drawn from the majority, so a node that links to a fair share of it joins it unpaired with
   the others; at last what is still apart is paired.  A large group of near copies, joined by its pivots, makes no
   pairs among its members.  Of its members that are still apart, sketches of the whole sets discard the pairs that
   differ too much.  No pair that could link two components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.arrays import pack, unpack
from marketlens.llm.components import components, extended
from marketlens.llm.shingles import shingle_sets
from marketlens.storage import Scratch

#: Pivots of a column before components are formed.
PIVOTS = 4
#: Turns in which the minority meets drawn pivots before it meets all others, and classes of columns with draws of their own.
TURNS = 1
CLASSES = 16
#: So many n-grams before its own does an entry of a column show; a pair that shares one of them was met in that column.
SHOWN = 16
#: Bits of a set's sketch: how many of its n-grams fall on each bit, modulo 2.
SKETCH_BITS = 1024
#: N-grams of a column block, about, and of the nodes that one node meets at a time.
BLOCK_GRAMS = 1_000_000
MEET_GRAMS = 1 << 16
_U = np.uint64
_HALF = _U(32)
CHUNK = "doc_id long, n long, sig binary, chunk long, block int, grams binary, counts binary, texts binary"


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _needed(n: int, percent: int) -> int:
    """The first so many n-grams of a set of n suffice to find every partner."""
    return n - -(-percent * n // 100) + 1


def _overlap_bound(percent: int, n: str = "n", m: str = "m") -> Column:
    """The least overlap of sets of ``n`` and ``m`` that links them."""
    return F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / F.lit(100 + percent))


def _sketch(grams: np.ndarray) -> np.ndarray:
    """The parity of the number of n-grams on each bit, as 64-bit integers.  Bits in which two sketches differ are no more than n-grams in one of the sets only."""
    odd = np.bincount((grams & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(percent: int) -> Column:
    """Whether two sketches allow the overlap that links their sets."""
    differing = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_m")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("sketch_m")[0])))
    return differing <= F.col("n") + F.col("m") - 2 * _overlap_bound(percent)


def _places(grams: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each n-gram, ascending with it, and its place in the block as 32 bits."""
    low = (grams & _U(0xFFFFFFFF)) * _U(blocks)
    block = ((grams >> _HALF) * _U(blocks) + (low >> _HALF)) >> _HALF
    return block.astype(np.int64), ((grams * _U(blocks)) >> _HALF).astype(np.uint32)


def _write_texts(texts: list[bytes]) -> bytes:
    sizes = np.array([len(texts), *map(len, texts)], dtype="<i8")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(texts))


def _read_texts(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = (8 * (n + 1) + np.cumsum(np.frombuffer(raw, "<i8", n, 8))).tolist()
    starts = [8 * (n + 1), *ends[:-1]]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends)]


def _chunks(texts: DataFrame, width: int, blocks: int, chunk_bytes: int) -> DataFrame:
    """A row for each text (``block`` -2), for each chunk's different texts (-1), and for a chunk's n-grams in each column block."""

    def close(chunk: int, ids: list, held: list) -> pd.DataFrame:
        sets = shingle_sets(held, width)
        sigs = [_digest(s) for s in sets]
        first = {sig: i for i, sig in reversed(list(enumerate(sigs))) if len(sets[i])}
        out = [(i, len(s), sig, chunk, -2, None, None, None) for i, s, sig in zip(ids, sets, sigs)]
        if first:
            kept = sorted(first.values())
            grams, counts = np.unique(np.concatenate([sets[i] for i in kept]), return_counts=True)
            block, place = _places(grams, blocks)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
            out.append((None, 0, None, chunk, -1, None, None, _write_texts([held[i].encode("utf-8", "surrogatepass") for i in kept])))
            out += [(None, 0, None, chunk, int(block[a]), pack(place[a:b], ascending=True), pack(counts[a:b].astype(np.uint32)), None) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["doc_id", "n", "sig", "chunk", "block", "grams", "counts", "texts"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list = []
        for pdf in batches:
            for i, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids.append(None if i is None or i != i else int(i))
                held.append(text)
                size += len(text) if text else 0
                if size >= chunk_bytes:
                    yield close(chunk, ids, held)
                    chunk, size, ids, held = chunk + 1, 0, [], []
        if held:
            yield close(chunk, ids, held)

    return texts.mapInPandas(run, CHUNK)


def _ranks(rows: DataFrame) -> DataFrame:
    """``chunk, block, ranks``: for each of a chunk's n-grams in a block, four times the logarithm of its number of sets; 0 if it is alone."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [unpack(g, np.uint32, ascending=True) for g in pdf["grams"]]
        places = np.concatenate(own)
        order = np.argsort(places, kind="stable")
        places = places[order]
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        sets = np.add.reduceat(np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]])[order].astype(np.int64), first)
        ranks, places = np.minimum(255, np.floor(4 * np.log2(sets))).astype(np.uint8), places[first]
        return pd.DataFrame({"chunk": pdf["chunk"], "block": pdf["block"], "ranks": [pack(ranks[np.searchsorted(places, g)]) for g in own]})

    return rows.groupBy("block").applyInPandas(rank, "chunk long, block int, ranks binary")


def _nodes(texts: DataFrame, ranks: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each of a chunk's sets that has an n-gram of another in its prefix: those n-grams, from rare to frequent, and
    their places in the order; the prefix's length and where it ends in the order; the whole set and its sketch."""
    columns = ["sig", "n", "p", "last_rank", "last_gram", "grams", "places", "sketch", "whole"]

    def run(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            sets = shingle_sets(_read_texts(own["texts"].iloc[0]), width)
            grams = np.unique(np.concatenate(sets))
            ranks = np.concatenate([unpack(r, np.uint8) for r in known.sort_values("block")["ranks"]])
            for s in sets:
                r = ranks[np.searchsorted(grams, s)]
                # n-grams ascend in a set, so ties of the stable sort go by hash.
                order = np.argsort(r, kind="stable")[: _needed(len(s), percent)]
                shared = np.flatnonzero(r[order])
                if len(shared):
                    p = s[order]
                    out.append((_digest(s), len(s), len(p), int(r[order[-1]]), int(p[-1]) - (1 << 63), p[shared].view(np.int64), shared.astype(np.int32), _sketch(s), s.tobytes()))
        return pd.DataFrame(out, columns=columns)

    schema = "sig binary, n int, p int, last_rank int, last_gram long, grams array<long>, places array<int>, sketch array<long>, whole binary"
    return texts.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInPandas(run, schema)


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """The links ``a, b`` among rows of ``hub, slot, node, whole``: a hub's own row (null ``node``), then the nodes that it meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own, nodes, sets, held = None, None, [], [], 0

        def product() -> pd.DataFrame:
            sizes = np.array([len(s) for s in sets])
            hit = np.isin(np.concatenate(sets), own, assume_unique=False)
            shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            linked = 100 * shared >= percent * (sizes + len(own) - shared)
            b = np.array(nodes, dtype=np.int64)[linked]
            return pd.DataFrame({"a": np.minimum(hub, b), "b": np.maximum(hub, b)})

        for pdf in batches:
            for h, node, whole in zip(pdf["hub"].tolist(), pdf["node"].tolist(), pdf["whole"].tolist()):
                s = np.frombuffer(whole, dtype=np.uint64)
                alone = node is None or node != node
                if sets and (alone or held + len(s) > MEET_GRAMS):
                    yield product()
                    nodes, sets, held = [], [], 0
                if alone:
                    hub, own = h, s
                else:
                    nodes.append(int(node))
                    sets.append(s)
                    held += len(s)
        if sets:
            yield product()

    return rows.mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole sets reach the threshold."""
    # Overlap counted over both prefixes.  The prefix that ends first in the order has no further partner in the other set,
    # so what is behind it bounds the rest.
    of = lambda c: nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "p", "last_rank", "last_gram", "grams")])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    a_first = F.struct("last_rank_a", "last_gram_a") <= F.struct("last_rank_b", "last_gram_b")
    behind = F.when(a_first, F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
    enough = F.size(F.array_intersect("grams_a", "grams_b")) + behind >= _overlap_bound(percent, "n_a", "n_b")
    pairs = scratch.table(both.where(enough).select("a", "b", "n_a", "n_b"), "pairs")
    # The node with more pairs is the hub that meets the others; slots share out what a hub meets by its n-grams.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("n_b").alias("met")), F.struct(F.col("b").alias("node"), F.col("n_a").alias("met")))).alias("e"))
    load = scratch.table(ends.groupBy("e.node").agg(F.count("*").alias("times"), F.sum("e.met").alias("met")), "load")
    of = lambda c: load.select(F.col("node").alias(c), F.struct("times", F.col("node").alias("x")).alias(f"t_{c}"), F.col("met").alias(f"met_{c}"))
    ranked = pairs.join(of("a"), "a").join(of("b"), "b")
    a_leads = F.col("t_a") > F.col("t_b")
    ranked = ranked.select(F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(a_leads, F.col("met_a")).otherwise(F.col("met_b")).alias("met"))
    ranked = scratch.table(ranked.select("hub", "node", F.pmod(F.xxhash64("node"), F.floor(F.col("met") / MEET_GRAMS) + 1).alias("slot")), "met")
    others = ranked.join(sets, "node").select("hub", "slot", "node", "whole")
    hubs = ranked.select("hub", "slot").distinct().join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "slot", F.lit(None).cast("long").alias("node"), "whole")
    rows = hubs.unionByName(others).repartition("hub", "slot").sortWithinPartitions("hub", "slot", F.col("node").asc_nulls_first())
    return scratch.table(_meet(rows.select("hub", "node", "whole"), percent), "links")


def _pairs(left: DataFrame, right: DataFrame, percent: int, apart: Column) -> DataFrame:
    """Distinct pairs of nodes that share a column and pass the size and position bounds."""
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (
        1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("qos") - 1) >= _overlap_bound(percent)
    )
    both = left.join(right, "gram").where(fits & apart)
    return both.select(F.least("node", "mode").alias("a"), F.greatest("node", "mode").alias("b")).distinct()


def _drawn(posts: DataFrame, *columns: str, turn: int) -> DataFrame:
    """``PIVOTS`` rows of each column, drawn by hash (after turn 0, another draw for each of ``CLASSES`` classes of columns); fewer where one is drawn twice."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.pmod("gram", F.lit(CLASSES if turn else 1)), F.lit(turn * PIVOTS + k)).alias("h"), *columns)).alias(f"pivot{k}") for k in range(PIVOTS)]
    rows = posts.groupBy("gram").agg(*drawn).select("gram", F.explode(F.array(*[f"pivot{k}" for k in range(PIVOTS)])).alias("p"))
    return rows.select("gram", *[f"p.{c}" for c in columns]).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, chunk_bytes: int = 8_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``width``-word
    shingles; a component's id is the smallest id in it.  Null, empty and blank texts have an empty set and
    link with nothing; a text with fewer than ``width`` words has its whole word sequence as one shingle.
    Rows with equal sets are linked whatever their number; rows with a repeated id give repeated rows.
    Rows with a null id keep a null id; their component's id is the smallest id that is not null, if any.
    Other columns are ignored.  Shingles are compared as 64-bit hashes and equal sets as 128-bit digests.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    # A text has no more n-grams than half its bytes, and about a sixth of them in prose.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(16, size // (6 * BLOCK_GRAMS))
    first = scratch.table(_chunks(texts, width, blocks, chunk_bytes), "chunks")
    sizes = scratch.table(first.where("block = -2").select("doc_id", "n", "sig"), "sizes")
    ranks = _ranks(first.where("block >= 0").select("chunk", "block", "grams", "counts"))
    raw = _nodes(first.where("block = -1").select("chunk", "texts"), ranks, width, percent)
    raw = scratch.table(raw.withColumn("node", F.monotonically_increasing_id()), "sets")
    scratch.drop(first)
    sets = raw.select("node", "whole")
    nodes = raw.join(raw.groupBy("sig").agg(F.min("node").alias("node")).select("node"), "node", "left_semi").drop("whole")
    nodes = scratch.table(nodes, "nodes")

    posts = nodes.select("node", "n", F.explode(F.arrays_zip("grams", "places")).alias("p")).select(F.col("p.grams").alias("gram"), "node", "n", F.col("p.places").alias("pos"))
    columns = scratch.table(posts.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1").select("gram"), "columns")
    posts = scratch.table(posts.join(columns, "gram", "left_semi"), "posts")
    pivots = scratch.table(_drawn(posts, "node", "n", "pos", turn=0).select("gram", F.col("node").alias("mode"), F.col("n").alias("m"), F.col("pos").alias("qos")), "pivots")
    tried = scratch.table(_pairs(posts, pivots, percent, F.col("node") != F.col("mode")), "pivot-pairs")
    roots = components(_verified(tried, nodes, sets, scratch, percent), scratch)
    for turn in range(1, TURNS + 2):
        labelled = scratch.table(posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
        by_root = labelled.groupBy("gram", "root").agg(F.count("*").alias("members"))
        main = by_root.groupBy("gram").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
        mixed = labelled.join(scratch.table(main.select("gram", "main"), "main"), "gram")
        apart = (F.col("root") != F.col("toot")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("mode")))
        if turn > TURNS:
            mixed = mixed.join(nodes.select("node", "grams", "sketch"), "node")
            at = F.array_position("grams", F.col("gram")).cast("int")
            before = F.slice("grams", F.greatest(F.lit(1), at - SHOWN), F.least(F.lit(SHOWN), at - 1))
            mixed = scratch.table(mixed.select("gram", "node", "n", "pos", "root", "main", "sketch", before.alias("before")), "mixed")
            others = mixed.where("root != main").withColumnsRenamed({"sketch": "sketch_m", "before": "before_m"})
            apart = apart & ~F.arrays_overlap("before", "before_m") & _near(percent)
        else:
            mixed = scratch.table(mixed, "mixed")
            others = _drawn(mixed.where("root = main"), "node", "n", "pos", "root", turn=turn)
            apart = F.col("root") != F.col("toot")
        others = others.drop("main").withColumnsRenamed({"node": "mode", "root": "toot", "n": "m", "pos": "qos"})
        left = scratch.table(_pairs(mixed, others, percent, apart).join(tried, ["a", "b"], "left_anti"), "cross-pairs")
        tried = tried.unionByName(left)
        if left.limit(1).count():
            more = _verified(left, nodes, sets, scratch, percent)
            if more.limit(1).count():
                roots = extended(roots, more, scratch)
    roots = nodes.select("node", "sig").join(roots, "node").select("sig", "root")

    node = sizes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    node = scratch.table(node.join(roots, "sig", "left"), "classes")
    ids = node.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = scratch.table(node.join(ids, "root", "left").select("sig", F.coalesce("component_id", "least").alias("component_id")), "ids")
    scratch.keep(sizes, ids)
    out = sizes.join(ids, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
