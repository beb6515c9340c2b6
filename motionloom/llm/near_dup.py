"""Near-duplicate documents by MinHash, confirmed on whole shingle sets.

1. Every text becomes its set of word shingles and the minima of PERMUTATIONS universal hashes;
   documents of equal sets are one representative (the lowest doc_id).
2. Signatures are cut into bands; representatives that agree on a band meet in its bucket. Inside a
   bucket whole signatures are compared, in blocks, and a maximum spanning forest of the pairs
   that may reach the similarity is emitted: one link a member, never all pairs.
3. The forests' components are candidate clusters. Every member's text goes to its cluster once a
   block; pairs are taken from the most alike down, pairs already linked are passed over, and the
   others are confirmed on the full sets.
4. Components of the confirmed links and of the copies are the result.

A pair at the similarity 0.8 shares no band with probability below 1e-7, and falls below the
signature cut (five standard deviations) with about the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .lm_score import Words, grams
from .shared import bounded_batches, small_side

PERMUTATIONS, BAND_ROWS = 128, 4
SIMILARITY = 80  # percent
SHINGLE = 5
BLOCK = 512  # members of one side of a block
CUT_SIGMAS = 5.0
SEED = 20_240_601
BATCH_ROWS = 256


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle."""
    return np.unique(grams(words, min(k, len(words)))[-1]) if len(words) else words


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of h(x) = (a x + b mod 2^64) / 2^32, a universal family."""
    random = np.random.default_rng(SEED)
    a, b = (random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) for _ in range(2))
    return a[:, None] | np.uint64(1), b[:, None]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(PERMUTATIONS, 2**32 - 1, dtype=np.uint64)
    for k in range(0, len(found), 1024):
        least = np.minimum(least, ((a * found[None, k : k + 1024] + b) >> np.uint64(32)).min(axis=1))
    return least.astype("<u4")


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id, minima of each row; texts without words have no set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes()
        make = Words()
        for batch in batches:
            sizes, ids, minima = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(make.hashes(text), k)
                sizes.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                minima.append(signature(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(minima, pa.binary())], names=["doc_id", "n_shingles", "set_id", "minima"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, minima binary")


def estimate_cut(similarity: int) -> int:
    """Least number of equal minima that a pair of this similarity is expected to have."""
    p = similarity / 100
    return int(PERMUTATIONS * p - CUT_SIGMAS * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def in_blocks(rows: DataFrame, group: str, members: str, node: str) -> DataFrame:
    """Rows copied to the block pairs (low, high) of their group, with their own `part`.

    A group of up to BLOCK members is one block; a larger one is dealt by hash, and each pair of
    its parts is a block pair, so that every two members meet once.
    """
    parts = F.ceil(F.col(members) / BLOCK).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(node, group), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    copied = dealt.withColumn("other", other)
    copied = copied.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", members)
    return copied.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", node)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of one key (the first `keys` columns) at a time, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        edges = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(columns[:, start].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def likely_pairs(minima: list[bytes], part: np.ndarray, across: bool, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs with at least `cut` equal minima, most alike first.

    `across`: only pairs of different parts.
    """
    table = np.frombuffer(b"".join(minima), dtype="<u4").reshape(len(minima), -1).astype(np.uint8)
    left, right, equal = [], [], []
    for i in range(len(table) - 1):
        same = (table[i + 1 :] == table[i]).sum(axis=1)
        keep = same >= cut
        if across:
            keep &= part[i + 1 :] != part[i]
        at = np.flatnonzero(keep)
        if len(at):
            left.append(np.full(len(at), i))
            right.append(at + i + 1)
            equal.append(same[at])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(-np.concatenate(equal), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def forests(members: DataFrame, cut: int) -> DataFrame:
    """u, v: spanning links of the likely pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in runs(batches, 3):
            nodes, part = group.column("node").to_numpy(), group.column("part").to_numpy()
            if len(nodes) < 2:
                continue
            linked = Groups(len(nodes))
            for i, j in zip(*(x.tolist() for x in likely_pairs(group.column("minima").to_pylist(), part, group.column("low")[0] != group.column("high")[0], cut)), strict=True):
                if linked.join(i, j) and nodes[i] != nodes[j]:
                    out.append((int(nodes[i]), int(nodes[j])))
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    blocks = in_blocks(members, "bucket", "n", "node").select("bucket", "low", "high", "part", "node", "minima")
    return blocks.mapInArrow(run, "u long, v long")


def confirmed(members: DataFrame, k: int, similarity: int, cut: int) -> DataFrame:
    """u, v: spanning links, inside each block of a cluster, that full shingle sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Words()
        for group in runs(batches, 3):
            nodes, part = group.column("node").to_numpy(), group.column("part").to_numpy()
            if len(nodes) < 2:
                continue
            sets = [shingles(make.hashes(t.as_py()), k) for t in group.column("text")]
            linked, out = Groups(len(nodes)), []
            for i, j in zip(*(x.tolist() for x in likely_pairs(group.column("minima").to_pylist(), part, group.column("low")[0] != group.column("high")[0], cut)), strict=True):
                a, b = sets[i], sets[j]
                if linked.root(i) == linked.root(j) or 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                both = len(a) + len(b) - len(np.union1d(a, b))
                if 100 * both >= similarity * (len(a) + len(b) - both):
                    linked.join(i, j)
                    if nodes[i] != nodes[j]:
                        out.append((int(nodes[i]), int(nodes[j])))
            yield _links(out)

    blocks = in_blocks(members, "cluster", "n", "node").select("cluster", "low", "high", "part", "node", "minima", "text")
    return blocks.mapInArrow(run, "u long, v long")


def likely_links(reps: DataFrame, cut: int) -> DataFrame:
    """u, v: links that join all representatives which share a band and may be similar enough."""
    bands = PERMUTATIONS // BAND_ROWS
    pieces = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substr("minima", b * (4 * BAND_ROWS) + 1, F.lit(4 * BAND_ROWS))))
    filed = reps.select("node", F.explode(pieces).alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("u"), F.max("node").alias("v")).filter("n > 1 AND u <> v")
    shared = stored(shared)
    sides = reps.select("node", "minima")
    twos = shared.filter("n = 2").select("u", "v").distinct()
    twos = twos.join(sides.toDF("u", "a"), "u").join(sides.toDF("v", "b"), "v")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(batch.num_rows, PERMUTATIONS) for k in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    pairs = twos.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")
    more = filed.join(shared.filter("n > 2").select("bucket", "n"), "bucket").join(sides, "node")
    return pairs.unionByName(forests(more, cut)).distinct()


def classes(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links of at least `similarity` percent reach. Texts that
    are null or without words link with nothing. Rows of one doc_id are one node; a null doc_id
    is no node, has a null component and is kept. Other columns are not read.
    """
    bounded_batches(docs.sparkSession, BATCH_ROWS)
    cut = estimate_cut(similarity)
    sketched = stored(sketch(docs, k))
    sets = sketched.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    least = sets.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    joined = sets.join(least, "set_id")
    reps = stored(joined.filter("doc_id = node").select("node", "minima").distinct())
    copies = joined.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    clusters = stored(components(likely_links(reps, cut)))
    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = clusters.join(counts, "component").select("node", F.col("component").alias("cluster"), "n")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").filter("text IS NOT NULL").join(small_side(placed), "node").distinct()
    members = texts.join(reps, "node")
    links = confirmed(members, k, similarity, cut)
    found = components(links.unionByName(copies))
    out = sketched.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component; all columns stay."""
    gone = classes(docs, k, similarity).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
