"""SimHash classes by covering locality-sensitive hashing: no pair within the radius is missed.

Every bit position has a non-zero vector of RADIUS + 1 bits. A table is a non-zero vector v; it
keeps the bit positions whose vectors have an odd product with v. Up to RADIUS positions always
leave a v that is orthogonal to all of theirs, so two fingerprints that differ there agree on all
bits that this table keeps, and meet in its bucket.

Equal fingerprints are one node. A bucket of more than BLOCK nodes is covered again by a second
family of tables, and a third: pairs in it differ in at most RADIUS of the bits not yet kept, so the
guarantee holds again, and after LEVELS families so few bits are free that a bucket cannot hold more
than 2^FREE_BITS nodes, whatever the data. Buckets give spanning links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .shared import small_batches, word_pieces

BITS, RADIUS, SHINGLE = 64, 3, 3
HASH_SEED = 42
TABLES = 2 ** (RADIUS + 1) - 1
BLOCK = 512  # nodes of a bucket that is not covered again
LEVELS = 3
#: Bits that LEVELS tables, one of each family, leave free at most (see `free_bits`).
FREE_BITS = 13
FAMILY_SEED = 20


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of the SHINGLE-word shingles, repeats included; 0 without words."""
    ones, total, tail, first = np.zeros(BITS, dtype=np.int64), 0, [], True
    make = xxhash.xxh64_intdigest
    for words in word_pieces((text or "").encode("utf-8", "replace").lower()):
        words = tail + words
        if len(words) < SHINGLE:
            tail = words
            continue
        first, tail = False, words[1 - SHINGLE :]
        body = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        found = [make(body[a : b - 1], HASH_SEED) for a, b in zip([0, *ends[:-SHINGLE]], ends[SHINGLE - 1 :], strict=True)]
        ones += bit_counts(found)
        total += len(found)
    if first and tail:
        ones, total = bit_counts([make(b" ".join(tail), HASH_SEED)]), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long")


def family(level: int) -> list[int]:
    """Masks of the TABLES tables of a level: the vectors 1 .. TABLES in turn, dealt anew for each level."""
    vectors = 1 + np.arange(BITS) % TABLES
    if level:
        vectors = np.random.default_rng(FAMILY_SEED + level).permutation(vectors)
    return [sum(1 << k for k, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2) for v in range(1, TABLES + 1)]


def free_bits() -> int:
    """Most bits that a table of each family together leave free."""
    kept = {0}
    for level in range(LEVELS):
        kept = {have | mask for have in kept for mask in family(level)}
    return BITS - min(mask.bit_count() for mask in kept)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def spanning(found: np.ndarray, nodes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join the nodes within the radius of each other, one for each node reached."""
    rest, u, v = np.arange(len(found)), [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            near = np.bitwise_count(found[rest] ^ found[k]) <= RADIUS
            if near.any():
                hit, rest = rest[near], rest[~near]
                u.append(np.full(len(hit), nodes[k]))
                v.append(nodes[hit])
                queue += hit.tolist()
    return u, v


def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v from buckets (members: print, node)."""
    for batch in batches:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        members = batch.column(0)
        found, nodes = (c.to_numpy() for c in members.flatten().flatten())
        found = found.view(np.uint64)
        edges = np.concatenate(([0], np.cumsum(np.asarray(members.value_lengths()))))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            u, v = spanning(found[a:b], nodes[a:b])
            us += u
            vs += v
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """u, v of nodes (node, print) that join all pairs within the radius."""
    rows = nodes.select("node", "print", F.lit(0).alias("path"), F.lit(0).cast("long").alias("kept"))
    out = None
    for level in range(LEVELS):
        masks = F.array(*[F.lit(_signed(mask)).cast("long") for mask in family(level)])
        filed = rows.select("node", "print", "path", "kept", F.posexplode(masks).alias("table", "mask"))
        kept = F.col("kept").bitwiseOR(F.col("mask"))
        filed = filed.select("node", "print", (F.col("path") * (TABLES + 1) + F.col("table") + 1).alias("path"), kept.alias("kept"), F.col("print").bitwiseAND(kept).alias("bucket"))
        sizes = stored(filed.groupBy("path", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        last = level == LEVELS - 1
        small = filed.join(sizes if last else sizes.filter(F.col("n") <= BLOCK), ["path", "bucket"])
        groups = small.groupBy("path", "bucket").agg(F.collect_list(F.struct("print", "node")).alias("members"))
        found = groups.select("members").mapInArrow(link, "u long, v long")
        out = found if out is None else out.unionByName(found)
        large = sizes.filter(F.col("n") > BLOCK).select("path", "bucket")
        if last or large.isEmpty():
            return out
        rows = stored(filed.join(large, ["path", "bucket"]).select("node", "print", "path", "kept"))


def classes(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints that differ in at most RADIUS bits are linked; component_id is the least doc_id
    that links reach. Texts without words, null ones too, have fingerprint zero and link like any
    other. A row without doc_id takes the component of its fingerprint, null if no document has it.
    Rows that repeat are one node; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        marked = stored(prints(docs))
    nodes = stored(marked.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("node")).select("node", "print"))
    # One document may have several texts and so be the least id of several fingerprints; these are one component.
    with small_batches(docs.sparkSession, 100):
        found = components(links(nodes).unionByName(same_document(marked, nodes)))
    placed = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(placed, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def same_document(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: links between the fingerprints of rows that share a doc_id."""
    several = marked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("print") < F.max("print")).alias("differ")).filter("differ").select("doc_id")
    owned = marked.join(several, "doc_id", "left_semi").distinct().join(nodes, "print")
    return owned.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
