"""Documents tokenised, cut and packed into sequences of a fixed capacity.

The histogram of piece lengths (at most `capacity` cells) is all that the plan needs. Patterns of
two or three lengths that fill a sequence exactly are fitted to it by non-negative least squares;
repeat counts are rounded without exceeding the pieces there are, and what is left is packed
best-fit in decreasing length, in bulk by length. Pieces then take the places planned for their
length by rank, so no piece is moved for it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .shared import bounded_batches

CAPACITY, END_ID = 1024, 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"  # the same vocabulary in two forms
SPECIAL = "<|endoftext|>"
RANK_ROWS = 50_000  # pieces ranked together

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[tuple[str, str], tuple] = {}


def encoders(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> tuple:
    """(fast, full): both give the same ids; only the full one knows special tokens in texts."""
    if (vocabulary, ranks) not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        _loaded[vocabulary, ranks] = fast, lambda: Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return _loaded[vocabulary, ranks]


def token_ids(text: str | None, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[int]:
    fast, full = encoders(vocabulary, ranks)
    if not text:
        return []
    if SPECIAL in text:
        return full().encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; null texts are empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text, vocabulary, ranks), end_id], dtype="<u4")
                rows += [(doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())) for k, (start, length) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def full_patterns(counts: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, that sum to the capacity and whose lengths occur.

    All pairs (c = 0), and the triples with b or c on a grid of sixteenths: fewer patterns get
    higher repeat counts, which lose less when rounded.
    """
    capacity = len(counts) - 1
    grid = max(1, capacity // 16)
    a, b = np.meshgrid(np.arange(1, capacity), np.arange(1, capacity), indexing="ij")
    c = capacity - a - b
    fits = (a >= b) & (b >= c) & (c >= 0) & ((b % grid == 0) | (c % grid == 0))
    found = np.stack([a[fits], b[fits], c[fits]], axis=1)
    there = counts > 0
    there[0] = True
    found = found[there[found].all(axis=1)]
    return found[np.lexsort((-found[:, 1], -found[:, 0]))]


def repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts, least squares against the histogram (accelerated projected gradient).

    Errors weigh by length: long pieces left over would cost a sequence each, short ones still fit
    somewhere.
    """
    size = len(counts)
    weight = np.arange(size) / size
    cover = lambda x: sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))
    pull = lambda r: (weight * r)[patterns].sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(20):
        v = pull(cover(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        step = np.maximum(0, y - pull(cover(y) - counts) / norm)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = step, step + (last - 1) / t * (step - x)
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats, the rounding error carried on from pattern to pattern, and the pieces left."""
    whole = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)
    left, plan = counts.copy(), []
    for row, want in zip(patterns[whole > 0], whole[whole > 0], strict=True):
        lengths = tuple(int(v) for v in row if v)
        times = min(int(want), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            plan.append((lengths, times))
            for v in lengths:
                left[v] -= times
    return plan, left


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are filled together."""
    capacity = len(left) - 1
    by_space: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        todo, space = int(left[length]), length
        while todo and space <= capacity:
            if not by_space[space]:
                space += 1
                continue
            pattern, n = by_space[space].pop()
            used = min(n, todo)
            if n > used:
                by_space[space].append((pattern, n - used))
            by_space[space - length].append((pattern + (length,), used))
            todo -= used
            space = length  # a sequence just filled may have come to fit best
        per = capacity // length
        for size, n in ((per, todo // per), (todo % per, 1)):
            if size and n:
                by_space[capacity - size * length].append(((length,) * size, n))
    return [entry for entries in by_space for entry in entries]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) for all pieces counted; its size is bounded by the capacity alone."""
    done = [((len(counts) - 1,), int(counts[-1]))] if counts[-1] else []
    rest = counts.copy()
    rest[0] = rest[-1] = 0
    patterns = full_patterns(rest)
    filled, left = rounded(patterns, repeats(patterns, rest), rest) if len(patterns) else ([], rest)
    return done + filled + best_fit(left)


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of it in a sequence, offset), by length and rank."""
    taken, sequence, rows = [0] * (capacity + 1), 0, []
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            many = lengths.count(length)
            rows.append((length, taken[length], sequence, many, offset))
            taken[length] += times * many
            offset += length * many
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(cut_up: DataFrame, total: int) -> DataFrame:
    """With rank from 0 among the pieces of one length, counted in parts so that no length meets in one task."""
    parts = max(64, total // RANK_ROWS)
    rows = cut_up.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(sums.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    An empty or null text is its end id alone; rows that repeat are packed each; an empty table
    gives no rows. Other columns than doc_id and text are not read.
    """
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, capacity, end_id, vocabulary, ranks))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut_up.groupBy("length").count().collect():  # one row a length
        counts[length] = n
    table = spark.sparkContext.broadcast(places(plan(counts), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 40 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            if not len(rank):
                continue
            row = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            kept = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ordered = ranked(cut_up, int(counts.sum())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ordered.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
