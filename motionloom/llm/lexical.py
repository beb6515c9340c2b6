"""The best documents for each item by exact integer scores, found by bounds instead of scoring all.

One pass over the texts keeps, for each document, its number of terms and the frequencies of the
terms that items ask for. A search task then takes its documents in shards. A shard has a posting
list per term, in document order, with a sparse table of the positions of range maxima. An item's
search starts with the interval of all documents of the shard; the sum of the terms' range maxima
bounds every score inside. Intervals are taken best bound first, some hundred at a time: each is
split at the document of greatest impact of its strongest term, that document is scored, and the
two rests are bounded anew. The search ends when no bound beats the last of the best so far, which
are carried from shard to shard of a task. Tasks send their best to one ranking per item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .shared import small_batches, word_pieces

TOP = 10
BLOCK_TERMS = 1_000_000  # terms of the items that one pass serves, and so of the dictionary sent to the tasks
SHARD_POSTINGS = 1 << 21
ROUND = 256  # intervals taken at a time

#: Separators become blanks, A-Z lower case; bytes from 0x80 on are parts of terms.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
BEST = "item int, doc_id long, score long"


def count_terms(text: str | None, known: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each known one occurs."""
    n, found = 0, Counter()
    for words in word_pieces((text or "").encode("utf-8", "replace").translate(FOLD)):
        n += len(words)
        found.update(map(known.get, words))
    found.pop(None, None)
    return n, found


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts of every document that has a term at all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = count_terms(text.as_py(), known)
                if n:
                    ids.append(doc_id)
                    sizes.append(n)
                    terms.append(list(found.keys()))
                    counts.append(list(found.values()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, sizes, terms, counts), kinds, strict=True)], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTINGS)


class Shard:
    """Documents in the order of their ids, with the posting list of every term."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        """`known`: whether the id is not null; `sizes`: postings of each document; terms and counts lie flat."""
        order = np.lexsort((ids, known))
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.known, self.size = ids[order], known[order], len(ids)
        of = np.repeat(place, sizes)
        m = 100 - 75 + (75 * lengths * n_docs) // n_terms
        counts = counts.astype(np.int64)
        impact = (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, sizes))
        by_doc = np.argsort(of, kind="stable")
        self.doc_terms, self.doc_impacts = terms[by_doc], impact[by_doc]
        self.doc_edges = np.concatenate(([0], np.cumsum(sizes[order])))
        by_term = np.lexsort((of, terms))
        self.places, self.impacts = of[by_term], impact[by_term]
        self.terms, starts = np.unique(terms[by_term], return_index=True)
        self.edges = np.append(starts, len(terms))
        self.tables: dict[int, list[np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None:
        """Documents, impacts, and the sparse table: level k has where the maximum of 2^k entries from each on lies."""
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return None
        a, b = self.edges[k], self.edges[k + 1]
        places, impacts = self.places[a:b], self.impacts[a:b]
        if term not in self.tables:
            levels, width = [np.arange(b - a, dtype=np.int32)], 1
            while 2 * width <= b - a:
                left, right = levels[-1][:-width], levels[-1][width:]
                levels.append(np.where(impacts[right] > impacts[left], right, left))
                width *= 2
            self.tables[term] = levels
        return places, impacts, self.tables[term]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores under a weight for each term of the dictionary."""
        starts, sizes = self.doc_edges[docs], self.doc_edges[docs + 1] - self.doc_edges[docs]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        worth = np.concatenate(([0], np.cumsum(weights[self.doc_terms[at]] * self.doc_impacts[at])))
        return worth[first + sizes] - worth[first]


def bounds(lists: list, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval [low, high): the sum of the terms' maxima, and the document of the greatest one."""
    total = np.zeros(len(low), dtype=np.int64)
    greatest, split = np.zeros(len(low), dtype=np.int64), low.copy()
    for weight, (places, impacts, levels) in lists:
        a, b = np.searchsorted(places, low), np.searchsorted(places, high)
        some = np.flatnonzero(b > a)
        if not len(some):
            continue
        a, b = a[some], b[some]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        best = np.empty(len(some), dtype=np.int64)
        for k in np.unique(level):
            of = level == k
            left, right = levels[k][a[of]], levels[k][b[of] - (1 << int(k))]
            best[of] = np.where(impacts[right] > impacts[left], right, left)
        worth = weight * impacts[best]
        total[some] += worth
        more = worth > greatest[some]
        greatest[some[more]] = worth[more]
        split[some[more]] = places[best[more]]
    return total, split


class Ranking:
    """The best documents so far of one item: by score, then null ids, then lower ids."""

    def __init__(self, top: int):
        self.top = top
        self.rows: list[tuple[int, bool, int]] = []  # (-score, id is known, id)

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        keep = scores > 0
        if len(self.rows) == self.top:
            keep &= scores >= -self.rows[-1][0]
        if keep.any():
            fresh = zip((-scores[keep]).tolist(), known[keep].tolist(), ids[keep].tolist(), strict=True)
            self.rows = sorted([*self.rows, *fresh])[: self.top]

    def may_enter(self, bound: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score, and of this id or a later one, could be among the best."""
        if len(self.rows) < self.top:
            return bound > 0
        worst, worst_known, worst_id = self.rows[-1]
        earlier = (known < worst_known) | ((known == worst_known) & (ids < worst_id))
        return (bound > -worst) | ((bound == -worst) & (bound > 0) & earlier)


def search(shard: Shard, asked: list[tuple[int, int]], weights: np.ndarray, best: Ranking) -> int:
    """Brings `best` up to date with a shard for one item; returns how many documents were scored."""
    lists = [(weight, found) for term, weight in asked if weight > 0 and (found := shard.list_of(term)) is not None]
    if not lists:
        return 0
    low, high, scored = np.array([0]), np.array([shard.size]), 0
    bound, split = bounds(lists, low, high)
    while True:
        keep = best.may_enter(bound, shard.known[low], shard.ids[low])
        low, high, bound, split = low[keep], high[keep], bound[keep], split[keep]
        if not len(low):
            return scored
        first = np.lexsort((low, -bound))
        now, later = first[:ROUND], first[ROUND:]
        at = split[now]
        scored += len(at)
        best.add(shard.scores(at, weights), shard.known[at], shard.ids[at])
        new_low, new_high = np.concatenate((low[now], at + 1)), np.concatenate((at, high[now]))
        some = new_low < new_high
        new_low, new_high = new_low[some], new_high[some]
        new_bound, new_split = bounds(lists, new_low, new_high)
        low, high = np.concatenate((low[later], new_low)), np.concatenate((high[later], new_high))
        bound, split = np.concatenate((bound[later], new_bound)), np.concatenate((split[later], new_split))


def searcher(items: list[dict[int, int]], weight_of: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Ranking(top) for _ in items]
        weights = np.zeros(len(weight_of) + 1, dtype=np.int64)
        held, size = [], 0

        def settle() -> None:
            table = pa.Table.from_batches(held)
            terms = table.column("terms").combine_chunks()
            ids = table.column("doc_id")
            sizes = np.diff(np.concatenate([[0], np.cumsum(np.asarray(terms.value_lengths().fill_null(0), dtype=np.int64))]))
            shard = Shard(
                ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), table.column("n").to_numpy(), sizes,
                np.asarray(terms.flatten()), np.asarray(table.column("counts").combine_chunks().flatten()), n_docs, n_terms,
            )
            for ranking, asked in zip(best, items, strict=True):
                worth = [(term, int(weight_of[term]) * times) for term, times in asked.items()]
                for term, weight in worth:
                    weights[term] = weight
                search(shard, worth, weights, ranking)
                for term, _ in worth:
                    weights[term] = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
            if size >= SHARD_POSTINGS:
                settle()
                held, size = [], 0
        if held:
            settle()
        rows = [(k, doc if known else None, -score) for k, ranking in enumerate(best) for score, known, doc in ranking.rows]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return run


def best_of_block(spark: SparkSession, docs: DataFrame, rows: list, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block."""
    known: dict[bytes, int] = {}
    asked: list[dict[int, int]] = []
    for row in rows:
        counts: dict[int, int] = Counter()
        for words in word_pieces((row.text or "").encode("utf-8", "replace").translate(FOLD)):
            for w in words:
                counts[known.setdefault(w, len(known))] += 1
        asked.append(dict(counts))
    with small_batches(spark):
        held = stored(postings(docs, known))
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight_of = np.zeros(len(known), dtype=np.int64)
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weight_of[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    found = held.mapInArrow(searcher(asked, weight_of, n_docs, max(1, n_terms), top), BEST)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, row.item_id) for k, row in enumerate(rows)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each row of `items` (item_id, text).

    Terms are runs of digits, letters and non-ASCII characters, A-Z in lower case; a null text has
    none. Every row of `docs` is a document and every row of `items` an item of its own, whether ids
    repeat or not; null ids come before others of the same score. Items are served in blocks of about
    BLOCK_TERMS terms, each by one pass over the documents. An item without a hit has no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    sized = items.select(F.col("item_id").cast("long"), "text").withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, total // (2 * BLOCK_TERMS))  # a term and its separator are two characters at least
    out = None
    for k in range(blocks):
        mine = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        part = best_of_block(spark, docs, mine, top)
        out = part if out is None else out.unionByName(part)
    return out
