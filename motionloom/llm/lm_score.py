"""Stupid-backoff scores of documents under the corpus's own word n-grams.

Documents are dealt to chunks of about `CHUNK_CHARS` characters. Each chunk counts its n-grams
once and sends them, as sorted 64-bit hashes with counts, to the partition of the count table that
owns the hash range. The owner sums the counts of all chunks and answers each chunk with the totals
of the n-grams it asked for; the chunk joins them to the n-grams of its documents and sums per
document. A frequent n-gram is one entry per chunk, so none is hot. A document's own n-grams are
taken off the totals, so it is scored by what the rest of the corpus says.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_key

ORDER = 2
BACKOFF = 0.4
CHUNK_CHARS = 16_000_000
OWNED_CHARS = 8_000_000  # characters of the corpus per owner of a hash range
CACHED_WORDS = 200_000

MIX = np.uint64(0x9E3779B97F4A7C15)
RARE = np.uint64(63)
HEAD = struct.Struct("<IBIIQ")


class Words:
    """64-bit hashes of words; keeps those of recent ones."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, make = self.known, xxhash.xxh64_intdigest
        out = []
        for w in (text or "").encode("utf-8", "replace").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = make(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n = 1 .. order; shorter at the start."""
    out = [words]
    for n in range(2, order + 1):
        low = out[-1][:-1] if len(out[-1]) else out[-1]
        mixed = (low ^ (low >> np.uint64(29))) * MIX + words[n - 1 :] if len(words) >= n else words[:0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX + np.uint64(n)
        out.append(mixed)
    return out


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in about their entropy: low bits as byte and bit planes, the rest in unary.

    The number of low bits is the cheapest near the logarithm of the mean. Values of RARE or more in
    unary stand as they are in a list of their own.
    """
    if not len(values):
        return HEAD.pack(0, 0, 0, 0, 0)
    values = values.astype(np.uint64, copy=False)
    base = values.min()
    values = values - base
    k0 = int(values.mean()).bit_length()
    sample = values[:: max(1, len(values) // 4096)]  # for the choice of a width only
    k = min(range(max(0, k0 - 3), k0 + 1), key=lambda k: len(sample) * (k + 1) + int(np.minimum(sample >> np.uint64(k), RARE).sum()))
    high = values >> np.uint64(k)
    rare = np.flatnonzero(high >= RARE)
    kept = values[rare]
    if len(rare):
        high[rare] = RARE
    ends = np.cumsum(high + np.uint64(1), dtype=np.int64) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    unary = np.packbits(unary)
    planes = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : k // 8].T)
    bits = [np.packbits((values >> np.uint64(bit)).astype(np.uint8) & 1) for bit in range(k // 8 * 8, k)]
    return b"".join([HEAD.pack(len(values), k, len(unary), len(rare), int(base)), unary.tobytes(), kept.tobytes(), planes.tobytes(), *[x.tobytes() for x in bits]])


def unpacked(data: bytes) -> np.ndarray:
    n, k, size, rare, base = HEAD.unpack_from(data)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    at = HEAD.size
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    at += size
    kept = np.frombuffer(data, "<u8", rare, at)
    at += 8 * rare
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, : k // 8] = np.frombuffer(data, np.uint8, n * (k // 8), at).reshape(-1, n).T
    at += n * (k // 8)
    values = wide.reshape(-1).view("<u8")
    for bit in range(k // 8 * 8, k):
        plane = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n)
        values |= plane.astype(np.uint64) << np.uint64(bit)
        at += (n + 7) // 8
    values |= high << np.uint64(k)
    if rare:
        values[high == RARE] = kept
    return values + np.uint64(base)


def owner_edges(owners: int) -> np.ndarray:
    """First hash of each owner's range, but for the first one."""
    return np.array([(k << 64) // owners for k in range(1, owners)], dtype=np.uint64)


def chunk_grams(texts: list, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct n-grams of a chunk, their counts, and the n-grams of each text, n = 1 .. order in turn."""
    make = Words()
    found = [g for t in texts for g in grams(make.hashes(t), order)]
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    keys, counts = np.unique(flat, return_counts=True)
    return keys, counts, found


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted hash lies in the sorted keys that hold it.

    Hashes are spread evenly, so a directory of their leading bits leads to within a few keys.
    """
    bits = max(1, len(keys).bit_length())
    shift = np.uint64(64 - bits)
    starts = np.zeros((1 << bits) + 1, dtype=np.int64)
    np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits), out=starts[1:])
    at = starts[(wanted >> shift).astype(np.int64)]
    left = np.flatnonzero(keys[at] != wanted)
    while len(left):
        at[left] += 1
        left = left[keys[at[left]] != wanted[left]]
    return at


def ask(order: int, owners: int):
    edges = owner_edges(owners)

    def run(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        keys, counts, _ = chunk_grams(texts["text"].tolist(), order)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        rows = [(key[0], k, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pd.DataFrame(rows, columns=["chunk", "owner", "keys", "counts"])

    return run


def answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """Totals over all chunks, for each chunk in the order of its own keys."""
    keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in asked["keys"]]
    cuts = np.cumsum([0, *map(len, keys)])
    every = np.concatenate(keys)
    order = every.argsort(kind="stable")  # merges the chunks' sorted keys
    every = every[order]
    starts = np.concatenate(([0], np.flatnonzero(every[1:] != every[:-1]) + 1))
    sums = np.add.reduceat(np.concatenate([unpacked(x) for x in asked["counts"]])[order], starts)
    totals = np.empty(len(every), dtype=np.uint64)
    totals[order] = np.repeat(sums, np.diff(starts, append=len(every)))
    return pd.DataFrame({"chunk": asked["chunk"], "owner": key[0], "totals": [packed(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def rest_counts(found: list[np.ndarray], totals: np.ndarray) -> list[np.ndarray]:
    """Counts of a document's n-grams (places of their totals, n = 1 .. order) in the rest of the corpus."""
    out = []
    for at in found:
        own, where, n = np.unique(at, return_inverse=True, return_counts=True)
        out.append((totals[own].astype(np.int64) - n)[where])
    return out


def document_score(others: list[np.ndarray], corpus_words: int, backoff: float) -> tuple[float, int]:
    """Sum of log scores and number of words that backed off to a shorter context, from `rest_counts`.

    The longest n-gram that the rest of the corpus has is used: its count over that of its context,
    times `backoff` for each step down. A word that the rest lacks counts as if it stood there once.
    """
    size, order = len(others[0]), len(others)
    rest = max(1, corpus_words - size)
    score = np.log(np.maximum(others[0], 1) / rest)
    steps = np.minimum(np.arange(size), order - 1)  # context there is
    score += steps * math.log(backoff)
    backed = steps.copy()
    for n in range(2, order + 1):
        seen = np.flatnonzero(others[n - 1] > 0)
        at = seen + n - 1
        context = others[n - 2][seen]
        score[at] = np.log(others[n - 1][seen] / np.maximum(context, others[n - 1][seen])) + (steps[at] - (n - 1)) * math.log(backoff)
        backed[at] = steps[at] - (n - 1)
    return float(score.sum()), int((backed > 0).sum())


def scorer(order: int, corpus_words: int, backoff: float):
    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, _, found = chunk_grams(texts["text"].tolist(), order)
        parts = [unpacked(x) for x in answers.sort_values("owner")["totals"]]
        totals = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        sizes = [len(g) for g in found]
        at = np.split(places(keys, np.concatenate(found)), np.cumsum(sizes)[:-1]) if len(keys) else found
        rows = []
        for k, doc_id in enumerate(texts["doc_id"]):
            mine = at[k * order : (k + 1) * order]
            log, backed = document_score(rest_counts(mine, totals), corpus_words, backoff) if len(mine[0]) else (0.0, 0)
            rows.append((doc_id, len(mine[0]), backed, log))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_backed_off", "log_score"]).astype({"doc_id": "Int64"})

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_backed_off, log_score, mean_log_score (null without words).

    Words are runs between ASCII blanks, A-Z in lower case. Null texts have no words; a corpus of
    one document knows no other words; rows that repeat count each, also for one another.
    """
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()
    chunks, owners = max(1, size[0] // CHUNK_CHARS), max(1, size[0] // OWNED_CHARS)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(chunks)).alias("chunk"))
    by_chunk = rows.groupBy("chunk")
    asked = by_chunk.applyInPandas(ask(order, owners), "chunk long, owner long, keys binary, counts binary")
    answers = asked.groupBy("owner").applyInPandas(answer, "chunk long, owner long, totals binary")
    scored = by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(scorer(order, int(size[1]), backoff), "doc_id long, n_words long, n_backed_off long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
