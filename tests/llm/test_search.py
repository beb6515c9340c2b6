"""Ranked search and SimHash classes against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from motionloom.llm import lexical, shared, simhash

DOCS = "doc_id long, text string, n long, terms string, bucket int, item_id int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, doc_id int, score int")


def brute_ranks(docs, items, top=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    read = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in read), sum(sum(c.values()) for _, c in read)
    df = Counter(w for _, c in read for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in read:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in split(text) if c[w])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(draw):
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 4))) for _ in range(150)]
    docs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(words, k=draw.randint(0, 60))).title()) for i in draw.sample(range(-500, 900), 700)]
    docs += [(1000 + k, docs[3][1]) for k in range(200)] + [(5, None), (None, docs[3][1]), (None, ""), (7, docs[9][1]), (7, docs[9][1]), (2000, "x9 " * 500_000 + docs[3][1])]
    items = [(k, " ".join(draw.choices(words, k=draw.randint(1, 25)))) for k in range(12)] + [(50, None), (51, "nowhere"), (None, words[0]), (3, words[1] * 2 + " " + words[1]), (52, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("postings", "terms", "size"), [(1 << 21, 1_000_000, 256), (700, 40, 2)])
def test_ranks_equal_brute_force(spark, monkeypatch, postings, terms, size):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    monkeypatch.setattr(lexical, "ROUND", size)
    docs, items = corpus(random.Random(terms))
    found = lexical.rank(frame(spark, docs), items_of(spark, items))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_ranks(docs, items)


def test_search_of_empty_tables(spark):
    assert lexical.rank(frame(spark, []), items_of(spark, [(1, "a")])).count() == 0
    assert lexical.rank(frame(spark, [(1, "a")]), items_of(spark, [])).count() == 0
    assert lexical.rank(frame(spark, [(1, "..."), (2, None)]), items_of(spark, [(1, "a")])).count() == 0


def test_bounds_spare_most_documents():
    random = np.random.default_rng(3)
    n, vocabulary = 20_000, 300
    sizes = random.integers(1, 12, n)
    terms = np.concatenate([random.choice(vocabulary, s, replace=False) for s in sizes])
    shard = lexical.Shard(random.permutation(n), np.ones(n, bool), random.integers(5, 200, n), sizes, terms, random.integers(1, 4, len(terms)), n, 100 * n)
    asked = [(3, 9000), (40, 7000), (299, 400)]
    weights = np.zeros(vocabulary, dtype=np.int64)
    for term, weight in asked:
        weights[term] = weight
    best = lexical.Ranking(10)
    scored = lexical.search(shard, asked, weights, best)
    every = shard.scores(np.arange(n), weights)
    want = sorted(zip((-every).tolist(), [True] * n, shard.ids.tolist(), strict=True))[:10]
    assert best.rows == want
    assert scored < n / 5


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(rows, prints):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    nodes = [(i, p) for (i, _), p in zip(rows, prints, strict=True) if i is not None]
    for (a, x), (b, y) in itertools.combinations(nodes, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    of = {p: root(i) for i, p in nodes}
    return sorted(((i, f"{p:016x}", root(i) if i is not None else of.get(p)) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_simhash_classes_equal_brute_force(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefg", k=draw.randint(1, 5))) for _ in range(200)]
    rows = []
    for k in range(120):
        body = draw.choices(words, k=draw.choice([1, 2, 3, 5, 40, 400]))
        rows.append((k, " ".join(body)))
        for copy in range(draw.randint(0, 3)):
            other = list(body)
            for _ in range(copy):
                other[draw.randrange(len(other))] = draw.choice(words)
            rows.append((k + 1000 * copy + 1000, draw.choice([" ", "\n", "  \t"]).join(other).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "never seen"), (3, rows[3][1]), (3, "another text of three"), (4001, "é" * 3_000_000), (4002, "ab " * 600_000)]
    prints = [plain_print(t) for _, t in rows]
    got = sorted((tuple(r) for r in simhash.classes(frame(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows, prints)
    assert simhash.classes(frame(spark, [])).count() == 0


def test_pieces_of_long_texts_give_the_same_fingerprint(monkeypatch):
    text = " ".join(f"word{k % 97} x{k % 13}" for k in range(5000)) + "\n\n"
    want = plain_print(text)
    monkeypatch.setattr(simhash, "word_pieces", lambda data: shared.word_pieces(data, 50))
    assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("block", [2, 40])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(block)
    base, found = draw.getrandbits(64), set()
    while len(found) < 150:
        found.add(base ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 5))))
    found |= {draw.getrandbits(64) for _ in range(50)}
    nodes = list(enumerate(sorted(found)))
    rows = spark.createDataFrame([(k, simhash._signed(p)) for k, p in nodes], "node long, print long")
    up = list(range(len(nodes)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for r in simhash.links(rows).collect():
        assert (nodes[r.u][1] ^ nodes[r.v][1]).bit_count() <= 3
        up[root(r.u)] = root(r.v)
    for (a, x), (b, y) in itertools.combinations(nodes, 2):
        if (x ^ y).bit_count() <= 3:
            assert root(a) == root(b)


def test_tables_cover_the_radius():
    for level in range(simhash.LEVELS):
        masks = simhash.family(level)
        for bits in itertools.combinations(range(64), 3):
            pattern = sum(1 << k for k in bits)
            assert any(not pattern & mask for mask in masks)
    assert simhash.free_bits() <= simhash.FREE_BITS
