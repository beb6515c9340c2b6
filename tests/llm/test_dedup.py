"""Near-duplicates, repeated lines, contamination and fingerprints against brute force."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from motionloom.llm import components, decontaminate, fingerprint, line_dedup, near_dup, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, low string, key long, node long, part int, row long"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4) for i, t in rows], DOCS)


def texts(seed=1, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        body = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        out.append(" ".join(body))
        for _ in range(draw.randint(0, 3)):
            copy = list(body)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(" ".join(copy))
    long_one = " ".join(draw.choice(words) for _ in range(30_000))
    return [*out, "", None, "  \n\t ", "one", "one", long_one, long_one + " end"]


def brute_components(rows, k, similarity):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= similarity * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.classes(frame(spark, rows), k=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.classes(frame(spark, []), k=4).count() == 0
    odd = [(None, "a b c d e"), (None, None), (3, "a b c d e"), (3, "a b c d e"), (9, "A b c d  e"), (4, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.classes(frame(spark, odd), k=4).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (4, 0, 4, True)], key=str)
    kept = near_dup.keep_one(frame(spark, odd))
    assert kept.columns == frame(spark, []).columns and kept.count() == 5


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def brute_lines(rows, width=3, least=50):
    occurrences = {}
    for i, t in rows:
        if t is None:
            continue
        lines = t.split("\n")
        n = lambda run: sum(len(re.findall("[^ ]+", x)) for x in run)
        spans = [(p, s) for s in range(1, width + 1) for p in range(len(lines) - s + 1) if n(lines[p : p + s]) >= (1 if s == width else least)]
        if len(lines) < width and n(lines):
            spans.append((0, len(lines)))
        for p, s in set(spans):
            occurrences.setdefault(tuple(lines[p : p + s]), []).append((i, p, s))
    gone = {}
    for places in occurrences.values():
        for i, p, s in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(p, p + s))
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows}


def test_repeated_lines_equal_brute_force(spark):
    draw = random.Random(3)
    lines = [" ".join(draw.choices(["so", "it", "is", "ä", ""], k=draw.randint(1, 6))) for _ in range(12)] + [" ".join(f"w{k}" for k in range(60))]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randint(1, 9)))) for i in range(80)] + [(90, None), (91, ""), (92, "\n\n\n"), (93, "\n".join(lines * 300))]
    clean = line_dedup.remove_repeats(frame(spark, rows))
    assert {r.doc_id: r.text for r in clean.collect()} == brute_lines(rows)
    assert clean.columns == [*frame(spark, []).columns, "n_lines", "n_removed"]


def test_repeated_lines_of_odd_tables(spark):
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "z\na\nb\nc")]
    assert sorted(((r.doc_id, r.text) for r in line_dedup.remove_repeats(frame(spark, rows)).collect()), key=str) == [(1, ""), (1, ""), (2, "z"), (None, "a\nb\nc")]


def brute_hits(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, which = words(t), set(), set()
        for item, passage in items:
            p = words(passage)
            for s in range(max(1, len(p) - width + 1)) if p else ():
                body = p[s : s + width]
                for at in range(len(w) - len(body) + 1):
                    if w[at : at + len(body)] == body:
                        hit.update(range(at, at + len(body)))
                        which.add(str(item))
        out.append((i, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    draw = random.Random(5)
    words = ["a", "b", "É", "é", "c9", "the"]
    say = lambda n: " ".join(draw.choices(words, k=n))
    items = [(k, say(draw.randint(1, 8))) for k in range(12)] + [(20, None), (21, " .. "), (22, "THE a-b É"), (22, "the A b É"), (None, "c9 c9")]
    docs = [(k, say(draw.randint(0, 60))) for k in range(40)] + [(50, None), (51, ""), (None, "the a b É"), (51, "THE, a\x00b!É"), (51, "THE, a\x00b!É"), (60, say(5000))]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, body string, size int")
    for width in (3, 5):
        got = [tuple(r) for r in decontaminate.report(frame(spark, docs), table, width).collect()]
        want = [row[:3] + row[3:] for row in brute_hits(docs, [x for x in items if x[0] is not None], width)]
        null_item = [tuple(r) for r in decontaminate.report(frame(spark, docs), table.filter("item_id IS NOT NULL"), width).collect()]
        assert sorted(null_item, key=str) == want and len(got) == len(want)
    assert decontaminate.report(frame(spark, []), table).count() == 0
    assert {r.n_hit for r in decontaminate.report(frame(spark, docs), table.limit(0)).collect()} == {0}
    left = decontaminate.without_contaminated(frame(spark, docs), table.filter("item_id IS NOT NULL"), 3)
    assert left.count() == sum(not row[5] for row in brute_hits(docs, [x for x in items if x[0] is not None], 3))
    assert left.columns == frame(spark, []).columns


def test_many_passages_join_by_shuffle(spark, monkeypatch):
    draw = random.Random(8)
    words = ["a", "b", "c9", "the", *[f"w{k}" for k in range(30)]]
    say = lambda n: " ".join(draw.choices(words, weights=[40, 40, 5, 40, *[1] * 30], k=n))
    items = [(k, say(draw.randint(1, 9))) for k in range(40)] + [(50, "a b"), (51, None), (52, "unseen words only")]
    docs = [(k, say(draw.randint(0, 80))) for k in range(60)] + [(70, None), (71, ""), (71, "the a b"), (71, "the a b"), (None, "a b a b"), (80, say(4000))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items, 4)
    monkeypatch.setattr(decontaminate, "PASSAGES_BROADCAST", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, cells, share in ((before, 1 << 20, 1000), ("-1", 4, 3), ("-1", 1 << 10, 50)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            monkeypatch.setattr(decontaminate, "FILTER_CELLS", cells)
            monkeypatch.setattr(decontaminate, "HOT_SHARE", share)
            got = [tuple(r) for r in decontaminate.report(frame(spark, docs), table, 4).collect()]
            assert sorted(got, key=str) == want
        assert decontaminate.report(frame(spark, []), table, 4).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def brute_cells(text, k=fingerprint.K, depth=fingerprint.DEPTH):
    """Occurrence-numbered k-mers of a text, as a list of names in text order."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, out = {}, []
    for a in range(max(1, len(w) - k + 1) if w else 0):
        g = tuple(w[a : a + k])
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def test_fingerprints_order_occurrences_and_edges(spark):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    body = draw.choices(words, k=300)
    swapped = body[150:] + body[:150]
    shuffled = draw.sample(body, len(body))
    rows = [(1, " ".join(body)), (2, "  ".join(body)), (3, " ".join(swapped)), (4, " ".join(shuffled)), (5, ""), (6, None), (7, "solo"), (8, " ".join(body * 60)), (9, "\t\n")]
    out = {r.doc_id: r.cells for r in fingerprint.with_cells(frame(spark, rows), "text", "cells").select("doc_id", "cells").collect()}
    assert out[1] == out[2] and out[5] == out[6] == out[9] == [] and len(out[7]) == 1
    alike = lambda a, b: len(set(out[a]) & set(out[b])) / len({c >> 32 for c in out[a]} | {c >> 32 for c in out[b]})
    assert alike(1, 3) > 0.3 > alike(1, 4)
    for i, t in rows:
        assert out[i] == signature(t)


def signed(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def chained(*parts):
    """The 64-bit hash of several values, each one's hash being the seed of the next; numbers by width in bytes."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p[0] % (1 << 8 * p[1])).to_bytes(p[1], "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return signed(seed)


def signature(text, depth=fingerprint.DEPTH):
    """Cells by plain loops: dealt tuples, and drawn ones where a cell was dealt too few."""
    top = lambda x: x - x % (1 << 32)
    place, dealt = [], {c: [] for c in range(64)}
    for at, (gram, count) in enumerate(brute_cells(text)):
        h = top(chained((top(chained(*gram)), 8), (count - 1, 4)))
        place.append((h, at))
        dealt[(h >> 58) + 32].append((h, at))
    if len(place) < depth:
        return [(((h >> 58) + 32) << 32) + chained((h, 8)) % (1 << 32) for h, _ in place]
    out = []
    for c in range(64):
        chosen = sorted(dealt[c])[:depth]
        if len(chosen) < depth:
            chosen = sorted((top(chained((h, 8), (c, 4))), at) for h, at in place)[:depth]
        out.append((c << 32) + chained(*[(h, 8) for h, _ in sorted(chosen, key=lambda x: x[1])]) % (1 << 32))
    return out


def test_short_texts_keep_their_order(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    rows, sizes = [], (20, 40, 60, 100, 800)
    for k, n in enumerate(s for s in sizes for _ in range(20)):
        body = draw.choices(words, k=n)
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body[n // 2 :] + body[: n // 2]))]
    out = {r.doc_id: set(r.cells) for r in fingerprint.with_cells(frame(spark, rows), "text", "cells").select("doc_id", "cells").collect()}
    alike = [len(out[2 * k] & out[2 * k + 1]) / 64 for k in range(20 * len(sizes))]
    means = [sum(alike[20 * i : 20 * i + 20]) / 20 for i in range(len(sizes))]
    text = dict(rows)
    for i, mean in enumerate(means):  # both k-mers of a tuple are shared, and half of all pairs keep their order
        grams = [set(brute_cells(text[40 * i + side])) for side in (0, 1)]
        shared, either = len(grams[0] & grams[1]), len(grams[0] | grams[1])
        assert abs(mean - 0.5 * shared * (shared - 1) / (either * (either - 1))) < 0.08, (sizes[i], mean)


def test_edited_texts_and_next_documents(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ID_CELL", 4)
    monkeypatch.setattr(fingerprint, "CELLS_ABOVE", 2)
    draw = random.Random(2)
    ids = sorted(draw.sample(range(-50, 400), 70))
    rows = [(i, "".join(draw.choices("ab é\n", k=draw.randint(0, 40)))) for i in ids]
    got = {r.doc_id: r for r in fingerprint.compare_edits(frame(spark, rows)).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    one = fingerprint.compare_edits(frame(spark, [(5, "alone here")])).first()
    assert one.near_next == 1.0
    assert fingerprint.compare_edits(frame(spark, [])).count() == 0
    assert fingerprint.compare_edits(frame(spark, [(None, "a"), (None, None), (1, "b"), (1, "b")])).count() == 4


def test_edits_lie_nearer_than_the_next_document(spark, sf):
    rows = queries.QUERIES["op8_document_fingerprints"](spark, sf).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert rows[0] > 0.08 > 0.02 > rows[1]


def test_sparse_ids_have_one_row_a_range_in_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELLS_ABOVE", 4)
    monkeypatch.setattr(fingerprint, "RANGES", 5)
    ids = sorted({(k * 0x9E3779B97F4A7C15 + 7) % (1 << 53) - (1 << 52) for k in range(60)})
    stretches = spark.createDataFrame([(i,) for i in ids], "stretch long")
    counts = [r["count"] for r in fingerprint.ranged(stretches).groupBy("above").count().collect()]
    assert len(counts) == 5 and max(counts) <= 15
    assert {r.stretch: r.prev for r in fingerprint.before(stretches).collect()} == dict(zip(ids, [ids[-1], *ids[:-1]], strict=True))
