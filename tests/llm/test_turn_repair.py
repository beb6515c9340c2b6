"""Conversation repair against a plain shortest path over whole conversations."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from motionloom.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string, place long"
#: What the next role may be, and the place after it.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 6) for r in rows], SCHEMA)


def brute(rows):
    """Counts, cost, audit and repaired turns of one conversation in order: Dijkstra by (cost, audit)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, n, place, out = heapq.heappop(heap)
        if n == len(rows) and place in (0, 3):
            break
        if (n, place) in done:
            continue
        done.add((n, place))
        for want, after in MOVES[place].items():
            if want != "s":
                name = {"u": "user", "a": "assistant"}[want]
                heapq.heappush(heap, (cost + 5, audit + "I", n, after, (*out, (name, ""))))
            if n < len(rows) and faults[n] not in ("blank", "duplicate"):
                _, role, text = rows[n]
                fee = 5 * (faults[n] == "truncated")
                if role[:1] == want:
                    heapq.heappush(heap, (cost + fee, audit + "K", n + 1, after, (*out, (role, text))))
                elif want != "s":
                    heapq.heappush(heap, (cost + fee + 1, audit + "R", n + 1, after, (*out, (name, text))))
        if n < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, place, out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), list(out)


def conversation(draw, size):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "student"]
    texts = ["Yes.", "no", "", " \n", None, "ok!", "Why?  \t", "é" * 70 + ".", "é" * 70 + "x.", "a\xa0"]
    rows, plain = [], draw.random() < 0.5
    for k in range(size):
        role = ("user", "assistant")[k % 2] if plain and draw.random() < 0.8 else draw.choice(roles)
        text = f"Turn {draw.randrange(40)}." if draw.random() < 0.6 else draw.choice(texts)
        rows.append((draw.choice([None, k, k, k, k + 1, 7]), role, text))
    return rows


@pytest.mark.parametrize(("segment", "parts"), [(32, 4), (2, 4), (3, 40)])
def test_audits_and_repairs_equal_a_shortest_path(spark, monkeypatch, segment, parts):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    turn_repair.whole.cache_clear(), turn_repair.piece.cache_clear()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        draw = random.Random(segment)
        talks = {c: conversation(draw, draw.randint(1, 12)) for c in range(120)}
        talks |= {None: conversation(draw, 9), 500: conversation(draw, 150), 501: [(None, "user", "Hi.")] * 30, 502: [(3, "assistant", "cut off")]}
        turns = frame(spark, [(c, *r) for c, rows in talks.items() for r in rows])
        found = turn_repair.audits(turns)
        got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
        want = {c: brute(rows) for c, rows in talks.items()}
        assert got == {c: w[0] for c, w in want.items()}
        fixed = turn_repair.repaired(turns, found)
        said = {}
        for r in fixed.orderBy("place").collect():
            said.setdefault(r.conv_id, []).append((r.role, r.text))
        assert said == {c: w[1] for c, w in want.items() if w[1]}
        hashed = {r.conv_id: r.sha256 for r in turn_repair.digests(fixed).collect()}
        assert hashed == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in w[1]).encode()).hexdigest() for c, w in want.items() if w[1]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_a_very_long_turn(spark):
    empty = frame(spark, [])
    assert turn_repair.audits(empty).count() == 0
    assert turn_repair.digests(turn_repair.repaired(empty, turn_repair.audits(empty))).count() == 0
    long_one = frame(spark, [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "word " * 400_000), (1, 2, "assistant", "End.")])
    found = turn_repair.audits(long_one)
    assert found.first().audit == "KDK" and found.first().cost == 2
    assert turn_repair.repaired(long_one, found).select(F.sum(F.length("text"))).first()[0] == 2_000_005


def test_every_conversation_has_a_row_also_without_turns(spark, tmp_path):
    dropped = [c for c in range(200) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(dropped[0], 0, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_turn_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
