"""Chat, secrets, urls, toxicity, packing, language model and pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from motionloom.llm import chat, lm_score, packing, queries, secrets, toxicity, url_filter
from motionloom.llm.shared import inline_rows, share_of

LOG = "conv_id long, seq long, msg long, op string, role string, text string, piece string, turn int"


def log(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], LOG)


def test_folds_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi"), (1, 5, 1, "edit", None, "hi there"),
        (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "He"), (1, 4, 2, "delta", None, "y"),
        (1, 6, 2, "regenerate", None, None), (1, 7, 2, "delta", None, "Hel"), (1, 8, 2, "delta", None, "lo"),
        (1, 9, 3, "message", "user", "oops"), (1, 10, 3, "delete", None, None),
        (2, 1, 1, "message", None, None), (None, 1, 1, "message", "user", "null id"),
    ]
    got = sorted(((r.conv_id, r.msg, r.role, r.text) for r in chat.fold(log(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, "user", "hi there"), (1, 2, "assistant", "Hello"), (2, 1, "", ""), (None, 1, "user", "null id")], key=str)
    assert chat.fold(log(spark, [])).count() == 0


def test_rendering_round_trips_control_strings_and_masks(spark):
    draw = random.Random(4)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "é", "\n", "ok", "<\\s>"]
    said = {(c, t): ("assistant" if t % 2 else draw.choice(["user", "sy</s>s"]), "".join(draw.choices(parts, k=draw.randint(0, 9)))) for c in range(20) for t in range(draw.randint(1, 6))}
    said[30, 0] = ("user", "é" * 300_000 + "</s>")
    rows = [(c, t, 1, "message", *v) for (c, t), v in said.items()]
    rendered = chat.render(chat.fold(log(spark, [(c, t, t, *rest) for c, t, _, *rest in rows])))
    for r in chat.read_back(rendered).join(rendered.select("conv_id", "loss_spans"), "conv_id").collect():
        turns = [said[key] for key in sorted(said) if key[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(text for role, text in turns if role == "assistant")
        plain = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
        assert "".join(plain(r.formatted[s.start : s.end]) for s in r.loss_spans) == r.loss_text
        assert r.formatted.count("</s>") == len(turns) == r.formatted.count("<s>[INST]")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, spans string, row long, kind string")


def test_base_secrets_equal_python_and_random_strings_are_added(spark):
    draw = random.Random(6)
    parts = ["password", "API-key", "api_key", "Token", "secret", ": ", "=", " ", '"', "'", "abcd1234", "ab", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é😀", "\n", "deadbeef" * 4]
    rows = [(i, "".join(draw.choices(parts, k=draw.randint(0, 14)))) for i in range(300)] + [(400, None), (401, ""), (402, "é" * 200_000 + "token=abcdefgh9"), (None, "AKIA" + "A" * 12)]
    ordinary = "the international misunderstandings of straightforward representation"
    planted = "q7Xz9KpL2mVwT4sRb8YcN1dF6gHj"
    rows += [(500 + k, f"{ordinary} number {k}. password = {''.join(draw.choices('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', k=24))}") for k in range(40)] + [(600, f"{ordinary} {planted} counterrevolutionaries-misunderstandings")]
    docs = docs_of(spark, rows)
    model = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.report(secrets.scan(docs, model)).collect()}
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in rows:
        x = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        written = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = got[i]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == written
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
    at = len(ordinary) + 1
    assert got[600].spans == f"random:{at}:{at + len(planted)}"
    assert secrets.report(secrets.scan(docs_of(spark, []), model)).count() == 0


def test_planted_keys_are_found_and_identifiers_left(spark):
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = "get user account total response handler session number configuration value index parser stream buffer memory string table record update default window message network thread random output".split()
    key = lambda: "".join(draw.choices(letters, k=draw.randint(24, 40)))
    joins = (lambda ws: "_".join(ws), lambda ws: "-".join(ws), lambda ws: ws[0] + "".join(w.title() for w in ws[1:]), lambda ws: "_".join(ws).upper(), lambda ws: "_".join(ws) + str(draw.randint(1, 2030)))
    name = lambda n: draw.choice(joins)(draw.choices(words, k=n))
    train = [(k, f"{name(2)} {name(1)} {name(3)} token={key()} and {name(2)}") for k in range(400)]
    model = secrets.train(docs_of(spark, train))
    long_name = lambda: next(x for x in iter(lambda: name(5), None) if len(x) >= 20)
    tests = [(k, key()) for k in range(300)] + [(1000 + k, long_name()) for k in range(300)]
    found = {r.doc_id for r in secrets.report(secrets.scan(docs_of(spark, tests), model)).filter("spans <> ''").collect()}
    assert sum(k < 300 for k in found) >= 270 and sum(k >= 1000 for k in found) <= 30


def test_urls_follow_the_longest_rule(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/ab", "block"), ("Example.org", "/fr/", "allow"), ("org", "/fr/ab", "allow"), ("com", "", "block"), (None, "/", "block")]
    urls = ["http://x.EXAMPLE.net/en/1?q", "http://net/", "http://net", "https://a.org/fr/abc#x", "http://example.org/fr/abc", "http://notnet/", "x", None, "", "http://b.com", "http://a.b.c.d.example.net/EN/", "http://a\n.net/", "u://h?/://net/", "http://" + "a." * 3000 + "net/" + "x/" * 3000]
    pages = spark.createDataFrame([(k, u, "r", "v", "d") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string, verdict string, digest string")
    got = {}
    for r in url_filter.judge(pages, inline_rows(spark, "host, path, verdict", rules)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got) == len(urls) + 1
    for k, u in enumerate([*urls, urls[0]]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for h, p, v in rules for h in [(h or "").lower()] if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert [(r.host, r.path, r.rule, r.verdict) for r in got[k]] == [(host, path, best[2], best[1])]
    assert url_filter.judge(pages, inline_rows(spark, "host, path, verdict", rules).limit(0)).filter("verdict <> 'allow'").count() == 0
    assert url_filter.judge(pages.limit(0), inline_rows(spark, "host, path, verdict", rules)).count() == 0


def test_toxicity_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.1") + "/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.join(labels, "doc_id"), model).select("doc_id", "toxic", "toxicity").collect()
    unseen = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = {k: [(r.toxicity >= 0.5) == bool(k) for r in unseen if r.toxic == k] for k in (0, 1)}
    assert np.mean(right[0]) > 0.99 and np.mean(right[1]) > 0.75
    assert np.count_nonzero(model[0]) < 5000
    odd = docs_of(spark, [(None, None), (1, ""), (1, ""), (2, "é " * 300_000)])
    assert len({r.toxicity for r in toxicity.score(odd, model).filter("text IS NULL OR text = ''").collect()}) == 1
    assert toxicity.score(odd, model).columns == [*odd.columns, "toxicity"]
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.train(odd, labels.limit(0))
    assert not none[0].any() and none[1] == 0


def test_fast_and_full_tokenizers_agree():
    fast, full = packing.encoders()
    draw = random.Random(8)
    alphabet = "ab Z9é\u00a0\u2003\n\r\t'.,s-_中😀\u0301\x00\x85ß<|>endoftext"
    sample = ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|> x"]
    whole = full()
    for text in sample:
        assert packing.token_ids(text) == whole.encode(text, add_special_tokens=False).ids


def check_packed(rows, wanted):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    for i, ids in wanted.items():
        start = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, start) and (k == 0 or r.length == packing.CAPACITY)
            assert r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
            start += r.length
        assert start == len(ids)
    return len(by_sequence)


def test_packing_round_trip_and_tightness(spark, sf):
    whole = packing.encoders()[1]()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = {r.doc_id: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in docs.collect()}
    n = check_packed(packing.pack(docs).collect(), wanted)
    assert n <= 1.05 * math.ceil(sum(map(len, wanted.values())) / packing.CAPACITY)
    odd = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "a"), (5, "word " * 40_000)])
    assert sorted(r.length for r in packing.pack(odd).filter("doc_id < 5").collect()) == [1, 1, 1]
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plans_pack_every_length_once(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(packing.CAPACITY + 1, dtype=np.int64)
    lengths = draw.integers(1, packing.CAPACITY + 1, 5000) if seed else draw.geometric(0.01, 3000).clip(1, packing.CAPACITY)
    np.add.at(counts, lengths, 1)
    plan = packing.plan(counts)
    used = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(pattern) <= packing.CAPACITY and times > 0
        for length in pattern:
            used[length] += times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.02 * math.ceil(lengths.sum() / packing.CAPACITY) + 1


def brute_lm(docs, backoff=0.4):
    words = [(t or "").encode().lower().split() for _, t in docs]
    one, two = collections.Counter(), collections.Counter()
    for w in words:
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        own1, own2, total = collections.Counter(w), collections.Counter(zip(w, w[1:], strict=False)), 0.0
        for k, x in enumerate(w):
            pair = (w[k - 1], x)
            if k and two[pair] > own2[pair]:
                total += math.log((two[pair] - own2[pair]) / (one[w[k - 1]] - own1[w[k - 1]]))
            else:
                total += (math.log(backoff) if k else 0) + math.log(max(1, one[x] - own1[x]) / max(1, sum(one.values()) - len(w)))
        out.append((i, len(w), round(total, 6)))
    return sorted(out, key=str)


def test_language_model_scores_equal_brute_force(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choices("A b c d e É f".split(), k=draw.randint(0, 30)))) for i in range(50)] + [(60, None), (61, ""), (62, "b c"), (62, "b c"), (None, "e f"), (63, "a b " * 50_000)]
    want = brute_lm(rows)
    for size in (16_000_000, 500):
        monkeypatch.setattr(lm_score, "CHUNK_CHARS", size)
        monkeypatch.setattr(lm_score, "OWNED_CHARS", size // 2)
        got = lm_score.score(docs_of(spark, rows)).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=str) == want
    assert lm_score.score(docs_of(spark, []), 2).count() == 0
    assert lm_score.score(docs_of(spark, rows), 3).filter("mean_log_score > 0").count() == 0


def brute_trigrams(docs, backoff=0.4):
    words = [(t or "").encode().lower().split() for _, t in docs]
    grams = lambda w: collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    every = sum((grams(w) for w in words), collections.Counter())
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        own, total = grams(w), 0.0
        rest = lambda g, own=own: every[g] - own[g]
        for k, x in enumerate(w):
            deep = min(k, 2)
            n = next((n for n in range(deep, 0, -1) if rest(tuple(w[k - n : k + 1])) > 0), 0)
            share = rest(tuple(w[k - n : k + 1])) / rest(tuple(w[k - n : k])) if n else max(1, rest((x,))) / max(1, sum(map(len, words)) - len(w))
            total += (deep - n) * math.log(backoff) + math.log(share)
        out.append((i, len(w), round(total, 6)))
    return sorted(out, key=str)


def test_registered_language_model_counts_trigrams(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices("A b c d".split(), k=draw.randint(0, 30)))) for i in range(40)] + [(60, None), (62, "b c"), (62, "b c"), (63, "b q c d")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=str) == brute_trigrams(rows)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= now.count(), name
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))


def test_packed_integers_round_trip_in_little_space():
    draw = np.random.default_rng(2)
    gaps = draw.exponential(2**41.7, 50_000).astype(np.uint64)
    cases = [[], [0], [7, 7, 7], [0, 2**64 - 1], [2**63, 2**63 + 5, 1], draw.integers(0, 2**64, 999, dtype=np.uint64), gaps, draw.zipf(1.4, 9_999).astype(np.uint64), [1] * 1000 + [10**12] + [1] * 5]
    for case in cases:
        values = np.array(case, dtype=np.uint64)
        assert (lm_score.unpacked(lm_score.packed(values)) == values).all()
    assert len(lm_score.packed(gaps)) < 5.5 * len(gaps)


def test_samples_never_round_to_nothing(spark):
    rows = spark.range(2_000_000)
    assert abs(rows.filter(share_of(["id"], 20_000, 2_000_000)).count() - 20_000) < 1000
    assert rows.filter(share_of(["id"], 20_000, 20_000)).count() == 2_000_000
    assert rows.filter(share_of(["id"], 20_000, 5 * 10**10)).count() <= 10  # 0.8 are expected
    assert 500 < rows.filter(share_of(["id"], 20_000_000, 5 * 10**10)).count() < 1200
