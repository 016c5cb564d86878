"""Operators and stages against plain Python that takes no code from them."""

import hashlib
import math
import struct
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import chat_format, lm_scoring, mixing, spm_sampling, topk_search


def spark_hash(*values):
    """Spark's xxhash64: each value seeds the next, 42 the first; numbers are little-endian, nulls pass the seed on."""
    h = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "s" else struct.pack("<" + kind, v)
            h = xxhash.xxh64(data, seed=h % 2**64).intdigest()
            h -= 2**64 if h >= 2**63 else 0
    return h


def n_words(text):
    return len((text or "").encode().split())


def plain_weights(tokens, entropy, lift, most, budget):
    """Exponent and repeats of sources by their tokens: a fine scan of the exponent, then halving around it."""
    total = sum(tokens.values())
    logs = {s: math.log(t / total) for s, t in tokens.items()}

    def weights(a):
        w = {s: math.exp(a * x) for s, x in logs.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def least(bad):
        low, high = 0.0, 1.0
        while high - low > 1e-15:
            mid = (low + high) / 2
            low, high = (mid, high) if bad(weights(mid)) else (low, mid)
        return high

    spread = lambda w: -sum(x * math.log(x) for x in w.values() if x)
    repeats = lambda w: max(budget * total * w[s] / tokens[s] for s in w)
    natural, equal = spread(weights(1.0)), math.log(len(tokens))
    target = max(entropy * equal, natural + lift * (equal - natural))
    a = 1.0 if natural >= target else least(lambda w: spread(w) > target)
    if repeats(weights(a)) > most:
        a = max(a, least(lambda w: repeats(w) > most))
    return a, {s: round(budget * total * w / tokens[s], 9) for s, w in weights(a).items()}


def plain_schedule(rows, entropy=0.97, lift=0.0, most=4.0, budget=1.0, seed=17, block_tokens=250_000):
    """Counter of (doc_id, source, pass_no, block, position) of rows (doc_id, source, text)."""
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += n_words(t)
    _, r = plain_weights({s: n for s, n in tokens.items() if n}, entropy, lift, most, budget)
    blocks = defaultdict(list)
    for i, s, t in rows:
        place = spark_hash(("i", seed), ("q", i), ("s", t))
        n = max(1, math.ceil(tokens[s] / block_tokens))
        blocks[s, spark_hash(("i", seed + 1), ("q", place)) % n].append((place, i, n_words(t)))
    out = Counter()
    for (s, b), members in blocks.items():
        passes, part = divmod(r.get(s, 1.0), 1)
        part *= sum(n for _, _, n in members)
        members.sort()
        for at, (place, i, n) in enumerate(members):
            upto = sum(m for p, j, m in members if (p, j) <= (place, i))
            upto = sum(m for p, j, m in members if p <= place) if any(p == place and j != i for p, j, _ in members) else upto
            for k in range(int(passes) + (n > 0 and upto - n / 2 < part)):
                out[i, s, k, b, at + 1] += 1
    return out


def test_schedule(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}", "w " * (1 + i % 50)) for i in range(600)] + [(5000, None, "a b"), (5001, "s0", None), (5002, "s0", ""), (5003, "blank", " ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for setting in ({}, {"lift": 0.5}, {"entropy": 0.999, "max_repeats": 2.5}, {"entropy": 0.0, "budget": 0.3}):
        got = mixing.schedule(docs, mixing.MixConfig(block_tokens=2000, **setting)).collect()
        plain = {"most" if k == "max_repeats" else k: v for k, v in setting.items()}
        assert Counter((r.doc_id, r.source, r.pass_no, r.block, r.position) for r in got) == plain_schedule(rows, block_tokens=2000, **plain)


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_survivors(rows):
    """The rows that stay of (doc_id, source, text, ...): one of each group of near copies, the one with the least doc_id."""
    sets, group = [shingles(r[2]) for r in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        key = (rows[i][0] is not None, rows[i][0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = key, i
    return Counter(rows[i][:1] + (rows[i][2],) for _, i in best.values())


def test_stages(spark, sf):
    """Near-duplicates, mixing and encoding on real texts with copies, ties, repeated rows, nulls and a very long text."""
    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(70)
    base = [r.asDict() for r in table.collect()]
    long = base[0] | {"doc_id": 9005, "text": " ".join(f"word{i * i % 9973}" for i in range(60_000))}
    copy = [base[3] | {"doc_id": 9001}, base[4] | {"doc_id": 9002, "text": base[4]["text"] + " tail"}, base[5], base[6] | {"doc_id": None}]
    docs = spark.createDataFrame([tuple(r[c] for c in table.columns) for r in base + copy + [long]], table.schema)
    rows = [(r["doc_id"], r["source"], r["text"]) for r in base + copy + [long]]
    one = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert one.columns == docs.columns
    kept = [(r.doc_id, r.source, r.text) for r in one.collect()]
    want = plain_survivors(rows)
    assert {t for _, _, t in kept} == {t for _, t in want} and sum(want.values()) == len(kept)
    frame = spark.createDataFrame([(i, s, t) for i, s, t in kept if i is not None], "doc_id long, source string, text string")
    mixed = corpus_pipeline.source_mixing(spark, frame, sf).collect()
    emitted = Counter()
    for (i, *_), n in plain_schedule([r for r in kept if r[0] is not None]).items():
        emitted[i] += n
    assert Counter(r.doc_id for r in mixed) == emitted
    coded = corpus_pipeline.encoding(spark, docs.withColumn("rank", F.lit("clash")), sf)
    back = spm_sampling.decode(coded.join(docs.select("doc_id", "text").distinct(), "doc_id"), ["doc_id", "text", "log_prob"]).collect()
    assert back and all(r.decoded == r.text and r.log_prob <= 0 for r in back)


def test_stages_of_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_loss_spans(spark):
    """Spans of a long conversation cover its assistant texts: by code points and by bytes, each once, in order."""
    texts = ["plain", "", "é☃\U0001f600", "<|im_end|>", "a\\<|b", "x" * 500]
    rows = [(1, i, "assistant" if i % 3 else "user", texts[i % len(texts)] + str(i)) for i in range(3000)]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", None), (4, 5, "assistant", "a"), (4, 700, "assistant", "b"), (4, None, "Assistant", "c")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        said = [t or "" for c, _, role, t in sorted(rows, key=lambda x: (x[0], -1 if x[1] is None else x[1])) if c == r.conv_id and role == "assistant"]
        held = [t.replace("\\", "\\\\").replace("<|", "<\\|") for t in said]
        raw = r.formatted.encode()
        assert [r.formatted[s.start : s.stop] for s in r.loss_spans] == held
        assert [raw[s.byte_start : s.byte_stop].decode() for s in r.loss_spans] == held
        assert hashlib.sha256("".join(said).encode()).hexdigest() == next(
            x.loss_sha256 for x in chat_format.digest_chats(spark.createDataFrame([r], chat_format.format_chats(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string")).schema)).collect()
        )


def test_names_that_kept_columns_take(spark):
    docs = spark.createDataFrame([(1, "one two three", 7.0, "a"), (2, None, 8.0, "b")], "doc_id long, text string, score double, rank string")
    scored = lm_scoring.score(docs, lm_scoring.fit(docs), ["doc_id", "score", "text"])
    assert scored.columns == ["doc_id", "score", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score_"]
    assert {(r.doc_id, r.score, r.text) for r in scored.collect()} == {(1, 7.0, "one two three"), (2, 8.0, None)}
    coded = spm_sampling.encode(docs, "doc_id", ["rank", "text"])
    assert coded.columns[:3] == ["rank", "text", "rank_"] and {(r.rank, r.rank_) for r in coded.collect()} >= {("a", 1), ("a", 2), ("b", 1)}


def test_partial_sums_lose_no_pair_and_prune():
    """The best of a block by stages are the best of all pairs; vectors along few directions are pruned by the first stages."""
    rng = np.random.default_rng(3)
    flat = np.floor(256 * rng.normal(0, 1, (3000, 32)) * np.array([1.0] * 6 + [0.05] * 26))
    even = np.floor(256 * rng.normal(0, 1, (3000, 32)))
    for m, most in ((flat, 0.05), (even, 1.0)):
        c = m[np.argsort(-np.linalg.norm(m, axis=1))]
        values, basis = np.linalg.eigh(c.T @ c)
        q, ids = c[::100], np.arange(0, 3000, 100)
        rows, low, pairs = topk_search.best_of(q, ids, c, np.arange(3000), np.full(len(q), -np.inf), basis[:, np.argsort(-values)], 5)
        want = []
        for i, v in zip(ids.tolist(), q, strict=True):
            best = sorted((-int(v @ x), j) for j, x in enumerate(c) if j != i)[:5]
            want += [(i, j, -s) for s, j in best]
        assert sorted(rows) == sorted(want)
        rows, _, pairs = topk_search.best_of(q, ids, c, np.arange(3000), low, basis[:, np.argsort(-values)], 5)
        assert sorted(rows) == sorted(want)
        assert pairs == sorted(pairs, reverse=True) and pairs[-1] < most * pairs[0]


def test_bounds_of_all_pairs_are_one_product(monkeypatch):
    """Stages that send nothing off are tried once a block, and a pack's best over many blocks are those of all vectors, at any length."""
    rng = np.random.default_rng(8)
    made = []
    product = topk_search.Block.product
    monkeypatch.setattr(topk_search.Block, "product", lambda self, q, c: (made.append(q.shape[1]), product(self, q, c))[1])
    for scale in (1, 40, 1e4):
        v = np.floor(rng.normal(0, 1, (4 * 4096, 32)) * 64) * scale
        ids = rng.permutation(len(v)).astype(np.int64)
        basis = np.eye(32)
        pack = topk_search.Pack(v[:40], ids[:40], np.full(40, -np.inf), basis, 5)
        made.clear()
        for a in range(0, len(v), 4096):
            order = a + np.argsort(-np.linalg.norm(v[a : a + 4096], axis=1))
            pairs = pack.meet(topk_search.Block(v[order], ids[order], basis))
            assert pairs == sorted(pairs, reverse=True) and pairs[-1] < pairs[0]
        # A quarter of 32 coordinates and the rest; 8 chunks a block.
        assert made.count(9) <= 8 and made.count(25) == 4 * 8
        got = list(zip(*(x.tolist() for x in pack.rows()), strict=True))
        want = []
        for q, i in zip(v[:40], ids[:40].tolist(), strict=True):
            s = v @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
            want += [(i, int(ids[j]), int(s[j])) for j in order]
        assert sorted(got) == sorted(want)
