"""Fill-in-the-middle, suffix matches and periodic runs against plain Python over whole texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fill_middle, periodic_runs, suffix_match, words
from shelfmark.llm.registry import QUERIES

ODD = [(1, "a\nb\nc", "x"), (2, None, None), (3, "", "x"), (4, "\n\n", "x"), (5, "word é世😀 " * 9000 + "\n", "x"), (6, "has <S> in it\n", "x"), (7, "one line", "x"), (7, "one line", "x"), (None, "no id\nhere", "x")]


def odd(spark, clash):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {clash} string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# The words of texts


def test_hashed_words_split_as_bytes_do():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB \t\n\x0b\x0cé9") for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"x" * (3 << 20), b"long " * 400000]
    hashes, counts = words.hashed_words(texts, words.NOT_SPACE, lower=True)
    parts = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(p) for p in parts]
    flat = [w for p in parts for w in p]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


# 11: fill in the middle


def plain_fim(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_fill_middle"](spark, sf).collect()
    assert len(got) == len(texts) and {r.form for r in got} >= {"psm", "spm"}
    for r in got:
        n, form, p, m, out = plain_fim(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id] or ""))


def test_fill_middle_odd_rows(spark):
    got = fill_middle.fill_in_middle(odd(spark, "fim"), "doc_id", "text")
    assert got.columns == ["doc_id", "text", "fim"]
    rows = got.withColumn("back", fill_middle.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.fim.units, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fill_middle.fill_in_middle(odd(spark, "fim").limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("unit", ["line", "char"])
def test_every_cut_of_long_texts(unit):
    rng = random.Random(2)
    for size in (0, 1, 7, fill_middle.BLOCK - 1, fill_middle.BLOCK, 3 * fill_middle.BLOCK + 5):
        text = "".join(rng.choice("ab\né世😀") for _ in range(size))
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        blocks = fill_middle.Blocks(np.frombuffer(text.encode(), np.uint8), unit)
        assert (blocks.units, blocks.points) == (len(units), len(text))
        ends, points = np.cumsum([0] + [len(u.encode()) for u in units]), np.cumsum([0] + [len(u) for u in units])
        for k in range(0, len(units) + 1, 1 if len(units) < 999 else 13):
            assert blocks.cut(k) == (ends[k], points[k])


def test_marks_that_could_arise_beside_texts_are_refused():
    for bad in ({"prefix": "<S>"}, {"prefix": "", "suffix": "s"}, {"prefix": "aba", "suffix": "cd", "middle": "ef"}, {"unit": "page"}):
        with pytest.raises(ValueError):
            fill_middle.Shape(**bad)


# 12: benchmark decontamination


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_matches(texts, items, window):
    sets = {}
    for name, text in items:
        w = alnum(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            sets.setdefault(tuple(w[j : j + k]), []).append((name, w, j))
    sizes = {len(k) for k in sets}
    out = []
    for text in texts:
        w, hit, found, longest = alnum(text), set(), set(), 0
        for k in sizes:
            for i in range(len(w) - k + 1):
                for name, x, j in sets.get(tuple(w[i : i + k]), ()):
                    hit |= set(range(i, i + k))
                    found.add(name)
                    n = k
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    longest = max(longest, n)
        out.append((len(w), len(hit), sorted(found), longest))
    return out


def digest_of(found):
    return [(m["n_words"], sum(e - b for b, e in m["spans"]), sorted(set(m["items"])), m["longest"]["words"] if m["longest"] else 0) for m in found]


def test_matches_of_random_texts():
    rng = random.Random(3)
    for _ in range(150):
        v = rng.choice([1, 2, 3, 8, 40])

        def text(n, v=v):
            return " ".join(f"w{rng.randrange(v)}" for _ in range(n))

        items = [(str(i), text(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(rng.randrange(7))]
        items += [("again", t) for _, t in items[:1]]
        texts = [text(rng.choice([0, 1, 5, 20, 60])) + (" " + rng.choice(items)[1] + " w1" if items and rng.random() < 0.5 else "") for _ in range(6)]
        window = rng.choice([2, 4, 10])
        got = suffix_match.match_group([t.encode() for t in texts], suffix_match.pack_items(items, window), shard=rng.choice([7, 50, 1 << 21]))
        assert digest_of(got) == plain_matches(texts, items, window)


def test_places_of_the_longest_match():
    items = [("a", " ".join(f"w{i}" for i in range(30))), ("b", "v1 v2 v3")]
    text = "x " + " ".join(f"W{i}" for i in range(5, 20)) + " y, v1-v2.v3"
    (m,) = suffix_match.match_group([text.encode()], suffix_match.pack_items(items, 10))
    assert m["longest"] == {"words": 15, "begin": 1, "item_id": "a", "item_begin": 5}
    assert m["spans"] == [[1, 16], [17, 20]] and m["items"] == ["a", "b"]


def test_decontamination_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = dict(zip([r.doc_id for r in docs], plain_matches([r.text for r in docs], items, 10), strict=True))
    got = QUERIES["op12_decontaminate"](spark, sf).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        n, hit, found, _ = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0)


@pytest.mark.parametrize("pack", [1 << 20, 40])
def test_decontamination_odd_rows(spark, pack):
    tests = spark.createDataFrame([(1, "One LINE", 0), (1, "one line", 0), (2, None, 0), (3, "...", 0), (None, "no id", 0), (4, "世😀 word é世😀 word é世😀 word é世😀 word é世😀 word é世😀 word", 0)], "item_id long, text string, match int")
    got = suffix_match.find_matches(odd(spark, "match"), "text", tests, "item_id", "text", pack=pack)
    assert got.columns == ["doc_id", "text", "match"]
    rows = got.collect()
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in tests.collect()]
    assert digest_of([r.match.asDict(True) for r in rows]) == plain_matches([r.text for r in rows], items, 10)
    kept = suffix_match.decontaminate(odd(spark, "_match"), "text", tests, "item_id", "text")
    assert kept.columns == ["doc_id", "text", "_match"]
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(repr(r) for r in spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6)], "doc_id long").collect())
    assert suffix_match.decontaminate(odd(spark, "b"), "text", tests.limit(0), "item_id", "text").count() == len(ODD)
    assert suffix_match.decontaminate(odd(spark, "b").limit(0), "text", tests, "item_id", "text").count() == 0


# 13: periodic runs


def plain_runs(w):
    """All lags of all words, one lag at a time."""
    seen = {}
    x = np.array([seen.setdefault(v, len(seen)) for v in w], dtype=np.int64)
    out = {}
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            if b - a + q >= max(24, 3 * q):
                # Lags go up, so the first of a stretch is its smallest period.
                out.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(1)
    total = 0
    for _ in range(600):
        n, k = rng.choice([0, 1, 10, 30, 60, 120, 200]), rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a + p, rng.randrange(a, n) + 1):
                w[i] = w[i - p]
        hashes = (np.array(w, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        got = [tuple(r) for r in periodic_runs.diagonals(hashes, np.zeros(n, np.int64)).tolist()]
        total += len(got)
        assert got == plain_runs(w)
    assert total > 50


def test_runs_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got) > 10
    for r in got:
        w = (docs[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        w = [x.decode() for x in w]
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.n_runs == len(runs)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(plain_collapse(w, runs))


def test_runs_odd_rows(spark):
    more = [(8, "a " * 24, "x"), (9, "a " * 23, "x"), (10, "p q r s t u v w " * 3, "x"), (10, "p q r s t u v w " * 3, "x"), (11, "\x0b\x0c \t\r\n", "x")]
    docs = spark.createDataFrame(ODD + more, "doc_id long, text string, found string")
    got = periodic_runs.periodic_runs(docs, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "found"]
    rows = got.collect()
    assert len(rows) == len(ODD) + len(more)
    for r in rows:
        w = (r.text or "").encode().split()
        runs = plain_runs(w)
        assert [tuple(x) for x in r.found.runs] == runs and r.found.n_words == len(w)
        assert r.found.collapsed == plain_collapse([x.decode() for x in w], runs)
    assert periodic_runs.periodic_runs(docs.limit(0), "doc_id", "text").count() == 0
