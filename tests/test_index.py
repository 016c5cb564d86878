"""Stored word indexes, vectors in blocks and names by pattern, against plain Python and against a rebuild."""

import fnmatch
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import search as Q
from shelfmark.operators import vectors as V
from shelfmark.operators.index import Index, bm25
from shelfmark.sources import stored

WORDS = "alpha beta gamma delta eps zeta Ünï 42 x_1".split()


def some_docs(seed, ids):
    rng = random.Random(seed)
    return [("c%d" % (i % 2), i % 3, i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 4, 30])))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "collection string, user_id long, file_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, 0, "alpha gamma"), (2, 1, "ünï 42 nothing"), (3, 2, ""), (4, 9, "alpha")], "query_id long, user_id long, bm25_query string")


def plain_bm25(rows, queries):
    words = {(c, u, f): re.findall(r"\w+", t.lower()) for c, u, f, t in rows}
    n, total, df = Counter(), Counter(), Counter()
    for (c, _, _), w in words.items():
        n[c] += 1
        total[c] += len(w)
        df.update((c, t) for t in set(w))
    out = {}
    for q, user, text in queries:
        for (c, u, f), w in words.items():
            score = 0
            for t in set(re.findall(r"\w+", text.lower())) if u == user else ():
                tf = w.count(t)
                idf = math.log(1 + (n[c] - df[c, t] + 0.5) / (df[c, t] + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) * n[c] / total[c])) if tf else 0
            if round(score, 6) > 0:
                out[q, c, u, f] = round(score, 6)
    return out


def content(index):
    rows = index.postings().drop("bucket", "delta")
    return [Counter(map(tuple, x.select(*sorted(x.columns)).collect())) for x in (rows, index.frequencies(), index.totals())]


def test_deltas_equal_a_rebuild(spark, tmp_path):
    first, more = some_docs(1, range(40)), some_docs(2, range(30, 60))
    now = {r[2]: r for r in first + more}
    index = Index(spark, f"{tmp_path}/a", ["file_id"], buckets=4).add(frame(spark, first), "text")
    index.add(frame(spark, more), "text")
    gone = spark.createDataFrame([(u, f) for _, u, f, _ in now.values() if f % 7 == 0] + [(0, 999)], "user_id long, file_id long")
    index.delete(gone)
    now = {f: r for f, r in now.items() if f % 7}
    # A file that was deleted comes back with another text.
    index.add(frame(spark, [("c1", 7 % 3, 7, "alpha back again")]), "text")
    now[7] = ("c1", 7 % 3, 7, "alpha back again")
    rebuilt = Index(spark, f"{tmp_path}/b", ["file_id"], buckets=4).add(frame(spark, list(now.values())), "text")
    assert content(index) == content(rebuilt)
    queries = asked(spark)
    scores = lambda i: {(r.query_id, r.collection, r.user_id, r.file_id): r.score for r in bm25(queries, i).collect()}
    want = plain_bm25(list(now.values()), [tuple(r) for r in queries.collect()])
    assert scores(index) == scores(rebuilt) == want and want
    again = Index(spark, f"{tmp_path}/a")
    assert again.keys == ["file_id"] and again.buckets == 4 and len(again.live) == 4
    again.compact()
    assert len(again.live) == 1 and content(again) == content(rebuilt) and scores(again) == want
    assert len(stored.folders(spark, f"{tmp_path}/a/postings")) == 1


def test_many_deltas_are_merged(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", ["file_id"], buckets=2)
    for i in range(4):
        index.add(frame(spark, some_docs(i, [i])), "text", max_deltas=2)
    assert len(index.live) <= 2
    assert content(index) == content(Index(spark, f"{tmp_path}/j", ["file_id"], buckets=2).add(frame(spark, [r for i in range(4) for r in some_docs(i, [i])]), "text"))


def test_a_write_that_died_is_not_read(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", ["file_id"], buckets=2).add(frame(spark, some_docs(1, range(5))), "text")
    before = content(index)
    index._write(index._next(), index.postings().drop("bucket", "delta"), None)
    assert content(Index(spark, f"{tmp_path}/i")) == before
    index.add(frame(spark, some_docs(2, range(5, 9))), "text")
    assert content(index) == content(Index(spark, f"{tmp_path}/j", ["file_id"], buckets=2).add(frame(spark, some_docs(1, range(5)) + some_docs(2, range(5, 9))), "text"))


def test_an_empty_index(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", ["file_id"], buckets=2).add(frame(spark, []), "text")
    assert bm25(asked(spark), index).count() == 0 and Index(spark, f"{tmp_path}/i").postings().count() == 0
    assert content(index.add(frame(spark, some_docs(1, range(5))), "text")) == content(Index(spark, f"{tmp_path}/j", ["file_id"], buckets=2).add(frame(spark, some_docs(1, range(5))), "text"))


def test_words_prune_buckets(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", ["file_id"], buckets=4).add(frame(spark, some_docs(1, range(9))), "text")
    plan = index.postings().where("bucket >= 0")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # Tenant 0 holds most vectors and is cut into several blocks and salts.
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "PACK", 4)
    monkeypatch.setattr(V, "SALT", 2)
    rows = [(0 if i < 150 else i % 4, i, None if i % 31 == 0 else rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(200)]
    ask = [(q, q % 4, None if q == 5 else rng.integers(-3, 4, 5).astype(float).tolist()) for q in range(12)]
    v = spark.createDataFrame(rows, "user_id long, id long, embedding array<float>")
    q = spark.createDataFrame(ask, "query_id long, user_id long, query_vector array<float>")
    want, span = {}, {}
    for i, user, x in ask:
        found = []
        for u, k, y in rows:
            if x is not None and y is not None and u == user:
                found.append((-round(float(np.dot(x, y)) / (math.hypot(*x) * math.hypot(*y) + 1e-9), 6) + 0.0, k))
        want |= {(i, n): (k, -s + 0.0) for n, (s, k) in enumerate(sorted(found)[:7], 1)}
        if found:
            span[i] = (-max(found)[0] + 0.0, -min(found)[0] + 0.0)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in V.nearest(q, v, ["id"], ["user_id"], 7).collect()}
    assert got == want
    blocks = V.packs_of(v, ["id"], ["user_id"], [])
    assert blocks.where("user_id = 0").select("_salt").distinct().count() > 1
    assert {r.query_id: (r.low, r.high) for r in V.score_ranges(q, blocks, ["id"], ["user_id"], []).collect()} == span


def test_hybrid_is_what_all_pairs_give(spark):
    rng = random.Random(4)
    vectors = [("c%d" % (i % 2), i % 2, i, 0, [rng.random() - 0.5 for _ in range(4)] if i % 9 else None) for i in range(60)]
    words = [(q, "c%d" % (i % 2), i % 2, i, 0, round(rng.random() * 5, 6)) for q in range(6) for i in range(60) if i % 2 == q % 2 and rng.random() < 0.4]
    asks = [(q, q % 2, [rng.random() - 0.5 for _ in range(4)] if q != 3 else None) for q in range(6)]
    v = spark.createDataFrame(vectors, "collection string, user_id long, file_id long, chunk_index long, embedding array<double>")
    w = spark.createDataFrame(words, "query_id long, collection string, user_id long, file_id long, chunk_index long, score double")
    a = spark.createDataFrame(asks, "query_id long, user_id long, query_vector array<double>")
    dense = defaultdict(dict)
    for q, u, x in asks:
        for c, user, f, _, y in vectors:
            if x and y and u == user:
                dense[q, c][f] = round(sum(p * r for p, r in zip(x, y, strict=True)) / (math.hypot(*x) * math.hypot(*y) + 1e-9), 6)
    lexical = defaultdict(dict)
    for q, c, _, f, _, s in words:
        lexical[q, c][f] = s

    def scaled(side, f):
        if f not in side:
            return 0.0
        low, high = min(side.values()), max(side.values())
        return 1.0 if low == high else (side[f] - low) / (high - low)

    want = {}
    for key in {*dense, *lexical}:
        for f in {*dense[key], *lexical[key]}:
            s = round(0.5 * scaled(dense[key], f) + 0.5 * scaled(lexical[key], f), 6)
            if s > 0.55:
                want[key[0], f] = s
    got = {(r.query_id, r.file_id): r.score for r in Q.hybrid(a, w, ["file_id", "chunk_index"], v).collect()}
    assert got == want and want


def test_names_like_patterns(spark):
    names = ["Report_v1.txt", "ab", "é", "", None, "aaaa", "report", "a%b_c.txt", "final report v1 of ab.txt", "*star*"]
    files = spark.createDataFrame([(u, "c", 10 * u + i, None, n) for u in (1, 2) for i, n in enumerate(names)], "user_id long, collection string, file_id long, created_at timestamp, filename string")
    parts = ["report", "rep*v1", "v1*rep", "a*b", "*", "", None, "a%b", "%", "_", "repo*txt", "é*", "aaa*aaa", "aa*aa", "report*zzz*x"]
    ask = spark.createDataFrame([(i, 1, p) for i, p in enumerate(parts)], "query_id long, user_id long, part string")
    got = sorted((r.query_id, r.file_id) for r in Q.names_like(ask, files).collect())
    want = sorted((i, 10 + j) for i, p in enumerate(parts) for j, n in enumerate(names) if p and p.strip("*") and n and fnmatch.fnmatchcase(n.lower(), f"*{p}*"))
    assert got == want
    held = sorted((r.query_id, r.file_id) for r in Q.names_holding(ask, files).collect())
    assert held == sorted((i, 10 + j) for i, p in enumerate(parts) for j, n in enumerate(names) if p and n and p in n.lower())


def test_a_common_run_of_characters_is_not_the_key(spark):
    """All names hold ``rep``; the pattern meets the one that holds its rarest run."""
    files = spark.range(200).select(F.lit(1).cast("long").alias("user_id"), F.lit("c").alias("collection"), F.col("id").alias("file_id"), F.lit(None).cast("timestamp").alias("created_at"), F.concat(F.lit("report_"), F.col("id") + 1000).alias("filename"))
    ask = spark.createDataFrame([(1, 1, "report_1007")], "query_id long, user_id long, part string")
    met = Q.names_like(ask, files)
    assert [r.file_id for r in met.collect()] == [7]


def test_postings_are_counted_in_the_row(spark):
    from shelfmark.operators.index import build_postings

    docs = spark.createDataFrame([(1, "b a B é"), (2, ""), (3, None)], "file_id long, t string")
    made = build_postings(docs, ["file_id"], "t")
    assert sorted(map(tuple, made.select("file_id", "dl", "term", "tf").collect()), key=repr) == sorted([(1, 4, "a", 1), (1, 4, "b", 2), (1, 4, "é", 1), (1, 4, None, 1), (2, 0, None, 1), (3, 0, None, 1)], key=repr)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_bm25_is_the_same_when_terms_are_sent_and_when_they_are_joined(spark, tmp_path, monkeypatch):
    from shelfmark.operators import index as I

    docs = spark.createDataFrame([("c", 1, i, "a b " * (i % 3) + "d") for i in range(9)], "collection string, user_id long, file_id long, t string")
    made = I.Index(spark, f"{tmp_path}/index", ["file_id"]).add(docs, "t")
    asked = spark.createDataFrame([(7, 1, "a d x"), (8, 2, "a")], "query_id long, user_id long, bm25_query string")
    monkeypatch.setattr(I.stored, "shared_folder", lambda spark, name, n=iter(range(9)): f"{tmp_path}/shared-{next(n)}")
    sent = sorted(map(tuple, I.bm25(asked, made).collect()))
    monkeypatch.setattr(I, "FEW_TERMS", 0)
    assert sent == sorted(map(tuple, I.bm25(asked, made).collect())) and {r[0] for r in sent} == {7}


def test_a_first_delta_is_not_shuffled(spark, tmp_path):
    """Each task writes its own documents' postings; later deltas, which are small, are gathered."""
    docs = frame(spark, [("c", 1, i, "alpha beta gamma") for i in range(80)]).repartition(4)
    index = Index(spark, f"{tmp_path}/i", ["file_id"], buckets=2).add(docs, "text")
    files = lambda d: len(list(tmp_path.glob(f"i/postings/delta={d}/bucket=-1/*.parquet")))
    assert files(0) == 4
    index.add(docs.limit(40), "text")
    assert files(1) == 1 and index.totals().first().n_docs == 80


def test_ranges_of_blocks_made_in_place(spark, monkeypatch):
    """Blocks that tasks make of their own rows, and packs that are sent or too many for it, give what all pairs give."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "PACK", 4)
    rows = [(0 if i < 150 else i % 4, "ab"[i % 2] if i % 3 else None, None if i % 31 == 0 else rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(200)]
    ask = [(q, q % 5, None if q == 6 else rng.integers(-3, 4, 5).astype(float).tolist()) for q in range(12)]
    v = spark.createDataFrame(rows, "user_id long, collection string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(ask, "query_id long, user_id long, query_vector array<float>")
    want = defaultdict(list)
    for i, user, x in ask:
        for u, c, y in rows:
            if x is not None and y is not None and u == user:
                want[i, c].append(round(float(np.dot(x, y)) / (math.hypot(*x) * math.hypot(*y) + 1e-9), 6) + 0.0)
    blocks = V.packs_in_place(v, ["user_id"], ["collection"])
    assert "Exchange" not in V.packs_in_place(v.coalesce(1), ["user_id"], ["collection"])._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert max(len(r.rows) for r in blocks.collect()) == 16
    for most in (64 << 20, 0):
        monkeypatch.setattr(V, "SENT_BYTES", most)
        got = {(r.query_id, r.collection): (r.low, r.high) for r in V.score_ranges(q, blocks, [], ["user_id"], ["collection"]).collect()}
        assert got == {k: (min(s), max(s)) for k, s in want.items()}


def test_nearest_of_more_queries_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "SALT", 2)
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i % 2, i, rng.normal(0, 1, 4).tolist()) for i in range(200)], "user_id long, id long, embedding array<double>")
    q = spark.createDataFrame([(i, i % 2, rng.normal(0, 1, 4).tolist()) for i in range(9)], "query_id long, user_id long, query_vector array<double>")
    sent = sorted(map(tuple, V.nearest(q, v, ["id"], ["user_id"], 3).collect()))
    monkeypatch.setattr(V, "SENT_BYTES", 0)
    assert sent == sorted(map(tuple, V.nearest(q, v, ["id"], ["user_id"], 3).collect())) and len(sent) == 27


def test_hybrid_with_vectors_held_apart(spark, monkeypatch):
    """Vectors that chunks share give the same as vectors in the chunks' rows, whatever is sent; some chunks and numbers have none."""
    rng = random.Random(9)
    held = [(i, [rng.random() - 0.5 for _ in range(4)] if i % 5 else None) for i in range(12)]
    at = [("c%d" % (i % 2), i % 2, i, 0, i % 14) for i in range(60) if i % 7]
    words = [(q, "c%d" % (i % 2), i % 2, i, 0, round(rng.random() * 5, 6)) for q in range(6) for i in range(60) if i % 2 == q % 2 and rng.random() < 0.4]
    asks = [(q, q % 2, [rng.random() - 0.5 for _ in range(4)] if q != 3 else None) for q in range(6)]
    e = spark.createDataFrame(held, "vec_id long, embedding array<double>")
    c = spark.createDataFrame(at, "collection string, user_id long, file_id long, chunk_index long, vec_id long")
    w = spark.createDataFrame(words, "query_id long, collection string, user_id long, file_id long, chunk_index long, score double")
    a = spark.createDataFrame(asks, "query_id long, user_id long, query_vector array<double>")
    keys = ["file_id", "chunk_index"]
    want = sorted(map(tuple, Q.hybrid(a, w, keys, c.join(e, "vec_id").drop("vec_id")).collect()))
    assert want and want == sorted(map(tuple, Q.hybrid(a, w, keys, c, held=e).collect()))
    monkeypatch.setattr(V, "SENT_BYTES", 0)
    monkeypatch.setattr(Q, "FEW", 0)
    assert want == sorted(map(tuple, Q.hybrid(a, w, keys, c, held=e).collect()))
