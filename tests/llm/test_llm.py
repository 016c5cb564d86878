"""The corpus operators against brute force, round trips and held-out accuracy, with the odd inputs of each."""

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat_format, common, html_extract, langid, lm_scoring, mixing, near_dedup, registry, spm_sampling, tiff, topk_search, url_filters
from shelfmark.llm.components import components

ODD = [(1, "One two three four five six."), (2, None), (3, ""), (4, " \n\t"), (5, "word " * 5000), (6, "One two three four five six."), (6, "One two three four five six."), (None, "no id here at all")]


def docs(spark, rows=ODD, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = c.execute(registry.ORACLES[name])
    names = [d[0] for d in rows.description]
    got = registry.QUERIES[name](spark, sf).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(rows.fetchall())


# 1: URL filters


def test_urls(spark):
    urls = [(1, "HTTP://A.Example.ORG/es/x?y"), (2, None), (3, "no scheme"), (4, "x://example.org"), (5, "x://notexample.org/es/"), (6, "x://de.com/de/1#f"), (6, "x://de.com/de/1#f"), (7, "x://b.net/p/"), (8, "")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filters.RULES, "action string, host string, path string")
    listed = spark.createDataFrame([("b.net/p/",)], "canonical string")
    got = {r.page_id: r for r in url_filters.filter_pages(pages, rules, listed).collect()}
    assert url_filters.filter_pages(pages, rules, listed).count() == len(urls)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [(got[i].host, got[i].rule) for i in (2, 3, 8)] == [("", None)] * 3
    assert got[4].rule is None and got[4].path == ""
    assert got[5].rule == "org/" and got[6].verdict == "block"
    assert got[7].verdict == "block" and got[7].listed
    assert url_filters.filter_pages(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filters.filter_pages(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom, n = url_filters.build_filter(keys, "k")
    assert url_filters.possible_hits(keys, "k", bloom, n).count() == 3000
    other = spark.range(20000).select(F.concat(F.lit("z"), "id").alias("k"))
    assert url_filters.possible_hits(other, "k", bloom, n).count() < 1000


# 2: TIFF


@pytest.mark.parametrize("size", [0, 1, 2, 63, 64, 5000, 70_000])
@pytest.mark.parametrize("kind", ["text", "runs", "noise"])
def test_codecs_round_trip(size, kind):
    rng = np.random.default_rng(size)
    data = {"text": b"the cat sat on the mat, again. " * (size // 31 + 1), "runs": b"a" * size, "noise": rng.integers(0, 256, size, dtype=np.uint8).tobytes()}[kind][:size]
    assert tiff.packbits_decode(tiff.packbits_encode(data), size) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(spark, compression, tiled, predictor):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, (37, 21), dtype=np.uint8), rng.integers(0, 255, (300, 64, 3), dtype=np.uint8)]
    data = tiff.write_tiff(pages, compression, tiled, predictor, rows_per_strip=64)
    rows = tiff.read_pages(spark.createDataFrame([(1, data), (2, None), (3, b"junk"), (4, data[:100])], "page_no_key long, media binary")).collect()
    good = [r for r in rows if r.page_no_key == 1]
    assert [(r.page_no, r.width, r.height, r.samples) for r in good] == [(0, 21, 37, 1), (1, 64, 300, 3)]
    assert [bytes(r.pixels) for r in good] == [p.tobytes() for p in pages]
    assert all(r.error for r in rows if r.page_no_key in (3, 4)) and not [r for r in rows if r.page_no_key == 2]


def test_big_endian_and_cycles():
    head = b"MM\0*" + struct.pack(">I", 8)
    tags = [(256, 3, 2), (257, 3, 1), (258, 3, 16), (259, 3, 1), (273, 4, 100), (277, 3, 1), (279, 4, 4)]
    body = struct.pack(">H", len(tags))
    for t, k, v in tags:
        body += struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v))
    data = (head + body + struct.pack(">I", 8)).ljust(100, b"\0") + struct.pack(">HH", 7, 300)
    found = list(tiff.directories(data))
    assert len(found) == 1 and tiff.decode_page(data, found[0]).ravel().tolist() == [7, 300]


def test_op2_matches_hashlib(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["op2_tiff"](spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-64:])


def test_op2_odd_texts(spark):
    rows = tiff.read_pages(tiff.store_texts(docs(spark))).collect()
    assert len(rows) == len(ODD) and not any(r.error for r in rows)
    assert {len(r.pixels) for r in rows if r.n_bytes == 0} == {64}


# 3: language ID


def test_language_held_out(spark):
    rows = [(r.lang, r.lang_pred) for r in registry.QUERIES["op3_langid"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()]
    assert sum(a == b for a, b in rows) > 0.97 * len(rows)


def test_spans_of_mixed_text(spark):
    train = spark.createDataFrame([("the cat and the dog were here with that thing " * 20, "en"), ("der hund und die katze sind nicht schön gewesen " * 20, "de"), ("это просто русский текст для проверки " * 20, "ru")], "text string, lang string")
    model = langid.train(train)
    text = "the cat and the dog were here, der hund und die katze sind, это просто русский"
    out = langid.label_texts([text, None, "", "123 !!", "漢字", "x " * 3000], model)
    assert [s["lang"] for s in out["spans"][0]] == ["en", "de", "ru"]
    assert text[out["spans"][0][2]["begin"] : out["spans"][0][2]["end"]] == "это просто русский"
    assert out["lang_pred"].tolist()[1:4] == ["und"] * 3 and out["lang_pred"][4] in ("en", "de", "ru") and out["score"][4] == 0
    assert langid.label_texts(["words"], langid.train(train.limit(0)))["lang_pred"][0] == "und"


def test_mixed_and_unlabelled_documents_are_kept(spark):
    own = {k: " ".join(f"{k}{x}{k}{y}" for x in "aeiou" for y in "aeiou") for k in ("b", "d", "f")}
    rows = [(i, own[k] + " " + own[k], k) for k in own for i in range(5)]
    odd = [(100, " ".join(own.values()), None), (101, own["b"] + " " + "слово " * 60, None), (102, "123 ...", None), (103, None, None), (104, "漢字", None)]
    columns = "doc_id long, text string, lang string"
    kept = langid.keep_identified(docs(spark, rows + odd, columns))
    assert {r.doc_id for r in kept.where("doc_id >= 100").collect()} == {100, 101} and kept.count() == 17
    assert {r.doc_id for r in langid.keep_identified(docs(spark, [(i, t, None) for i, t, _ in odd], columns)).collect()} == {100, 101, 104}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 5, 1])
    s = rng.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
    got, at = langid.viterbi(s, counts, 2.0), 0
    for n in counts:
        cost = lambda p: sum(s[at + i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if n:
            assert cost(tuple(got[at : at + n])) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=int(n)))), abs=1e-4)
        at += n


# 4: HTML


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b\n c<p>d<br>e", "a & b c d e"),
        ("<nav><a>menu</a></nav><article><h1>T</h1><p>x<b>y</b>z</p><aside>side</aside><div class='comments'><p>no</p></div></article><footer>f</footer>", "T xyz"),
        ("<body><div id=cookie-notice>ok?</div><p>text<script>var x='</p>'</script><form>f<input></form></body>", "text"),
        ("<p>1 < 2 <!-- gone -->and &#x41;&eacute;", "1 < 2 and Aé"),
        ("<ul><li>a<li>b</ul><div hidden>no</div><p style='display: none'>no</p>", "a b"),
        # A name may say what the page has; a wrapper named like a side block holds the article.
        ("<body class='home no-sidebar'><article class='post comments-open'><p>the text</p></article></body>", "the text"),
        ("<div class='sidebar-layout'><div class='discussion'><p>all of the text</p></div></div>", "all of the text"),
        ("<div class='with-menu'><div class='nav'><a>m</a></div><article><p>text</p></article></div>", "text"),
        ("<div class='sidebar'><article>teaser</article></div><article><p>a much longer text</p></article>", "a much longer text"),
        # One teaser in an article element beside the text.
        ("<article class='card'><p>read this</p></article><div><p>the main text, which is much longer than that</p></div>", "read this the main text, which is much longer than that"),
        ("<article><p>short</p></article><div class='comments'><p>a comment that is much longer than the article</p></div>", "short"),
        ("<article><p>text</p><section id='comments'><article class='comment'>one more</article></section><div class='related'><a>r</a></div></article>", "text"),
        ("<form id='aspnetForm'><div><article><p>text</p></article></div><form>f</form></form>", "text"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
        ("<div class='top-story'><p>the story</p></div><div class='top'>x</div>", "the story"),
    ],
)
def test_content(html, want):
    assert html_extract.content(html_extract.parse(html or ""), set()) == want


def test_template_is_removed_but_copies_stay(spark):
    page = lambda i, n: f"<body><div><span>Always here</span></div><div><p>story {i}</p><p>more {n}</p></div></body>"
    rows = [(i, "http://h.com/x", page(i, i % 7)) for i in range(12)] + [(100 + i, "http://g.com/x", page(1, 1)) for i in range(12)] + [(200, None, "<p>z</p>"), (201, "http://h.com/y", None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 more 3" and got[100] == "Always here story 1 more 1" and got[200] == "z" and got[201] == ""


def test_constant_headings_of_an_article_stay(spark):
    page = lambda i: f"<body><div>Site name</div><article class='post-{i}'><h2>Summary</h2><p>text {i}</p></article></body>"
    rows = [(i, "http://h.com/x", page(i)) for i in range(6)] + [(10 + i, "http://few.com/", f"<div>Site name</div><p>text {i}</p>") for i in range(3)] + [(20 + i, "http://two.com/", f"<div>Site name</div><p>text {i}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Summary text 3" and got[11] == "text 1" and got[21] == "Site name text 1"
    whole = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=2)
    assert {r.page_id: r.text for r in whole.collect()}[21] == "text 1"


def test_extraction_against_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        layout = "<div class='w{0}'><ul><li>home<li>news</ul></div><div><h1>t{0}</h1>{1}</div><div>About us</div>" if i % 3 else "<div><p>News</p></div><article><h2>Intro</h2>{1}</article><div>About us</div>"
        text = "".join(f"<p>w{x}</p>" for x in rng.integers(0, 9, rng.integers(1, 5)))
        rows.append((i, f"http://h{i % 7}.org/{i}", layout.format(i, text)))
    rows += [rows[5], rows[6], (300, "http://h1.org/", None), (301, None, "<p>x</p>"), (302, "http://h1.org/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())

    key = {r.html: r.h for r in df.selectExpr("html", "xxhash64(html) as h").collect()}
    hosts = {}
    for _, url, source in rows:
        if url and source:
            hosts.setdefault(url.split("/")[2], set()).add(source)
    want, wrappers = [], {}
    for host, sources in hosts.items():
        ref = html_extract.parse(min(sources, key=key.get))
        own, seen = ref.own(), {}
        for source in sources:
            page = html_extract.parse(source)
            equal = {j: i for i, j in html_extract.align(ref, page) if own[i] and own[i] == page.own()[j]}
            slots = tuple(t for j, t in enumerate(page.own()) if t and j not in equal)
            for i in (-1, *equal.values()):
                seen.setdefault(i, set()).add(slots)
        least = max(0.6 * len(seen[-1]), 3)
        wrappers[host] = ref, {i for i, s in seen.items() if i >= 0 and len(s) >= least}
    for page_id, url, source in rows:
        page, template = html_extract.parse(source or ""), set()
        if url:
            ref, constant = wrappers[url.split("/")[2]]
            template = {j for i, j in html_extract.align(ref, page) if i in constant and ref.own()[i] == page.own()[j]}
        text = html_extract.content(page, template)
        want.append((page_id, text, len(text)))
    assert got == sorted(want)
    assert not any("About us" in t for i, t, _ in got if i < 300)


def test_alignment_of_long_rows_is_bounded():
    rows = "".join(f"<p>{i}</p><div><b>{i}</b></div>" for i in range(3000))
    a, b = html_extract.parse(rows), html_extract.parse("<h1>x</h1>" + rows)
    assert len(html_extract.align(a, b)) == 1 + 3000 * 3


def test_alignment_is_a_largest_match():
    rng = np.random.default_rng(1)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choice(["div", "section"], rng.integers(0, 4)))

    def best(a, i, b, j):
        p, q = a.children[i], b.children[j]
        most = 0
        for k in range(min(len(p), len(q)) + 1):
            for u in itertools.combinations(p, k):
                for v in itertools.combinations(q, k):
                    if all(a.label[x] == b.label[y] for x, y in zip(u, v, strict=True)):
                        most = max(most, sum(best(a, x, b, y) for x, y in zip(u, v, strict=True)))
        return 1 + most

    for _ in range(30):
        a, b = html_extract.parse(tree(2)), html_extract.parse(tree(2))
        assert len(html_extract.align(a, b)) == best(a, 0, b, 0)


def test_alignment_is_largest_in_long_rows_too():
    # More than 250,000 pairs of children: a heading that moved down leaves out no paragraph, and what is below counts.
    p, long = "<p></p>", "<p><b></b><i></i></p>"
    a, b = html_extract.parse("<h2></h2>" + p * 600), html_extract.parse(p * 50 + "<h2></h2>" + p * 550)
    assert len(html_extract.align(a, b)) == 1 + 600
    a, b = html_extract.parse(p + "<h1></h1>" + long * 600), html_extract.parse(long * 600 + "<h1></h1>" + p)
    assert len(html_extract.align(a, b)) == 1 + 3 * 600


def test_extraction_of_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_alignment_counts_best_match():
    a, b = html_extract.parse("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), html_extract.parse("<div><p>1</p><p>2</p></div><div>q</div>")
    assert len(html_extract.align(a, b)) == 4


# 5: mixing


def test_exponent_meets_the_target():
    t = np.array([1e6, 1e5, 1e4, 1e3])
    a, w = mixing.solve(t, mixing.MixConfig(entropy=0.9, max_repeats=1e9))
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(4), abs=1e-6) and 0 < a < 1
    _, w = mixing.solve(t, mixing.MixConfig(entropy=0.99, max_repeats=4))
    assert (t.sum() * w / t).max() <= 4 + 1e-6


def mixed_docs(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}", "w " * (1 + i % 50)) for i in range(3000)] + [(5000, None, "a b"), (5001, "s0", None), (5002, "s0", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_schedule_meets_weights(spark):
    cfg = mixing.MixConfig(block_tokens=2000)
    out = mixing.schedule(mixed_docs(spark), cfg).toPandas()
    total = 3000 // 50 * sum(range(1, 51)) + 2
    for _, part in out.groupby("source"):
        assert abs(part["tokens"].sum() - part["weight"].iloc[0] * total) < 60 * (part["block"].max() + 1)
    assert out.groupby("doc_id")["pass_no"].nunique().max() <= 5
    same = mixing.schedule(mixed_docs(spark).repartition(7), cfg).toPandas()
    key = ["doc_id", "pass_no", "position", "block"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, same[key].to_numpy().tolist()))


def test_mix_emits_what_the_schedule_says(spark):
    cfg = mixing.MixConfig(block_tokens=2000)
    d = mixed_docs(spark).withColumn("tokens", F.lit("clash"))
    want = Counter(r.doc_id for r in mixing.schedule(d, cfg).collect())
    got = mixing.mix(d, cfg)
    assert got.columns == d.columns and Counter(r.doc_id for r in got.collect()) == want
    assert mixing.mix(d.limit(0), cfg).count() == 0 and mixing.schedule(d.limit(0), cfg).count() == 0


# 6: top-k


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "CHUNK", 16)
    rng = np.random.default_rng(5)
    m = rng.normal(0, 1, (500, 8)) * rng.lognormal(0, 1, (500, 1))
    m[::7] = m[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0, None]), (902, [math.nan] * 8), (903, [math.inf] * 8), (None, [1.0] * 8), (950, []), (951, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(df.where("vec_id % 50 = 0"), df).collect()}
    ints = {i: np.floor(np.array((v + [0.0] * 8)[:8]) * 256).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in ints if i % 50 == 0]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk_search.top_k(df.limit(0), df).count() == 0 and topk_search.top_k(df.where("vec_id = 900"), df).count() == 0


@pytest.mark.parametrize("send", [1 << 26, 0])
def test_topk_sends_queries_and_not_their_copies(spark, monkeypatch, send):
    """Packs go to every task once, not a copy for each block; too many of them are joined by a shuffle, and a task then holds one at a time."""
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "PACK", 4)
    monkeypatch.setattr(topk_search, "SEND", send)
    rng = np.random.default_rng(6)
    v = {i: np.floor(256 * x / np.linalg.norm(x)) for i, x in enumerate(rng.normal(0, 1, (700, 8)))}
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    found = topk_search.top_k(df.where("vec_id % 50 = 0"), df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastNestedLoopJoin" in plan) == bool(send)
    want = {(q, r + 1, i, -s) for q in v if q % 50 == 0 for r, (s, i) in enumerate(sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5])}
    assert set(map(tuple, found.collect())) == want



# 7: LM scoring


def test_lm_against_counts(spark):
    rows = [(i, " ".join(f"W{(i * j) % 17}" for j in range(1, 40))) for i in range(60)] + ODD + [(99, "unseen words é")]
    d = docs(spark, rows)
    train = d.where("doc_id % 3 = 0")
    got = lm_scoring.score(d, lm_scoring.fit(train), ["doc_id"]).collect()
    words = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if i is not None and i % 3 == 0 for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    want = Counter((i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(base(t), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_without_training_texts(spark):
    d = docs(spark)
    assert {(r.base_score, r.score, r.train_tokens) for r in lm_scoring.score(d, lm_scoring.fit(d.limit(0)), ["doc_id"]).collect()} == {(0.0, 0.0, 0)}


def plain_log10(vocab, params, t):
    """The score of one text by loops over all items: no batches, no classes sorted."""
    r, m1, m2, b, q, bq = (p.astype(np.float64) for p in params)
    hashes, _ = common.word_hashes([(t or "").encode()])
    known = {int(h): (int(c), int(i)) for h, c, i in zip(vocab.words, vocab.counts, vocab.item, strict=True)}
    before, total = [vocab.end, vocab.end], 0.0
    for h in [*hashes.tolist(), None]:
        c, item = known.get(h, (0, -1)) if h is not None else (None, vocab.end)
        share = 0.0
        if item < 0:
            bucket = (h if h < 2**63 else h - 2**64) % lm_scoring.BUCKETS
            item, share = int(vocab.bucket_item[bucket]), math.log((c + 0.1) / vocab.bucket_mass[bucket])
        ctx = r[before[0]] @ m1 + r[before[1]] @ m2
        k = item // lm_scoring.GROUP
        inside = np.arange(k * lm_scoring.GROUP, min((k + 1) * lm_scoring.GROUP, vocab.n_items))
        of_class = np.exp([ctx @ q[j] + bq[j] for j in range(len(q))])
        of_item = np.exp([ctx @ r[j] + b[j] for j in inside])
        total += math.log(of_class[k] / of_class.sum()) + math.log(of_item[item - inside[0]] / of_item.sum()) + share
        before = [item, before[0]]
    return total / math.log(10)


def test_lm_against_loops(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 9)
    rows = [(i, " ".join(f"W{(i * j) % 23}" for j in range(1, 12))) for i in range(40)] + ODD + [(99, "unseen words é")]
    d = docs(spark, rows)
    model = lm_scoring.fit(d.where("doc_id < 30"))
    assert 0 < (model[1].item >= 0).sum() <= 9 and (model[1].item < 0).any()
    for r in lm_scoring.score(d, model, ["doc_id", "text"]).collect():
        assert r.score == pytest.approx(plain_log10(model[1], model[2], r.text), rel=1e-4, abs=1e-4)


def test_lm_parameters_do_not_depend_on_partitions(spark):
    d = docs(spark, [(i, " ".join(f"W{(i * j) % 23}" for j in range(1, 12))) for i in range(200)])
    one, other = lm_scoring.fit(d.repartition(1)), lm_scoring.fit(d.repartition(7))
    assert all((x == y).all() for x, y in zip(one[2], other[2], strict=True))


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n, d, k = 300, lm_scoring.DIM, 3
    params = [rng.normal(0, 0.5, s).astype(np.float32) for s in ((n, d), (d, d), (d, d), (n,), (k, d), (k,))]
    w = np.arange(n)
    assert np.exp(lm_scoring.Scorer(params)(w, np.full_like(w, 3), np.full_like(w, 9)).astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("most", [0, 1, 3, 10, 1000])
def test_least_count(spark, most):
    values = [1] * 50 + [2] * 7 + [3, 3, 900, 10**12]
    counts = spark.createDataFrame([(i, c) for i, c in enumerate(values)], "word long, c long")
    got = lm_scoring.least_count(counts, most)
    assert sum(c >= got for c in values) <= most
    assert got <= 1 or sum(c >= got - 1 for c in values) > most


def test_hash_index():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(200, dtype=np.uint64)]))
    index = common.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.arange(200, 400, dtype=np.uint64)) == -1).all()
    assert common.HashIndex(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


def test_lm_beats_counts_on_held_out(spark):
    r = registry.QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# 8: SentencePiece sampling


@pytest.fixture(scope="module")
def lattice():
    return spm_sampling.Lattice(spm_sampling.load(spm_sampling.read_model(spm_sampling.DEFAULT_MODEL), 1.0))


def all_segmentations(p, text):
    ids = {t.replace(b" ", b"\xe2\x96\x81").decode(): i for i, t in enumerate(p.raw) if p.weight[i] > 0 and i != p.unk}
    s, out = spm_sampling.MARK + text.replace(" ", spm_sampling.MARK), {}

    def go(at, acc, w):
        if at == len(s):
            out[tuple(acc)] = w
            return
        for n in range(1, min(16, len(s) - at) + 1):
            piece = s[at : at + n]
            if piece in ids:
                go(at + n, [*acc, ids[piece]], w * p.weight[ids[piece]])
            elif n == 1:
                go(at + 1, [*acc, *(int(p.byte[b]) for b in piece.encode())], w * p.weight[p.unk])

    go(0, [], 1.0)
    z = sum(out.values())
    return {k: v / z for k, v in out.items()}


@pytest.mark.parametrize("text", ["at on", "ab", "x\ny", "é☃"])
def test_samples_follow_the_law(lattice, text):
    p, n, k = lattice.pieces, 4000, 3
    want = all_segmentations(p, text)
    drawn, after = spm_sampling.sample(lattice, [text] * n, np.arange(n), k)
    first = Counter()
    estimate = 0.0
    for d, t in zip(drawn, after, strict=True):
        got = [tuple(spm_sampling.piece_ids(p, lattice, x).tolist()) for x in d]
        assert len(set(got)) == len(got) == min(k, len(want))
        for g, x in zip(got, d, strict=True):
            assert math.exp(x.log_prob) == pytest.approx(want[g], rel=1e-6)
        first[got[0]] += 1
        estimate += sum(math.exp(x.log_prob) / -math.expm1(-math.exp(min(x.log_prob + t, 700))) for x in d)
    assert max(abs(first[g] / n - q) for g, q in want.items()) < 0.04
    assert estimate / n == pytest.approx(1, abs=0.05)


def test_a_faint_segmentation_is_still_drawn():
    pieces = spm_sampling.Pieces(spm_sampling.read_model(spm_sampling.DEFAULT_MODEL), 12.0)
    lattice = spm_sampling.Lattice(pieces)
    want = all_segmentations(pieces, "at on")
    assert sorted(want.values())[-2] < 1e-15
    drawn, after = spm_sampling.sample(lattice, ["at on"] * 50, np.arange(50), 3)
    for d in drawn:
        got = [tuple(spm_sampling.piece_ids(pieces, lattice, x).tolist()) for x in d]
        assert len(set(got)) == 3
        assert all(x.log_prob == pytest.approx(math.log(want[g]), rel=1e-9, abs=1e-12) for g, x in zip(got, d, strict=True))
    assert np.isfinite(after).all()


def test_spm_round_trip_and_seeds(spark):
    rows = [*ODD, (10, "  two  spaces \n\n é ☃ \U0001f600 end "), (11, "a" * 5000)]
    d = docs(spark, rows).withColumn("ids", F.lit("clash")).withColumn("was", F.coalesce("text", F.lit("")))
    coded = spm_sampling.encode(d.drop("ids"), "doc_id", ["doc_id", "was"])
    back = spm_sampling.decode(coded, ["doc_id", "was", "rank", "log_prob", "log_inclusion"]).collect()
    assert all(r.decoded == r.was for r in back)
    assert all(r.log_prob <= 1e-9 and r.log_inclusion <= 1e-9 for r in back)
    again = spm_sampling.encode(d.drop("ids").repartition(5), "doc_id", ["doc_id", "was"])
    key = lambda df: Counter((r.doc_id, r.rank, tuple(r.ids)) for r in df.collect())
    assert key(coded) == key(again)
    assert spm_sampling.encode(d.limit(0), "doc_id", ["doc_id"]).count() == 0


# 9: near duplicates


def brute_components(rows, words, num=80, den=100):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_brute_force(spark, words):
    rng = np.random.default_rng(words)
    rows, base = [], [f"w{x}" for x in rng.integers(0, 5000, 120)]
    for i in range(120):
        t = list(base) if i < 90 else [f"v{x}" for x in rng.integers(0, 60, 40)]
        for at in rng.integers(0, len(t), int(rng.integers(0, 12))):
            t[at] = f"x{rng.integers(0, 9999)}"
        rows.append((i * 3 + 1, " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, rows[0][1].upper()), (1005, "a b"), (1006, "b a"), (1007, "long " * 20000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), words).collect()}
    assert got == brute_components(rows, words)


def test_near_duplicates_odd_rows(spark):
    out = near_dedup.near_duplicates(docs(spark)).collect()
    assert len(out) == len(ODD) and all(r.kept for r in out if r.doc_id in (None, 2, 3, 4))
    assert [r.component_id for r in out if r.doc_id == 6] == [1, 1]
    assert near_dedup.near_duplicates(docs(spark).limit(0)).count() == 0
    kept = near_dedup.drop_near_duplicates(docs(spark).withColumn("rep", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "rep"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_drop_near_duplicates_by_row(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "un deux trois quatre cinq six sept")
    rows = [(7, a), (7, a), (7, a), (None, b), (None, b), (None, c), (9, c), (8, c), (None, None), (None, "")]
    kept = near_dedup.drop_near_duplicates(docs(spark, rows)).collect()
    assert Counter(map(tuple, kept)) == Counter([(7, a), (None, b), (8, c), (None, None), (None, "")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 150) for i in range(40)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(40)}, 150: 100}


def test_word_hashes_match_split():
    texts = [b"A b\x0bc  d", b"", b" ", "é É".encode(), b"same SAME"]
    h, n = common.word_hashes(texts)
    assert n.tolist() == [len(t.lower().split()) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in t.lower().split()})


# 10: chat


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "x\\<|im_end|>\n"), (1, 0, "user", None), (1, 2, "assistant", "\\<\\|<|"), (1, None, "sys\ntem", "s"), (2, 0, None, ""), (None, 0, "user", "n"), (1, 2, "assistant", "\\<\\|<|"), (3, 700, "user", "late"), (3, 1, "user", "early")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_format.format_chats(turns)
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chats.select("conv_id", chat_format.parse_chats(F.col("formatted")).alias("t")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert back[conv] == [(role, text) for _, role, text in own]
    assert chats.where("conv_id = 1").first().formatted.count("<|im_start|>assistant") == 1
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_urls_without_host_keep_their_path(spark):
    rows = [(1, "file:///etc/x?q"), (2, "http:///es/x"), (3, "http://a.org"), (4, None), (5, "no scheme"), (6, "http:///es/x"), (7, "x://e.org/" + "p" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([*url_filters.RULES, ("block", "e.org", "/" + "p" * 2500)], "action string, host string, path string")
    got = {r.page_id: r for r in url_filters.filter_pages(pages, rules, url_filters.recrawled(pages)).collect()}
    assert [(got[i].host, got[i].path) for i in range(1, 7)] == [("", "/etc/x"), ("", "/es/x"), ("a.org", ""), ("", ""), ("", ""), ("", "/es/x")]
    assert all(got[i].verdict == "allow" and not got[i].listed for i in range(1, 7))
    # Rules of any length are kept, and a rule's path needs a path to stand in.
    assert got[7].verdict == "block" and got[7].rule == "e.org/" + "p" * 2500
    assert got[3].rule is None


def test_letters_of_every_plane_and_marks_alone():
    model = {"langs": ["en"], "logp": np.zeros((1, langid.BUCKETS), np.float32), "allowed": np.ones((len(langid.SCRIPTS) + 1, 1), bool), "default": 0}
    out = langid.label_texts(["\U00030010\U00030011", "\u0301\u0302 \u0303", "", "e\u0301a \u0301 b"], model)
    assert out["lang_pred"].tolist() == ["en", "und", "und", "en"]
    assert out["score"].tolist() == [1.0, 0.0, 0.0, 1.0]
    assert out["spans"][3] == [{"begin": 0, "end": 7, "lang": "en"}]


def test_sources_of_blank_texts_keep_their_rows(spark):
    rows = [(i, "a", "x y z") for i in range(6)] + [(10, "blank", " "), (11, "blank", None), (12, None, ""), (3, "a", "x y z"), (3, "a", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.schedule(docs).collect()
    assert {r.doc_id for r in plan} >= {10, 11, 12}
    assert all(r.weight == 0 for r in plan if r.doc_id >= 10)
    mixed = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in plan)
    with pytest.raises(ValueError):
        mixing.solve(np.array([1.0, 2.0]), mixing.MixConfig(budget=5.0))


def test_vectors_that_are_all_empty_score_zero(spark):
    v = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    got = topk_search.top_k(v.where("vec_id = 0"), v).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0), (0, 2, 0), (0, 3, 0)]


def _retag(data, tag, value):
    at = struct.unpack_from("<I", data, 4)[0]
    out = bytearray(data)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        place = at + 2 + 12 * i
        if struct.unpack_from("<H", data, place)[0] == tag:
            struct.pack_into("<HHIHH", out, place, tag if value is not None else 65000, 3, 1, value or 0, 0)
    return bytes(out)


def test_layouts_that_are_not_read_are_errors(spark):
    page = np.arange(128, dtype=np.uint8).reshape(2, 64)
    good = tiff.write_tiff([page], tiff.DEFLATE, predictor=2)
    files = [(0, good), (1, _retag(good, 317, 3)), (2, _retag(good, 258, None)), (3, tiff.write_tiff([page], tiff.NONE))]
    plain = bytearray(files[3][1])
    plain[8 : 8 + 128] = bytes(plain[8 : 8 + 128]).translate(tiff.REVERSED)
    # Tag 262 of the plain file makes room for 266: the bits of each byte from last to first.
    at = struct.unpack_from("<I", plain, 4)[0]
    for i in range(struct.unpack_from("<H", plain, at)[0]):
        place = at + 2 + 12 * i
        if struct.unpack_from("<H", plain, place)[0] == 262:
            struct.pack_into("<HHIHH", plain, place, 266, 3, 1, 2, 0)
    files.append((4, bytes(plain)))
    got = {r.id: r for r in tiff.read_pages(spark.createDataFrame(files, "id int, media binary")).collect()}
    assert bytes(got[0].pixels) == page.tobytes() == bytes(got[4].pixels) == bytes(got[3].pixels)
    assert got[1].error == "predictor 3" and got[1].pixels is None
    assert got[2].error == "sample layout"
