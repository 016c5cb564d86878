"""Queries over federated search."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from shelfmark.operators import search as Q
from shelfmark.operators.catalogue import newest_files
from shelfmark.operators.index import Index, bm25
from shelfmark.plans.base import VIEWS, query
from shelfmark.plans.texts import STOP
from shelfmark.sources import tables as S
from shelfmark.sources.stored import settled, shared_folder, spread

#: Stored vectors are sent to every task up to this many bytes.
SENT_BYTES = 64 << 20
AS_OF = "2024-02-01 00:00:00"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def public(spark, sf):
    """Public files with their texts, dealt out to all cores."""
    return spread(S.read_summaries(spark, sf).where("NOT is_private"))


def line_chunks(spark, sf):
    """Chunks of public files: their lines."""
    s = public(spark, sf).select("collection", "user_id", "file_id", F.posexplode(F.split("raw_text", "\n")).alias("chunk_index", "text"))
    return s.where("length(text) > 0")


def chunk_index(spark, sf):
    return Index(spark, shared_folder(spark, "chunks"), ["file_id", "chunk_index"]).add(line_chunks(spark, sf), "text")


def file_index(spark, sf):
    """The index of whole files, for summaries and bodies: they are one text in these tables."""
    return Index(spark, shared_folder(spark, "files"), ["file_id"]).add(public(spark, sf), "summary")


def indexes(spark, sf):
    """Both indexes, built at the same time."""
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(lambda build: build(spark, sf), (chunk_index, file_index)))


def with_vectors(spark, sf):
    """The queries, some with a vector, the number of a vector for every chunk, dealt over files and chunks, and the stored vectors."""
    e = S.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = S.read_queries(spark, sf).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    # Each signal reads the queries, so they are written once.
    q = settled(q)
    size = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(16 + 8 * F.coalesce(F.size("embedding"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    c = line_chunks(spark, sf).drop("text").withColumn("vec_id", (F.col("file_id") * 31 + F.col("chunk_index")) % size.n)
    return q, c, F.broadcast(e) if size.bytes <= SENT_BYTES else e


def prepared(spark, sf):
    return Q.prepare_queries(S.read_queries(spark, sf))


KW = f"list_filter({TOK.format('query')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"
VIEWS["qk"] = f"SELECT query_id, user_id, query, list_distinct({KW}) AS kw, list_distinct(CASE WHEN len({KW}) > 0 THEN {KW} ELSE {TOK.format('query')} END) AS terms FROM queries"
VIEWS["line_chunks"] = "SELECT collection, user_id, file_id, i - 1 AS chunk_index, text FROM (SELECT collection, user_id, file_id, unnest(string_split(raw_text, chr(10))) AS text, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM summaries WHERE NOT is_private) WHERE length(text) > 0"
VIEWS["public"] = "SELECT * FROM summaries WHERE NOT is_private"
VIEWS["sig_full"] = "SELECT query_id, collection, file_id, row_number() OVER (PARTITION BY query_id, collection ORDER BY created_at DESC, file_id) AS rank FROM qk JOIN files USING (user_id) WHERE contains(lower(filename), lower(trim(query))) AND length(trim(query)) > 0 QUALIFY rank <= 10"
VIEWS["sig_tok"] = "SELECT query_id, collection, file_id, row_number() OVER (PARTITION BY query_id, collection ORDER BY m DESC, created_at DESC, file_id) AS rank FROM (SELECT *, len(list_filter(kw, lambda w: contains(lower(filename), w))) AS m FROM qk JOIN files USING (user_id)) WHERE m > 0 QUALIFY rank <= 20"


def bm25_views(name: str, source: str, field: str, extra: str = "0") -> None:
    """Views ``name`` (scores) and ``name_r`` (ranks over files)."""
    VIEWS[f"{name}_t"] = f"SELECT collection, user_id, file_id, {extra} AS chunk_index, {TOK.format(field)} AS toks FROM {source}"
    VIEWS[f"{name}_p"] = f"SELECT collection, user_id, file_id, chunk_index, term, count(*) AS tf FROM (SELECT *, unnest(toks) AS term FROM {name}_t) GROUP BY ALL"
    VIEWS[name] = f"""SELECT query_id, p.collection, p.user_id, p.file_id, p.chunk_index, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
FROM (SELECT query_id, user_id, unnest(terms) AS term FROM qk) q JOIN {name}_p p USING (user_id, term)
JOIN (SELECT collection, term, count(*) AS df FROM {name}_p GROUP BY ALL) d ON d.collection = p.collection AND d.term = q.term
JOIN (SELECT collection, file_id, chunk_index, len(toks) AS dl FROM {name}_t) l ON l.collection = p.collection AND l.file_id = p.file_id AND l.chunk_index = p.chunk_index
JOIN (SELECT collection, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM {name}_t GROUP BY 1) s ON s.collection = p.collection GROUP BY ALL HAVING round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) > 0"""
    VIEWS[f"{name}_r"] = rank_sql(name)


def rank_sql(source: str, where: str = "true") -> str:
    return f"""SELECT query_id, collection, file_id, chunk_index, row_number() OVER (PARTITION BY query_id, collection ORDER BY n) AS rank FROM (SELECT query_id, collection, file_id, min(n) AS n, arg_min(chunk_index, n) AS chunk_index FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, file_id, chunk_index) AS n FROM {source} WHERE {where}) WHERE n <= 20 GROUP BY ALL)"""


bm25_views("b_chunk", "line_chunks", "text", "chunk_index")
bm25_views("b_sum", "public", "summary")
bm25_views("b_raw", "public", "raw_text")
VIEWS["dense"] = """SELECT query_id, collection, s.user_id, file_id, chunk_index, round(list_inner_product(d, v) / (sqrt(list_inner_product(d, d)) * sqrt(list_inner_product(v, v)) + 1e-9), 6) AS dense
FROM line_chunks s JOIN (SELECT vec_id, embedding::DOUBLE[] AS d FROM embeddings) e ON e.vec_id = (s.file_id * 31 + s.chunk_index) % (SELECT count(*) FROM embeddings) JOIN queries q ON q.user_id = s.user_id JOIN (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings) x ON x.qid = q.query_id"""
VIEWS["hyb"] = """SELECT query_id, collection, user_id, file_id, chunk_index, round(0.5 * coalesce(CASE WHEN dense IS NULL THEN NULL WHEN max(dense) OVER w = min(dense) OVER w THEN 1 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END, 0)
 + 0.5 * coalesce(CASE WHEN score IS NULL THEN NULL WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 0), 6) AS score
FROM (SELECT query_id, collection, user_id, file_id, chunk_index, dense FROM dense) FULL JOIN (SELECT query_id, collection, user_id, file_id, chunk_index, score FROM b_chunk) USING (query_id, collection, user_id, file_id, chunk_index) WINDOW w AS (PARTITION BY query_id, collection)"""
VIEWS["hyb_r"] = rank_sql("hyb", "score > 0.55")
BASE = ["files", "summaries", "queries", "qk", "public"]
SIGNALS = ["line_chunks", "sig_full", "sig_tok", *[f"{b}{x}" for b in ("b_chunk", "b_sum", "b_raw") for x in ("_t", "_p", "", "_r")]]
HYBRID = ["dense", "hyb", "hyb_r"]
VIEWS["ranks"] = """SELECT query_id, file_id, signal, min(rank) AS rank, arg_min(chunk, rank) AS matched_chunk FROM (SELECT query_id, file_id, rank, 'filename:full' AS signal, NULL::BIGINT AS chunk FROM sig_full UNION ALL SELECT query_id, file_id, rank, 'filename:tokenized', NULL FROM sig_tok
 UNION ALL SELECT query_id, file_id, rank, 'chunk:bm25', chunk_index FROM b_chunk_r UNION ALL SELECT query_id, file_id, rank, 'summary:bm25', NULL FROM b_sum_r UNION ALL SELECT query_id, file_id, rank, 'raw_text:bm25', NULL FROM b_raw_r UNION ALL SELECT query_id, file_id, rank, 'chunk:hybrid', chunk_index FROM hyb_r) GROUP BY ALL"""
VIEWS["fused"] = "SELECT query_id, file_id, sum(CASE signal WHEN 'filename:full' THEN 3.0 WHEN 'chunk:hybrid' THEN 1.5 WHEN 'raw_text:bm25' THEN 1.5 ELSE 2.0 END::DOUBLE / (60 + rank)) AS base, string_agg(signal, '|' ORDER BY CASE signal WHEN 'filename:full' THEN 0 WHEN 'filename:tokenized' THEN 1 WHEN 'chunk:bm25' THEN 2 WHEN 'summary:bm25' THEN 3 WHEN 'chunk:hybrid' THEN 4 ELSE 5 END) AS matched_in, coalesce(max(CASE WHEN signal = 'chunk:bm25' THEN matched_chunk END), max(CASE WHEN signal = 'chunk:hybrid' THEN matched_chunk END)) AS matched_chunk FROM ranks GROUP BY ALL"
AGE = f"greatest(0.0, epoch(TIMESTAMP '{AS_OF}' - date_trunc('second', {{}})) / 86400)"
VIEWS["boosted"] = f"""SELECT query_id, f.file_id, f.collection, filename, filetype, created_at, base, matched_in, matched_chunk, round(base * (1 + 0.08 * exp(-{AGE.format('created_at')} / 30) + CASE WHEN coalesce(access_count, 0) > 0 THEN 0.12 * least(1.0, ln(1 + access_count) * exp(-{AGE.format('last_accessed_at')} / 14) / 3) ELSE 0 END), 6) AS score
FROM fused JOIN files f USING (file_id) LEFT JOIN access a ON a.file_id = f.file_id WHERE length(filename) > 0"""


@query("q1_query_preparation", "SELECT query_id, user_id, len(kw)::INTEGER AS n_keywords, len(terms)::INTEGER AS n_terms FROM qk", "queries", "qk")
def q1(spark, sf):
    from shelfmark.functions.text import tokens

    return prepared(spark, sf).select("query_id", "user_id", F.size("kw").alias("n_keywords"), F.size(F.array_distinct(tokens(F.col("bm25_query")))).alias("n_terms"))


@query("q2_postings", "SELECT collection, file_id, term, tf, len(toks)::INTEGER AS dl FROM b_sum_p JOIN b_sum_t USING (collection, user_id, file_id, chunk_index)", "summaries", "public", "b_sum_t", "b_sum_p")
def q2(spark, sf):
    return file_index(spark, sf).postings().where("bucket >= 0").select("collection", "file_id", "term", "tf", "dl")


@query("q3_signal_filename_full", "SELECT * FROM sig_full", *BASE, "sig_full")
def q3(spark, sf):
    return Q.sig_filename_full(prepared(spark, sf), S.read_files(spark, sf))


@query("q4_signal_filename_tokens", "SELECT * FROM sig_tok", *BASE, "sig_tok")
def q4(spark, sf):
    return Q.sig_filename_tokens(prepared(spark, sf), S.read_files(spark, sf))


@query("q5_bm25_summary", "SELECT query_id, collection, user_id, file_id, score FROM b_sum", *BASE, "b_sum_t", "b_sum_p", "b_sum")
def q5(spark, sf):
    return bm25(prepared(spark, sf), file_index(spark, sf))


@query("q5_bm25_chunks_w1", "SELECT query_id, collection, file_id, chunk_index, rank FROM b_chunk_r", *BASE, "line_chunks", "b_chunk_t", "b_chunk_p", "b_chunk", "b_chunk_r")
def q5b(spark, sf):
    hits = bm25(prepared(spark, sf), chunk_index(spark, sf))
    return Q.rank_files(hits, 20).select("query_id", "collection", "file_id", "chunk_index", "rank")


@query("q6_signal_hybrid", "SELECT query_id, collection, user_id, file_id, chunk_index, score FROM hyb WHERE score > 0.55", *BASE, "line_chunks", "b_chunk_t", "b_chunk_p", "b_chunk", *HYBRID[:-1])
def q6(spark, sf):
    q, v, held = with_vectors(spark, sf)
    index = chunk_index(spark, sf)
    return Q.hybrid(q, settled(bm25(Q.prepare_queries(q), index)), index.keys, v, held=held)


def signals(spark, sf):
    q, v, held = with_vectors(spark, sf)
    chunks, files = indexes(spark, sf)
    return Q.search_signals(q, S.read_files(spark, sf), chunks, files, files, v, held)


@query("q7_consolidation", "SELECT * FROM ranks", *BASE, *SIGNALS, *HYBRID, "ranks")
def q7(spark, sf):
    return Q.consolidate(signals(spark, sf))


@query("q8_weighted_rrf", "SELECT query_id, file_id, round(base, 6) AS base, matched_in FROM fused", *BASE, *SIGNALS, *HYBRID, "ranks", "fused")
def q8(spark, sf):
    return Q.rrf(Q.consolidate(signals(spark, sf))).select("query_id", "file_id", F.round("base", 6).alias("base"), F.array_join("matched_in", "|").alias("matched_in"))


def searched(spark, sf, search=Q.federated_search):
    q, v, held = with_vectors(spark, sf)
    chunks, files = indexes(spark, sf)
    return search(q, S.read_files(spark, sf), chunks, files, files, S.read_access(spark, sf), as_of(), v, line_chunks(spark, sf), held=held)


SEARCH_SQL = "SELECT b.*, text AS matched_text FROM (SELECT query_id, file_id, collection, filename, filetype, created_at, score, matched_in, matched_chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM boosted QUALIFY rank <= 30) b LEFT JOIN line_chunks c ON c.file_id = b.file_id AND c.chunk_index = b.matched_chunk"


@query("q12_federated_search", SEARCH_SQL, *BASE, "ev", "access", *SIGNALS, *HYBRID, "ranks", "fused", "boosted")
def q12(spark, sf):
    return searched(spark, sf).select("query_id", "file_id", "collection", "filename", "filetype", "created_at", "score", F.array_join("matched_in", "|").alias("matched_in"), "matched_chunk", "matched_text", "rank")


@query("q11_mmr_diversity")
def q11(spark, sf):
    return searched(spark, sf, Q.diverse_search).withColumn("matched_in", F.array_join("matched_in", "|"))


@query("q13_recent_uploads", "WITH t AS (SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY user_id, collection ORDER BY created_at DESC, file_id) <= 50) SELECT user_id, file_id, collection, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) AS pos FROM t", "summaries")
def q13(spark, sf):
    return newest_files(S.read_summaries(spark, sf)).select("user_id", "file_id", "collection", "pos")


#: Questions about one file: every vector asks for the chunks of its file that are nearest to it.
VIEWS["fileq"] = "SELECT vec_id AS query_id, file_id, embedding::DOUBLE[] AS v FROM chunks"
FILE_HITS = "SELECT query_id, chunk_index, round(list_inner_product(v, e) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(e, e)) + 1e-9), 6) AS score FROM fileq q JOIN (SELECT file_id, chunk_index, embedding::DOUBLE[] AS e FROM chunks) c USING (file_id)"
VIEWS["file_hits"] = FILE_HITS


def owned_chunks(spark, sf):
    """Chunk vectors with their tenant."""
    return S.read_chunks(spark, sf).withColumn("user_id", F.col("file_id") % 20)


def file_questions(spark, sf):
    return owned_chunks(spark, sf).select(F.col("vec_id").alias("query_id"), "user_id", "file_id", F.col("embedding").alias("query_vector"))


@query("q14_file_scoped", "SELECT query_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM file_hits QUALIFY rank <= 6", "chunks", "fileq", "file_hits")
def q14(spark, sf):
    from shelfmark.operators.retrieval import vector_scores

    return Q.top_k(vector_scores(file_questions(spark, sf), owned_chunks(spark, sf)), ["query_id"], [F.desc("score"), F.col("chunk_index")], 6)
