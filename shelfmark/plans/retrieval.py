"""Queries over question retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import chunking as C
from shelfmark.operators import retrieval as R
from shelfmark.plans import chunking, search
from shelfmark.plans.base import VIEWS, query
from shelfmark.sources import tables as S
from shelfmark.sources.stored import settled

BASE = ["chunks", "fileq", "file_hits"]
VIEWS["cand"] = "SELECT query_id, chunk_index, least(1.0, CASE WHEN query_id % 2 = 0 AND chunk_index % 2 = 0 THEN score * 1.15 + 0.05 ELSE score END) AS score FROM file_hits"
VIEWS["outside"] = "SELECT query_id, chunk_index, (chunk_index * 7 + query_id * 3) % 11 AS score FROM file_hits WHERE (chunk_index + query_id) % 13 <> 0"
VIEWS["reranked"] = """SELECT query_id, chunk_index, score, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, place) AS rank FROM (SELECT *, CASE WHEN n <= 3 OR count(o) OVER (PARTITION BY query_id) = 0 THEN score * 10 ELSE o END AS rerank
 FROM (SELECT c.query_id, c.chunk_index, c.score, o.score::DOUBLE AS o, row_number() OVER (PARTITION BY c.query_id ORDER BY c.score DESC, c.chunk_index) AS place, count(*) OVER (PARTITION BY c.query_id) AS n FROM cand c LEFT JOIN outside o USING (query_id, chunk_index))) WHERE rerank IS NOT NULL QUALIFY rank <= 3"""


def candidates(spark, sf):
    c = R.vector_scores(search.file_questions(spark, sf), search.owned_chunks(spark, sf))
    asks = F.when(F.col("query_id") % 2 == 0, "How many rows in total?").otherwise("Who wrote this?")
    return R.table_boost(c.withColumns({"question": asks, "has_table": F.col("chunk_index") % 2 == 0}))


def outside(spark, sf):
    c = candidates(spark, sf).where("(chunk_index + query_id) % 13 != 0")
    return c.select("query_id", "chunk_index", ((F.col("chunk_index") * 7 + F.col("query_id") * 3) % 11).alias("score"))


def reranked(spark, sf):
    return R.apply_rerank(candidates(spark, sf), outside(spark, sf), keep=3)


def passages(spark, sf):
    """Passing chunks with texts: the question's file marked by the chunk, and that text twice as their parent."""
    r = reranked(spark, sf).join(search.file_questions(spark, sf).select("query_id", "file_id"), "query_id")
    t = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    t = r.join(t, "file_id").where("rerank >= 4")
    chunk = F.concat("text", (F.col("chunk_index") % 2).cast("string"))
    return t.withColumn("chunk_text", chunk).withColumn("parent_text", F.when(F.col("chunk_index") % 3 == 0, F.concat("chunk_text", "chunk_text")))


VIEWS["blocks"] = """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, body, has_table FROM (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY rank) AS m FROM
 (SELECT query_id, rank, chunk_index % 2 = 0 AS has_table, CASE WHEN chunk_index % 3 = 0 THEN c || c ELSE c END AS body FROM (SELECT r.*, text || (chunk_index % 2) AS c FROM reranked r JOIN fileq USING (query_id) JOIN documents ON doc_id = file_id WHERE rerank >= 4))) WHERE m = 1"""
RERANK = [*BASE, "cand", "outside", "reranked"]


@query("r1_conversation_windows", "WITH t AS (SELECT * FROM conversations WHERE role IN ('user','assistant')), w AS (SELECT conv_id, turn, role, coalesce(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM t) SELECT conv_id, turn, context FROM w WHERE role = 'user'")
def r1(spark, sf):
    return R.conversation_context(S.read_table(spark, sf, "conversations"))


@query("r2_over_retrieve", "WITH v AS (SELECT query_id, file_id, 0 AS variant, v FROM fileq UNION ALL SELECT query_id, file_id, 1, list_transform(v, lambda x: -x) FROM fileq), h AS (SELECT query_id, variant, chunk_index, round(list_inner_product(v, e) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(e, e)) + 1e-9), 6) AS score FROM v JOIN (SELECT file_id, chunk_index, embedding::DOUBLE[] AS e FROM chunks) c USING (file_id) QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_index) <= 3) SELECT query_id, chunk_index, max(score) AS score FROM h GROUP BY ALL", "chunks", "fileq")
def r2(spark, sf):
    q = search.file_questions(spark, sf)
    v = q.withColumn("variant", F.lit(0)).unionByName(q.withColumns({"variant": F.lit(1), "query_vector": F.transform("query_vector", lambda x: -x)}))
    return R.over_retrieve(v, search.owned_chunks(spark, sf), 3)


@query("r3_table_boost", "SELECT query_id, chunk_index, score FROM cand", *BASE, "cand")
def r3(spark, sf):
    return candidates(spark, sf).select("query_id", "chunk_index", "score")


@query("r4_rerank", "SELECT query_id, chunk_index, round(rerank, 5) AS rerank, rank FROM reranked", *RERANK)
def r4(spark, sf):
    return reranked(spark, sf).select("query_id", "chunk_index", F.round("rerank", 5).alias("rerank"), "rank")


@query("r5_floor_and_refusal", "SELECT query_id, coalesce(count(*) FILTER (rerank >= 4), 0) AS n_passing, round(max(rerank), 5) AS top, coalesce(count(*) FILTER (rerank >= 4), 0) = 0 AS refused FROM fileq LEFT JOIN reranked USING (query_id) GROUP BY query_id", *RERANK)
def r5(spark, sf):
    return R.gate(search.file_questions(spark, sf), reranked(spark, sf)).withColumn("top", F.round("top", 5))


@query("r5_exposed_sources", "SELECT query_id, chunk_index FROM (SELECT *, max((rerank >= 4)::INTEGER) OVER (PARTITION BY query_id) AS p FROM reranked) WHERE (p = 1 AND rerank >= 4) OR (p = 0 AND rank <= 3)", *RERANK)
def r5b(spark, sf):
    return R.exposed(reranked(spark, sf)).select("query_id", "chunk_index")


@query("r6_parent_context", "SELECT query_id, max(n) AS n_blocks, string_agg('[Chunk ' || n || ']' || CASE WHEN has_table THEN ' (contains a table)' ELSE '' END || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM blocks GROUP BY query_id", *RERANK, "blocks")
def r6(spark, sf):
    return R.context_text(R.context_blocks(passages(spark, sf)))


def stored_chunks(spark, sf):
    """C9's chunks of all public files, marked up so that some hold tables, with parents and the numbers of their vectors."""
    texts = chunking.md_docs(spark, sf).withColumnRenamed("doc_id", "file_id")
    return C.build_chunks(S.read_files(spark, sf), texts, chunking.chunk_vectors(spark, sf))


#: Files whose chunks pass are sent to every task up to this many; beyond it all texts are shuffled to meet them.
FEW_FILES = 500_000


@query("r6_chunk_contexts")
def r6_chunks(spark, sf):
    """Retrieval on the chunk table to its end: J7, R3, R4, R6, U4; contexts are C6's chunks and parents."""
    chunks = settled(stored_chunks(spark, sf).select("user_id", "file_id", "chunk_index", "chunk_text", "parent_text", "has_table", "vec_id"))
    asked = search.file_questions(spark, sf)
    # Vectors join what is asked about, and texts only what passes the floor.
    met = chunks.select("user_id", "file_id", "chunk_index", "vec_id").join(asked.select("user_id", "file_id").distinct(), ["user_id", "file_id"], "left_semi")
    hits = R.vector_scores(asked, met.join(S.read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")).join(asked.select("query_id", "file_id"), "query_id")
    hits = hits.join(chunks.select("file_id", "chunk_index", "has_table"), ["file_id", "chunk_index"])
    asks = F.when(F.col("query_id") % 2 == 0, "How many rows in total?").otherwise("Who wrote this?")
    boosted = R.table_boost(hits.withColumn("question", asks))
    given = boosted.where("(chunk_index + query_id) % 13 != 0").select("query_id", "chunk_index", ((F.col("chunk_index") * 7 + F.col("query_id") * 3) % 11).alias("score"))
    best = settled(R.apply_rerank(boosted.select("query_id", "file_id", "chunk_index", "score"), given, keep=3).where("rerank >= 4"))
    files = best.select("file_id").distinct()
    shown = chunks.join(F.broadcast(files) if files.count() <= FEW_FILES else files, "file_id", "left_semi")
    passing = best.join(shown.select("file_id", "chunk_index", "chunk_text", "parent_text", "has_table"), ["file_id", "chunk_index"])
    return R.context_text(R.context_blocks(passing))


def answers(spark, sf):
    c = S.read_table(spark, sf, "conversations").where("role = 'assistant'")
    said = F.concat("text", F.lit(" [Chunk "), (1 + F.col("turn") % 4).cast("string"), F.lit("] [chunk 9] ."))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.regexp_replace(said, r"\s+", " ").alias("answer"), F.lit(3).alias("n_valid"), ((F.col("conv_id") + F.col("turn")) % 11).cast("double").alias("top"))


VIEWS["answers"] = r"SELECT conv_id * 100 + turn AS query_id, regexp_replace(text || ' [Chunk ' || (1 + turn % 4) || '] [chunk 9] .', '\s+', ' ', 'g') AS answer, 1 + turn % 4 AS c, ((conv_id + turn) % 11)::DOUBLE AS top FROM conversations WHERE role = 'assistant'"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(answer, '[chunk 9]', ''), '\[Chunk 4\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g'), ' {2,}', ' ', 'g'))"


@query("r7_citation_clean", f"SELECT query_id, {CLEAN} AS answer, CASE WHEN c = 4 THEN 2 ELSE 1 END AS removed FROM answers", "answers")
def r7(spark, sf):
    a = answers(spark, sf).withColumn("c", R.clean_citations(F.col("answer"), F.col("n_valid")))
    return a.select("query_id", "c.answer", "c.removed")


@query("r10_answer_table", f"SELECT query_id, CASE WHEN c = 4 THEN '{R.REFUSAL.replace(chr(39), chr(39) * 2)}' ELSE {CLEAN} END AS answer, CASE WHEN c = 4 THEN 2 ELSE 1 END AS removed, CASE WHEN c = 4 THEN 0 ELSE 1 END AS n_cited, c = 4 AS refused, CASE WHEN c = 4 THEN 'none' WHEN top >= 8 THEN 'high' WHEN top >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM answers", "answers")
def r10(spark, sf):
    return R.finalise_answers(answers(spark, sf))


@query("r9_confidence_counts", "SELECT CASE WHEN c = 4 THEN 'none' WHEN top >= 8 THEN 'high' WHEN top >= 6 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM answers GROUP BY 1", "answers")
def r9(spark, sf):
    return R.finalise_answers(answers(spark, sf)).groupBy("confidence").agg(F.count("*").alias("n"))
