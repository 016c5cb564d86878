"""Queries over structural chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import sentences
from shelfmark.operators import chunking as C
from shelfmark.plans.base import VIEWS, query
from shelfmark.sources import tables as S


def md_docs(spark, sf):
    d = S.read_table(spark, sf, "documents")
    parts = [F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n## "), "lang", F.lit("\n\n| key | value |\n|---|---|\n| id | "), F.col("doc_id").cast("string"), F.lit(" |\n\n- one\n- two\n- three\n\n```\nx = "), F.col("n_chars").cast("string"), F.lit("\n```")]
    return d.select("doc_id", F.concat(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("text"))


VIEWS["md"] = "SELECT doc_id, concat('# ', source, chr(10), chr(10), text, chr(10), chr(10), '## ', lang, chr(10), chr(10), '| key | value |', chr(10), '|---|---|', chr(10), '| id | ', doc_id, ' |', chr(10), chr(10), '- one', chr(10), '- two', chr(10), '- three', chr(10), chr(10), '```', chr(10), 'x = ', n_chars, chr(10), '```') AS text FROM documents"
VIEWS["ls"] = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM md"
VIEWS["lk"] = r"""SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^(#{1,6})\s+(.+?)\s*$') THEN 'heading' WHEN starts_with(ltrim(line), '|') THEN 'table' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind,
 CASE WHEN fence OR fences % 2 = 1 THEN (fences + 1) // 2 END AS fno FROM (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(starts_with(ltrim(line), '```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM ls)"""
VIEWS["bl"] = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_no, CASE WHEN kind <> 'text' THEN kind WHEN nl >= greatest(2, (n * 4) // 5) THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^(#+)', 1)) END AS level, text FROM
 (SELECT doc_id, island, kind, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text, count(*) AS n, count(*) FILTER (regexp_matches(line, '^\s*(\d+\.|[-*+])\s+')) AS nl FROM
 (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind OR kind = 'heading' OR lag(fno) OVER w IS DISTINCT FROM fno AS new FROM lk WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) WHERE kind <> 'blank' GROUP BY ALL) WHERE text <> ''"""
MD = ["md", "ls", "lk", "bl"]


@query("w6_fence_parity", "SELECT doc_id, pos, kind FROM lk", "md", "ls", "lk")
def w6(spark, sf):
    return C.lines_of(md_docs(spark, sf)).select("doc_id", "pos", "kind")


@query("c1_block_parse", "SELECT * FROM bl", *MD)
def c1(spark, sf):
    return C.parse_blocks(md_docs(spark, sf))


@query("w8_block_boundaries", "SELECT doc_id, block_no, kind = 'heading' OR coalesce(p <> kind AND (kind IN ('code','table') OR p IN ('code','table')), false) AS boundary FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY block_no) AS p FROM bl)", *MD)
def w8(spark, sf):
    return C.block_boundaries(C.parse_blocks(md_docs(spark, sf))).select("doc_id", "block_no", "boundary")


@query("w7_heading_paths", "SELECT doc_id, block_no, CASE WHEN h2 > h1 THEN t1 || ' > ' || t2 ELSE t1 END AS path FROM (SELECT doc_id, block_no, max(CASE WHEN level = 1 THEN block_no END) OVER w AS h1, coalesce(max(CASE WHEN level = 2 THEN block_no END) OVER w, -1) AS h2, last_value(CASE WHEN level = 1 THEN trim(ltrim(text, '#')) END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN trim(ltrim(text, '#')) END IGNORE NULLS) OVER w AS t2 FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)) WHERE h1 IS NOT NULL", *MD)
def w7(spark, sf):
    return C.heading_paths(C.parse_blocks(md_docs(spark, sf))).select("doc_id", "block_no", F.array_join("path", " > ").alias("path"))


@query("c2_sections", "SELECT doc_id, section_no, bool_or(kind = 'table') AS has_table, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM (SELECT *, sum((kind = 'heading' AND level <= 2 AND block_no > 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_no) AS section_no FROM bl) GROUP BY ALL", *MD)
def c2(spark, sf):
    return C.sections(C.parse_blocks(md_docs(spark, sf))).drop("heading_path")


@query("c5_adaptive_budgets", r"SELECT doc_id, CASE WHEN c THEN 2000 WHEN s THEN 800 ELSE 1500 END::INTEGER AS parent_tokens, CASE WHEN c THEN 600 WHEN s THEN 250 ELSE 400 END::INTEGER AS child_tokens FROM (SELECT doc_id, len(string_split(text, '```')) - 1 >= 4 OR regexp_matches(text, '(?m)^\s{4,}') AS c, length(text) < 2000 AS s FROM md)", "md")
def c5(spark, sf):
    return C.budgets(md_docs(spark, sf)).select("doc_id", "parent_tokens", "child_tokens")


@query("c3_parents")
def c3(spark, sf):
    return C.chunk_documents(md_docs(spark, sf)).select("doc_id", "parent_index", "parent_text", "has_table").distinct()


@query("c6_hierarchical_chunks")
def c6(spark, sf):
    return C.chunk_documents(md_docs(spark, sf)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query("c7_flat_chunks")
def c7(spark, sf):
    return C.chunk_flat(md_docs(spark, sf))


#: Stored vectors are sent to every task up to this many bytes; beyond it the numbers of sentences meet them, and then sentences by document and place.
SENT_BYTES = 64 << 20


def sentence_vectors(spark, sf):
    """All sentences of documents, with the stored vectors in turn; a sentence whose vector is missing keeps a null one."""
    d = S.read_table(spark, sf, "documents").select("doc_id", "text")
    s = d.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    e = S.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    size = e.agg(F.coalesce(F.max("vec_id") + 1, F.lit(1)).alias("n"), F.sum(16 + 8 * F.coalesce(F.size("embedding"), F.lit(0))).alias("bytes")).first()
    numbered = lambda t: t.withColumn("vec_id", F.pmod(F.col("doc_id") * 7 + F.floor(F.col("pos") / 3), F.lit(size.n)))
    if (size.bytes or 0) <= SENT_BYTES:
        return numbered(s).join(F.broadcast(e), "vec_id", "left").drop("vec_id")
    keys = numbered(s.drop("sentence")).join(e, "vec_id").drop("vec_id")
    return s.join(keys, ["doc_id", "pos"], "left")


@query("c8_semantic_chunks")
def c8(spark, sf):
    return C.chunk_semantic(sentence_vectors(spark, sf))


def chunk_vectors(spark, sf, *columns):
    """The stored vectors' ``columns`` for the chunks of all documents, one vector for every 200 characters of a text; every thirteenth is missing."""
    e = S.read_table(spark, sf, "embeddings")
    d = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 200).cast("int"))).alias("chunk_index"))
    at = F.col("file_id") * 31 + F.col("chunk_index")
    return d.where(at % 13 != 0).withColumn("vec_id", at % e.count()).join(e.select("vec_id", *columns), "vec_id")


@query("c9_chunk_table")
def c9(spark, sf):
    """The summaries of every third file are missing, so the catalogue names those."""
    texts = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    v = chunk_vectors(spark, sf, F.size("embedding").alias("dim")).drop("vec_id")
    known = S.read_summaries(spark, sf).where("file_id % 3 != 0").select("user_id", "file_id", "collection", F.concat(F.lit("row of "), "filename").alias("filename"))
    return C.build_chunks(S.read_files(spark, sf), texts, v, summaries=known).drop("heading_path")


@query("t23_summary_plan", "SELECT doc_id, tokens::INTEGER AS tokens, least(n, 30)::INTEGER AS n_pieces, n > 30 AS truncated FROM (SELECT *, CASE WHEN tokens <= 1000 THEN 1 ELSE ceil(tokens / 200) END AS n FROM (SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents))")
def t23(spark, sf):
    return C.summary_plan(S.read_table(spark, sf, "documents").select("doc_id", "text"), 1000, 400)


@query("t23_summary_pieces")
def t23_pieces(spark, sf):
    return C.summary_pieces(md_docs(spark, sf), 1000, 400, 20)
