"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import text as X
from shelfmark.operators import texts as O
from shelfmark.plans.base import query
from shelfmark.sources import tables as S
from shelfmark.sources.stored import shared_folder, spread

STOP = "[" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
#: SQL of the keyword list of a column ``query``: each word once, in order.
KEYWORDS_SQL = f"list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"


def docs(spark, sf):
    return S.read_table(spark, sf, "documents").select("doc_id", "text")


@query("a8_repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) BETWEEN 4 AND 120 GROUP BY ALL HAVING count(*) >= 3")
def a8(spark, sf):
    return O.boilerplate_lines(docs(spark, sf))


@query(
    "t8_boilerplate_strip",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, trim(line) AS t FROM l WHERE length(trim(line)) BETWEEN 4 AND 120 GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.t = trim(line) WHERE b.t IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k USING (doc_id)""",
)
def t8(spark, sf):
    return O.strip_boilerplate(docs(spark, sf))


@query("a9_unique_word_ratio", r"SELECT doc_id, round(len(list_distinct(w)) / len(w), 6) AS ratio FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '\S+'), 1, 200) AS w FROM documents) WHERE len(w) > 0")
def a9(spark, sf):
    w = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), 0), 1, 200)
    d = docs(spark, sf).select("doc_id", w.alias("w")).where("size(w) > 0")
    return d.select("doc_id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 6).alias("ratio"))


@query(
    "a10_corpus_statistics",
    r"""WITH t AS (SELECT collection, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents JOIN files ON file_id = doc_id),
c AS (SELECT collection, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM t GROUP BY 1), n AS (SELECT collection, count(*) AS n_docs FROM files GROUP BY 1)
SELECT collection, n_docs, n_tokens, n_terms, round(n_tokens / n_docs, 6) AS avg_len FROM n JOIN c USING (collection)""",
    "files",
)
def a10(spark, sf):
    from shelfmark.operators.index import Index

    d = spread(S.read_files(spark, sf, "text"))
    index = Index(spark, shared_folder(spark, "files"), ["file_id"]).add(d, "text")
    n = index.totals().join(index.frequencies().groupBy("collection").agg(F.count("*").alias("n_terms")), "collection")
    return n.select("collection", "n_docs", F.col("n_words").alias("n_tokens"), "n_terms", F.round(F.col("n_words") / F.col("n_docs"), 6).alias("avg_len"))


@query("t1_keywords", f"SELECT query_id, {KEYWORDS_SQL} AS kw FROM queries".replace("SELECT query_id, ", "SELECT query_id, array_to_string(list_transform(list_filter(list_zip(k, range(len(k))), lambda z: list_position(k, z[1]) = z[2] + 1), lambda z: z[1]), ' ') AS kw FROM (SELECT query_id, ").replace(" AS kw FROM queries", " AS k FROM queries)"), "queries")
def t1(spark, sf):
    return S.read_queries(spark, sf).select("query_id", F.array_join(X.keywords(F.col("query")), " ").alias("kw"))


@query("t2_token_count", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS n, substring(text, 1, 40) AS cut FROM documents")
def t2(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_count(F.col("text")).alias("n"), X.truncate_tokens(F.col("text"), 10).alias("cut"))


@query("t3_language_tag", r"SELECT doc_id, CASE WHEN length(regexp_replace(substring(text,1,2000), '[\x00-\x7F]', '', 'g')) > 0.1 * length(substring(text,1,2000)) THEN 'non-en' ELSE 'en' END AS tag FROM documents")
def t3(spark, sf):
    return docs(spark, sf).select("doc_id", X.language_tag(F.col("text")).alias("tag"))


@query(
    "t4_garbage_gate",
    r"""WITH w AS (SELECT doc_id, text, list_slice(regexp_extract_all(lower(text), '\S+'), 1, 200) AS w, substring(text,1,5000) AS h FROM documents)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 50 THEN 'too_short' WHEN length(regexp_replace(h, '[a-zA-Z0-9\s]', '', 'g')) / length(h) > 0.4 THEN 'high_symbol_ratio' WHEN len(w) >= 30 AND len(list_distinct(w)) / len(w) < 0.15 THEN 'low_unique_ratio' END AS reason FROM w""",
)
def t4(spark, sf):
    return docs(spark, sf).select("doc_id", X.quality_gate(F.col("text"))["reason"].alias("reason"))


def _hits(words):
    return " + ".join(f"contains(t, '{w}')::INTEGER" for w in words)


@query("t5_document_type", f"SELECT doc_id, CASE WHEN {_hits(X.LEGAL)} >= 2 THEN 'legal' WHEN {_hits(X.FINANCIAL)} >= 3 THEN 'financial' ELSE 'generic' END AS kind FROM (SELECT doc_id, lower(substring(CASE doc_id % 3 WHEN 0 THEN 'WHEREAS this agreement ' WHEN 1 THEN 'Revenue of the fiscal quarter ' ELSE '' END || text, 1, 2000)) AS t FROM documents)")
def t5(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, "WHEREAS this agreement ").when(F.col("doc_id") % 3 == 1, "Revenue of the fiscal quarter ").otherwise("")
    return docs(spark, sf).select("doc_id", X.doc_type(F.concat(head, "text")).alias("kind"))


@query("t6_redaction")
def t6(spark, sf):
    return X.redact(docs(spark, sf)).select("doc_id", "redacted", F.to_json("counts").alias("counts"))


@query("a11_redaction_emails", r"SELECT 'EMAIL' AS kind, sum(n)::BIGINT AS n_matches, count(*) AS n_texts FROM (SELECT len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS n FROM documents) WHERE n > 0")
def a11(spark, sf):
    return O.redaction_report(docs(spark, sf)).where("kind = 'EMAIL'")


@query("a11_redaction_counts")
def a11b(spark, sf):
    return O.redaction_report(docs(spark, sf))


@query(
    "t7_luhn",
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 -]*[0-9]')) AS number FROM documents), d AS (SELECT *, regexp_replace(number, '[^0-9]', '', 'g') AS d FROM m)
SELECT doc_id, number, length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 1 THEN (2 * substring(d, length(d) - i, 1)::INTEGER) // 10 + (2 * substring(d, length(d) - i, 1)::INTEGER) % 10 ELSE substring(d, length(d) - i, 1)::INTEGER END)) % 10 = 0 AS ok FROM d""",
)
def t7(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9 -]*[0-9]"), 0)).alias("number"))
    return d.select("doc_id", "number", X.luhn_ok(F.col("number")).alias("ok"))


@query("t9_sentence_split")
def t9(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


QTEXT = "text || ' ' || source || concat(' Q', doc_id % 4 + 1, ' 20', 10 + doc_id % 15, ' invoice ', doc_id, ' fy', 20 + doc_id % 5, ' March 2021 2020-01-', doc_id % 28 + 1, ' REF-', doc_id)"


def found_sql(name: str, text: str, rules: list[str], group: int) -> str:
    """What the rules find in ``text``, in their order, in lower case, each once."""
    found = " || ".join(rf"regexp_extract_all({text}, '\b{r}\b', {group})" for r in rules)
    return f"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(k, range(len(k))), lambda z: list_position(k, z[1]) = z[2] + 1), lambda z: z[1]), '|') AS {name} FROM (SELECT doc_id, [lower(x) FOR x IN {found}] AS k FROM (SELECT doc_id, {QTEXT} AS query FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))"


def asked(spark, sf):
    """The whole text of each document, followed by dates and ids of every form."""
    i = F.col("doc_id")
    return S.read_table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL").select(
        "doc_id",
        F.concat(F.col("text"), F.lit(" "), F.col("source"), F.lit(" Q"), (i % 4 + 1).cast("string"), F.lit(" 20"), (10 + i % 15).cast("string"), F.lit(" invoice "), i.cast("string"), F.lit(" fy"), (20 + i % 5).cast("string"), F.lit(" March 2021 2020-01-"), (i % 28 + 1).cast("string"), F.lit(" REF-"), i.cast("string")).alias("query"),
    )


@query("t10_query_dates", found_sql("dates", "lower(query)", X.DATE_RULES, 0))
def t10(spark, sf):
    return asked(spark, sf).select("doc_id", F.array_join(X.query_dates(F.col("query")), "|").alias("dates"))


@query("t11_query_ids", found_sql("ids", "query", [X.ID_AFTER_WORD, X.ID_PLAIN], 1))
def t11(spark, sf):
    return asked(spark, sf).select("doc_id", F.array_join(X.query_doc_ids(F.col("query")), "|").alias("ids"))


@query("t12_confidence", "SELECT doc_id, least(0.95, 0.3 + 0.2 * (len(regexp_extract_all(text, '[0-9]{4}')) + len(regexp_extract_all(text, '[A-Z]{2,}'))))::DOUBLE AS conf FROM documents")
def t12(spark, sf):
    found = [F.regexp_extract_all("text", F.lit(p), 0) for p in ("[0-9]{4}", "[A-Z]{2,}")]
    return docs(spark, sf).select("doc_id", X.extraction_confidence(*found).alias("conf"))


@query("t13_model_worthiness", r"SELECT query_id, length(query) >= 8 AND len(regexp_split_to_array(trim(query), '\s+')) >= 3 AND regexp_matches(query, '[A-Z][a-z]') AS worth FROM queries", "queries")
def t13(spark, sf):
    return S.read_queries(spark, sf).select("query_id", X.needs_model(F.col("query")).alias("worth"))


@query(
    "t14_entity_filter",
    """WITH q AS (SELECT query_id, user_id, unnest(list_distinct([lower(trim(x)) FOR x IN string_split(query, ' ') IF trim(x) <> ''])) AS item FROM queries),
h AS (SELECT file_id, user_id, unnest([lower(source), lang, '2024-01-01', 'inv-' || file_id]) AS item FROM summaries WHERE NOT is_private)
SELECT query_id, file_id, string_agg(DISTINCT h.item, '|' ORDER BY h.item) AS matched FROM q JOIN h USING (user_id, item) GROUP BY ALL""",
    "queries",
    "summaries",
)
def t14(spark, sf):
    q = S.read_queries(spark, sf).withColumn("items", F.split("query", " "))
    s = S.read_summaries(spark, sf).where("NOT is_private").withColumn("index", F.from_json("index_json", S.INDEX_SCHEMA))
    return O.entity_filter(q, s).withColumn("matched", F.array_join("matched", "|"))


@query("t15_table_intent", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(?:" + "|".join(X.TABLE_WORDS) + ")\\b') AS wants FROM conversations")
def t15(spark, sf):
    return S.read_table(spark, sf, "conversations").select("conv_id", "turn", X.table_intent(F.col("text")).alias("wants"))


KINDS = " ".join(f"WHEN plain IN ({', '.join(map(repr, phrases))}) THEN '{kind}'" for kind, phrases in X.SMALL_TALK.items())


@query(
    "t16_small_talk",
    rf"""SELECT conv_id, turn, CASE WHEN length(trim(said)) <= 30 THEN CASE {KINDS} END END AS kind FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(said), '[^a-z ]+', ' ', 'g'), '\s+', ' ', 'g')) AS plain
FROM (SELECT conv_id, turn, text AS said FROM conversations UNION ALL SELECT conv_id, -1 - turn, CASE turn % 2 WHEN 0 THEN ' Good   MORNING! ' ELSE 'thank you :)' END FROM conversations))""",
)
def t16(spark, sf):
    """All turns, and a phrase beside each (turns below 0), as the table has no small talk."""
    c = S.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    more = c.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.when(F.col("turn") % 2 == 0, " Good   MORNING! ").otherwise("thank you :)").alias("text"))
    return c.unionByName(more).select("conv_id", "turn", X.small_talk_kind(F.col("text")).alias("kind"))


@query("t17_t18_name_overlap", r"""WITH t AS (SELECT file_id, list_distinct(list_filter(regexp_split_to_array(lower(filename), '[\s_.\-]+'), lambda w: length(w) > 1)) AS w FROM files)
SELECT a.file_id, len(a.w) AS n, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM t a JOIN t b ON b.file_id = a.file_id + 1""", "files")
def t17(spark, sf):
    f = S.read_files(spark, sf).select("file_id", X.filename_tokens(F.col("filename")).alias("w"))
    nxt = f.select((F.col("file_id") - 1).alias("file_id"), F.col("w").alias("v"))
    return f.join(nxt, "file_id").select("file_id", F.size("w").alias("n"), F.round(X.overlap_coefficient(F.col("w"), F.col("v")), 6).alias("overlap"))


@query("t19_cosine", "SELECT a.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)) + 1e-9), 6) AS sim FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def t19(spark, sf):
    e = S.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


FIGURES = r"[^.\n]*[0-9][^.\n]*"
#: The same matches, tried once for each stretch: they begin where a stretch between full stops and line ends begins.
FIGURES_ONCE = r"(?<![^.\n])[^.\n0-9]*+[0-9][^.\n]*+"


@query("t20_summary_gate", f"SELECT doc_id, CASE WHEN o = '' THEN 'empty' WHEN length(o) < 30 THEN 'too_short' WHEN ends_with(o, '?') AND length(o) < 80 THEN 'question' WHEN len(i) = 0 THEN 'no_insights' WHEN len(list_filter(i, lambda x: length(trim(x)) >= 10)) = 0 THEN 'short_insights' END AS reason FROM (SELECT doc_id, trim(text) AS o, regexp_extract_all(text, '{FIGURES}') AS i FROM documents)")
def t20(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", X.summary_gate(F.col("text"), F.regexp_extract_all("text", F.lit(FIGURES_ONCE), 0)).alias("reason"))


@query("t21_summary_format", "SELECT doc_id, text || chr(10) || chr(10) || '- ' || source || chr(10) || '- ' || lang AS summary FROM documents")
def t21(spark, sf):
    return S.read_table(spark, sf, "documents").select("doc_id", X.format_summary(F.col("text"), F.array("source", "lang")).alias("summary"))


@query("t22_embedding_inputs", "SELECT file_id, 'summary' AS kind, 0 AS pos, substring(trim(summary || chr(10) || chr(10) || 'Keywords: ' || source || ', ' || lang), 1, 7600) AS text FROM summaries WHERE length(trim(summary)) > 0 UNION ALL SELECT file_id, 'insight', unnest([0, 1]), trim(unnest([source || ' matters', 'more on ' || lang]) || ' (' || source || ', ' || lang || ')') FROM summaries", "summaries")
def t22(spark, sf):
    s = S.read_summaries(spark, sf).select("file_id", "summary").join(S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "source", "lang"), "file_id")
    s = s.withColumns({"entities": F.array("source", "lang"), "insights": F.array(F.concat("source", F.lit(" matters")), F.concat(F.lit("more on "), "lang"), F.lit(" "))})
    return O.embedding_inputs(s)


@query(
    "t24_pdf_triage",
    """WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN '%PDF-1.7 /Encrypt 5 0 R' ELSE '%PDF-1.4 ' END || text AS content, CASE WHEN doc_id % 4 = 2 THEN 200000 ELSE length(text) + 100 END AS length, 10 AS text_chars FROM documents)
SELECT doc_id, CASE WHEN content IS NULL OR NOT starts_with(content, '%PDF-') THEN 'not_pdf' WHEN contains(content, '/Encrypt') AND strlen(split_part(content, '/Encrypt', 1)) + 8 <= 4096 THEN 'encrypted' WHEN text_chars < 50 AND length > 100000 THEN 'image_only' ELSE 'ok' END AS verdict FROM b""",
)
def t24(spark, sf):
    m = F.col("doc_id") % 4
    head = F.when(m == 0, "text").when(m == 1, "%PDF-1.7 /Encrypt 5 0 R").otherwise("%PDF-1.4 ")
    size = F.when(m == 2, 200_000).otherwise(F.length("text") + 100)
    d = docs(spark, sf).select("doc_id", F.concat(head, "text").cast("binary").alias("content"), size.alias("length"), F.lit(10).alias("text_chars"))
    return O.triage_blobs(d).select("doc_id", "verdict")


@query(
    "t25_extraction_choice",
    r"""WITH c AS (SELECT doc_id AS file_id, 'primary' AS method, text FROM documents UNION ALL SELECT doc_id, 'secondary', regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g') FROM documents UNION ALL SELECT doc_id, 'plain', text FROM documents),
w AS (SELECT *, list_slice(regexp_extract_all(lower(text), '\S+'), 1, 200) AS w, substring(text,1,5000) AS h FROM c WHERE length(text) > 0),
g AS (SELECT *, NOT (length(text) < 50 OR length(regexp_replace(h, '[a-zA-Z0-9\s]', '', 'g')) / length(h) > 0.4 OR len(w) >= 30 AND len(list_distinct(w)) / len(w) < 0.15) AS good FROM w)
SELECT file_id, method, text FROM g WHERE good OR (method = 'plain' AND length(trim(text)) > 0) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY CASE method WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 ELSE 2 END) = 1""",
)
def t25(spark, sf):
    d = spread(docs(spark, sf)).select(F.col("doc_id").alias("file_id"), "text")
    # One row for each method, so that each text is made once, before it is judged.
    method = lambda name, text: F.struct(F.lit(name).alias("method"), text.alias("text"))
    # What stays is joined: faster than the replacement of every other character.
    plain = F.array_join(F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9\s]++"), 0), "")
    each = F.array(method("primary", F.col("text")), method("secondary", plain), method("plain", F.col("text")))
    return O.choose_extraction(d.select("file_id", F.inline(each)))


@query("t26_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def t26(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("t27_retry_triage", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{X.either(X.PERMANENT)}') THEN 'permanent' ELSE 'retryable' END AS triage FROM documents")
def t27(spark, sf):
    return docs(spark, sf).select("doc_id", X.retry_triage(F.col("text")).alias("triage"))


@query("t28_array_normalise", "SELECT doc_id, lower(source) || '|' || lang AS items FROM documents")
def t28(spark, sf):
    items = F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.upper("source"), F.lit(""), F.upper("lang"), F.lit(None).cast("string"))
    return S.read_table(spark, sf, "documents").select("doc_id", F.array_join(C.norm_list(items), "|").alias("items"))
