"""Queries over the catalogue operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.operators import catalogue as K
from shelfmark.plans.base import query
from shelfmark.sources import tables as S
from shelfmark.sources.stored import Partitioned, shared_folder, user_bucket

FILE_COLS = ["file_id", "user_id", "filename", "filetype", "collection", "file_hash", "extraction_status", "is_private", "created_at"]


@query("s1_catalogue_scan", "SELECT * FROM files WHERE user_id = 7", "files")
def s1(spark, sf):
    return S.read_files(spark, sf).where("user_id = 7")


@query("s2_summary_scan", "SELECT file_id, user_id, collection, filename, summary, raw_text, is_private, created_at FROM summaries WHERE collection = 'Media'", "summaries")
def s2(spark, sf):
    return S.read_summaries(spark, sf, "Media").drop("index_json")


@query("s3_chunk_scan", "SELECT vec_id, file_id, chunk_index FROM chunks WHERE file_id = 42", "chunks")
def s3(spark, sf):
    return S.read_chunks(spark, sf).where("file_id = 42").select("vec_id", "file_id", "chunk_index")


@query("s4_body_fetch", "SELECT user_id, file_id, coalesce(nullif(raw_text,''), nullif(summary,''), '') AS text FROM summaries", "summaries")
def s4(spark, sf):
    return K.file_text(S.read_summaries(spark, sf))


@query("s5_blob_url", "SELECT message_id, 'b' AS bucket, user_id || '/' || file_id AS key FROM messages WHERE reason IS NULL", "messages")
def s5(spark, sf):
    valid, _ = S.read_messages(S.read_message_values(spark, sf))
    return valid.select("message_id", S.parse_blob_url(F.col("url")).alias("u")).select("message_id", "u.bucket", "u.key")


@query("s7_messages_valid", "SELECT message_id, file_id, user_id, filename, filetype, url, is_private, delivery_attempt FROM messages WHERE reason IS NULL", "messages")
def s7(spark, sf):
    return S.read_messages(S.read_message_values(spark, sf))[0]


@query("s7_messages_rejected", "SELECT message_id, reason, delivery_attempt FROM messages WHERE reason IS NOT NULL", "messages")
def s7b(spark, sf):
    return S.read_messages(S.read_message_values(spark, sf))[1].drop("value")


@query(
    "s8_message_producer",
    """SELECT file_id, CASE WHEN filetype LIKE 'audio/%' OR filetype LIKE 'video/%' THEN 'media-topic' ELSE 'document-topic' END AS topic,
  concat('{"_id":"', file_id, '","userId":"', user_id, '","fileName":"', filename, '","fileType":"', filetype, '","gcsUrl":"https://storage.googleapis.com/b/', user_id, '/', file_hash, '","isPrivate":', is_private, '}') AS value FROM files""",
    "files",
)
def s8(spark, sf):
    return K.to_messages(S.read_files(spark, sf))


SUMMARY_ROWS = "SELECT file_id, user_id, collection, filename, text AS summary, text AS raw_text, CASE collection WHEN 'Images' THEN 'caption' WHEN 'Media' THEN 'transcript' END AS processing_type, false AS is_private FROM files JOIN documents ON doc_id = file_id WHERE NOT is_private"


@query("k1_summary_rows", SUMMARY_ROWS, "files")
def k1(spark, sf):
    return K.build_summary_rows(S.read_files(spark, sf), S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text"))


@query("k2_private_stubs", f"SELECT file_id, user_id, collection, filename, '{S.PLACEHOLDER}' AS summary, '' AS raw_text, CASE WHEN collection = 'Images' THEN 'private' END AS processing_type, true AS is_private FROM files WHERE is_private", "files")
def k2(spark, sf):
    return K.private_stubs(S.read_files(spark, sf))


@query("k3_replace_chunks", "SELECT vec_id, file_id, chunk_index, 'old' AS origin FROM chunks WHERE file_id % 3 <> 0 UNION ALL SELECT vec_id, file_id, chunk_index + 100, 'new' FROM chunks WHERE file_id % 3 = 0", "chunks")
def k3(spark, sf):
    c = S.read_chunks(spark, sf).drop("embedding")
    new = c.where("file_id % 3 = 0").withColumn("chunk_index", F.col("chunk_index") + 100)
    return K.replace_by_key(c.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), ["file_id"])


def stored_table(spark, rows, by, keyed=()):
    """``rows`` in a new partitioned table."""
    table = Partitioned(spark, shared_folder(spark, "table"), rows.schema, by, list(keyed))
    table.add(rows)
    return table


@query("k3_replace_stored", "SELECT vec_id, file_id, chunk_index, 'old' AS origin, user_id FROM (SELECT *, file_id % 20 AS user_id FROM chunks) WHERE user_id <> 3 UNION ALL SELECT vec_id, file_id, chunk_index + 100, 'new', file_id % 20 FROM chunks WHERE file_id % 20 = 3", "chunks")
def k3_stored(spark, sf):
    """K3 on folders by tenant: only the bucket of the tenant whose files are replaced is written again."""
    c = S.read_chunks(spark, sf).drop("embedding").withColumns({"user_id": F.col("file_id") % 20, "origin": F.lit("old")})
    table = stored_table(spark, c, {"bucket": user_bucket(8)}, ["bucket"])
    table.replace(c.where("user_id = 3").withColumns({"chunk_index": F.col("chunk_index") + 100, "origin": F.lit("new")}), ["user_id", "file_id"])
    return table.read().drop("bucket")


@query("k7_purge_stored", "SELECT collection, user_id, file_id FROM files WHERE user_id NOT IN (3,5)", "files")
def k7_stored(spark, sf):
    """K7 on folders by collection and tenant."""
    files = S.read_files(spark, sf).select("collection", "user_id", "file_id")
    table = stored_table(spark, files, {"collection": F.col("collection"), "bucket": user_bucket(8)}, ["bucket"])
    table.delete(spark.createDataFrame([(3,), (5,)], "user_id long"), ["user_id"])
    return table.read().drop("bucket")


@query("x9_retention_stored", "SELECT event_id, user_id, file_id FROM clicks WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 10 DAY", "clicks")
def x9_stored(spark, sf):
    """X9 on folders by day: those of earlier days go unread."""
    clicks = S.read_clicks(spark, sf).select("event_id", "user_id", "file_id", "ts")
    table = stored_table(spark, clicks, {"day": F.to_date("ts")})
    table.retain("day", datetime.date(2024, 1, 22), F.col("ts") >= F.expr("timestamp_ntz'2024-01-22 00:00:00'"))
    return table.read().select("event_id", "user_id", "file_id")


@query("k4_load_report", "SELECT count(*) FILTER (vec_id IS NOT NULL AND length(text) > 0) AS inserted, count(*) FILTER (NOT (vec_id IS NOT NULL AND length(text) > 0)) AS skipped, count(*) AS total FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def k4(spark, sf):
    d = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return K.load_report(d.join(S.read_table(spark, sf, "embeddings"), "vec_id", "left"))


@query("k5_evolve", "SELECT file_id, chunk_index, vec_id, cast(NULL AS varchar) AS parent_text, cast(NULL AS boolean) AS has_table FROM chunks", "chunks")
def k5(spark, sf):
    c = S.read_chunks(spark, sf).drop("embedding")
    return K.evolve(c, c.withColumns({"parent_text": F.lit("").cast("string"), "has_table": F.lit(False)}))


@query("k6_delete_cascade", "SELECT file_id, user_id, 'files' AS origin FROM files WHERE extraction_status IS DISTINCT FROM 'failed' UNION ALL SELECT file_id, user_id, 'summaries' FROM summaries WHERE file_id % 11 <> 0", "summaries")
def k6(spark, sf):
    files = S.read_files(spark, sf)
    left = K.purge_files({"files": files, "summaries": S.read_summaries(spark, sf)}, files.where("extraction_status = 'failed'"))
    return K.federate([t.select("file_id", "user_id", F.lit(n).alias("origin")) for n, t in left.items()])


@query("k7_purge_tenant", "SELECT 'files' AS origin, count(*) AS n FROM files WHERE user_id NOT IN (3,5) UNION ALL SELECT 'clicks', count(*) FROM clicks WHERE user_id NOT IN (3,5)", "files", "clicks")
def k7(spark, sf):
    users = spark.createDataFrame([(3,), (5,)], "user_id long")
    left = K.purge_users({"files": S.read_files(spark, sf), "clicks": S.read_clicks(spark, sf)}, users)
    return K.federate([t.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("origin"), "n") for n, t in left.items()])


@query("p1_tenant_filter", "SELECT query_id, count(file_id) AS n_files FROM queries LEFT JOIN files USING (user_id) GROUP BY query_id", "queries", "files")
def p1(spark, sf):
    return S.read_queries(spark, sf).join(S.read_files(spark, sf), "user_id", "left").groupBy("query_id").agg(F.count("file_id").alias("n_files"))


@query("p2_collection_of_mime", "SELECT file_id, collection AS derived FROM files", "files")
def p2(spark, sf):
    return S.read_files(spark, sf).select("file_id", C.collection_of(F.col("filetype")).alias("derived"))


@query("p3_topic_routing", "SELECT CASE WHEN collection = 'Media' THEN 'media-topic' ELSE 'document-topic' END AS topic, collection, count(*) AS n FROM files GROUP BY ALL", "files")
def p3(spark, sf):
    return K.route_messages(S.read_files(spark, sf)).groupBy("topic", "collection").agg(F.count("*").alias("n"))


@query("p4_filename_normalise", "SELECT message_id, replace(filename, ' ', '_') AS name FROM messages WHERE reason IS NULL", "messages")
def p4(spark, sf):
    valid, _ = S.read_messages(S.read_message_values(spark, sf))
    return valid.select("message_id", C.norm_filename(F.col("filename")).alias("name"))


@query("p5_list_filter", "SELECT 'images' AS kind, count(*) AS n FROM files WHERE collection = 'Images' UNION ALL SELECT 'media', count(*) FROM files WHERE collection = 'Media' UNION ALL SELECT 'docs', count(*) FROM files WHERE collection = 'Documents' UNION ALL SELECT 'failed', count(*) FROM files WHERE extraction_status = 'failed' UNION ALL SELECT 'all', count(*) FROM files", "files")
def p5(spark, sf):
    f = S.read_files(spark, sf)
    return K.federate([K.filter_files(f, k).groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("images", "media", "docs", "failed", "all")])


@query("p6_filename_search", "SELECT file_id, filename FROM files WHERE contains(lower(filename), 'src1_de')", "files")
def p6(spark, sf):
    return K.search_filename(S.read_files(spark, sf), "  SRC1_de ").select("file_id", "filename")


@query("p9_array_membership", "SELECT file_id FROM summaries WHERE NOT is_private AND (lang IN ('de','src3') OR source IN ('de','src3'))", "summaries")
def p9(spark, sf):
    s = S.read_summaries(spark, sf).withColumn("index", F.from_json("index_json", S.INDEX_SCHEMA))
    return s.where(C.any_of(C.norm_list(F.col("index.entities")), F.array(F.lit("de"), F.lit("src3")))).select("file_id")


@query("p10_privacy_split", "SELECT is_private, count(*) AS n FROM files GROUP BY is_private", "files")
def p10(spark, sf):
    private, public = K.split_private(S.read_files(spark, sf))
    return private.unionByName(public).groupBy("is_private").agg(F.count("*").alias("n"))


@query(
    "p11_chat_readiness",
    """WITH r AS (SELECT f.user_id, f.file_id, CASE WHEN f.is_private THEN 'private' WHEN extraction_status = 'failed' THEN 'failed' WHEN extraction_status IN ('pending','processing') THEN 'not_ready' WHEN length(trim(coalesce(nullif(raw_text,''), summary, ''))) = 0 THEN 'no_text' END AS reason,
  f.file_id IN (SELECT file_id FROM chunks) AS have FROM files f LEFT JOIN summaries s ON s.file_id = f.file_id)
SELECT user_id, file_id, reason IS NULL AS ready, have AND reason IS NULL AS cached, reason FROM r""",
    "summaries",
    "chunks",
)
def p11(spark, sf):
    return K.chat_readiness(S.read_files(spark, sf), S.read_summaries(spark, sf), S.read_chunks(spark, sf))


@query("p13_preview", "SELECT doc_id, substring(text,1,1000) AS preview, length(text) > 1000 AS truncated, length(text) AS full_length FROM documents")
def p13(spark, sf):
    return K.preview(S.read_table(spark, sf, "documents").select("doc_id", "text"), 1000)


@query("p14_catalogue_projection", "SELECT file_id AS id, filename AS name, filetype AS type, coalesce(extraction_status,'done') AS status, CASE WHEN extraction_status IN ('pending','processing') THEN 'queued' END AS progress, created_at AS uploaded_at FROM files", "files")
def p14(spark, sf):
    return K.catalogue_view(S.read_files(spark, sf))


@query("p15_type_label", "SELECT DISTINCT filetype, CASE filetype WHEN 'application/pdf' THEN 'PDF' WHEN 'image/png' THEN 'Image' WHEN 'video/mp4' THEN 'Video' ELSE filetype END AS label FROM files", "files")
def p15(spark, sf):
    return S.read_files(spark, sf).select("filetype", C.type_label(F.col("filetype")).alias("label")).distinct()


@query("p16_query_validation", "SELECT query_id, 'too_long' AS reason FROM queries WHERE length(query) > 30 UNION ALL SELECT query_id, 'empty' FROM queries WHERE length(trim(query)) = 0", "queries")
def p16(spark, sf):
    return K.validate_queries(S.read_queries(spark, sf), 30)[1].select("query_id", "reason")


@query("p16_click_normalise", "SELECT event_id, least(rank * 20, 100) AS rank, substring(trim(lower(query)), 1, 500) AS query FROM clicks JOIN queries USING (query_id)", "clicks", "queries")
def p16b(spark, sf):
    c = S.read_clicks(spark, sf).drop("user_id").withColumn("rank", F.col("rank") * 20).join(S.read_queries(spark, sf), "query_id")
    return K.normalise_clicks(c).select("event_id", "rank", "query")


@query("p17_quick_kind", "SELECT file_id, CASE collection WHEN 'Images' THEN NULL WHEN 'Media' THEN NULL ELSE CASE filetype WHEN 'application/pdf' THEN 'pdf' ELSE 'text' END END AS kind, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too_large' WHEN collection <> 'Documents' THEN 'unsupported' END AS reason FROM files JOIN documents ON doc_id = file_id", "files")
def p17(spark, sf):
    d = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.length("text").alias("length"))
    return K.classify_blobs(S.read_files(spark, sf).join(d, "file_id"), 5000).select("file_id", "kind", "reason")


@query("j1_catalogue_enrichment", "SELECT f.file_id, f.user_id, coalesce(extraction_status,'done') AS status, CASE WHEN coalesce(extraction_status,'done') = 'done' THEN summary END AS summary, CASE WHEN coalesce(extraction_status,'done') = 'done' AND NOT f.is_private THEN upper(source) END AS second_entity FROM files f JOIN summaries s ON s.file_id = f.file_id", "summaries")
def j1(spark, sf):
    out = K.list_files(S.read_files(spark, sf), S.read_summaries(spark, sf))
    return out.select("file_id", "user_id", "status", "summary", F.col("index.entities")[1].alias("second_entity"))


@query("j2_upload_dedupe", "WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id, file_hash ORDER BY file_id) AS n FROM files WHERE file_id % 2 = 1) SELECT file_id, n = 1 AND (user_id, file_hash) NOT IN (SELECT (user_id, file_hash) FROM files WHERE file_id % 2 = 0) AS accepted FROM i", "files")
def j2(spark, sf):
    f = S.read_files(spark, sf)
    good, bad = K.dedupe_uploads(f.where("file_id % 2 = 1"), f.where("file_id % 2 = 0"))
    return good.select("file_id", F.lit(True).alias("accepted")).union(bad.select("file_id", F.lit(False)))


@query("j3_skip_indexed", "SELECT message_id FROM messages WHERE reason IS NULL AND message_id % 2 = 1", "messages")
def j3(spark, sf):
    valid, _ = S.read_messages(S.read_message_values(spark, sf))
    done = S.read_summaries(spark, sf).where("file_id % 2 = 0").select(F.col("user_id").cast("string").alias("user_id"), F.col("file_id").cast("string").alias("file_id"))
    return K.skip_indexed(valid, done).select("message_id")


@query("a1_collection_tiles", "SELECT user_id, count(*) FILTER (collection='Documents') AS documents, count(*) FILTER (collection='Images') AS images, count(*) FILTER (collection='Media') AS media, count(*) AS total FROM files GROUP BY user_id", "files")
def a1(spark, sf):
    return K.collection_counts(S.read_files(spark, sf))


@query("a2_status_counts", "SELECT user_id, count(*) FILTER (extraction_status IN ('pending','processing')) AS in_flight, count(*) FILTER (extraction_status='failed') AS failed, count(*) FILTER (collection='Images') AS images, count(*) FILTER (collection='Media') AS media, count(*) FILTER (collection='Documents') AS docs, count(*) AS all_files FROM files GROUP BY user_id", "files")
def a2(spark, sf):
    return K.status_counts(S.read_files(spark, sf))


USAGE = "SELECT user_id, cast(ts AS date) AS day, count(*) AS messages, count(*) FILTER (event_type='click') AS persistent, count(*) FILTER (event_type='view') AS ephemeral FROM ev WHERE event_type IN ('click','view') GROUP BY ALL"


@query("a3_usage_daily", USAGE, "ev")
def a3(spark, sf):
    return K.usage_daily(S.read_events(spark, sf))


@query("a3_usage_merge", USAGE, "ev")
def a3b(spark, sf):
    e = S.read_events(spark, sf)
    return K.merge_usage(K.usage_daily(e.where("event_id % 2 = 0")), K.usage_daily(e.where("event_id % 2 = 1")))


@query("a4_access_tally", "SELECT * FROM access", "access")
def a4(spark, sf):
    return S.read_access(spark, sf)


@query("a5_ctr_at_1", "SELECT cast(ts AS date) AS day, count(*) AS n_clicks, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ctr1 FROM clicks GROUP BY 1", "clicks")
def a5(spark, sf):
    return K.ctr_at_1(S.read_clicks(spark, sf))


@query("a6_zero_click", "SELECT user_id, count(*) AS n_zero_click FROM (SELECT DISTINCT user_id, event_id % 40 AS query_id FROM ev WHERE event_type = 'view') s WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = s.user_id AND c.query_id = s.query_id) GROUP BY 1", "clicks")
def a6(spark, sf):
    searches = S.read_events(spark, sf).where("event_type = 'view'").select("user_id", (F.col("event_id") % 40).alias("query_id"))
    return K.zero_click(searches, S.read_clicks(spark, sf))


@query("a7_click_pairs", "SELECT query_id, file_id, min(rank) AS best_rank, count(*) AS n_clicks FROM clicks GROUP BY ALL", "clicks")
def a7(spark, sf):
    return K.click_pairs(S.read_clicks(spark, sf))


@query(
    "a12_merge_partials",
    """WITH p AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS overview, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part, source, lang FROM documents),
i AS (SELECT file_id, lower(trim(x)) AS low, min((part, pos, trim(x))) AS k FROM (SELECT file_id, part, unnest([source, upper(source), lang]) AS x, unnest([0,1,2]) AS pos FROM p) WHERE trim(x) <> '' GROUP BY ALL),
l AS (SELECT file_id, list_transform(list(k ORDER BY k), lambda t: t[3]) AS items FROM i GROUP BY file_id)
SELECT p.file_id, string_agg('[Section ' || (part + 1) || '] ' || overview, chr(10) ORDER BY part) AS overview, array_to_string(list_slice(first(items), 1, 8), '|') AS insights, array_to_string(first(items), '|') AS entities FROM p JOIN l USING (file_id) WHERE length(trim(overview)) > 0 GROUP BY p.file_id""",
)
def a12(spark, sf):
    d = S.read_table(spark, sf, "documents")
    items = F.array("source", F.upper("source"), "lang")
    parts = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("part", "overview"), items.alias("insights"), items.alias("entities"))
    return K.merge_partials(parts).withColumns({c: F.array_join(c, "|") for c in ("insights", "entities")})


STAGES = ["download", "validate", "extract", "quality", "summarise", "embed", "index", "finish"]


@query("a16_stage_timing", f"SELECT {STAGES}[1 + event_id % 8] AS stage, count(*) AS n, count(*) FILTER (event_id % 37 = 0) AS failures, round(quantile_cont(value * 100, 0.5), 4) AS p50, round(quantile_cont(value * 100, 0.95), 4) AS p95 FROM ev GROUP BY 1", "ev")
def a16(spark, sf):
    return K.stage_summary(stages(spark, sf))


@query("a16_stage_sketches", f"SELECT {STAGES}[1 + event_id % 8] AS stage, count(*) AS n, count(*) FILTER (event_id % 37 = 0) AS failures, true AS p50_near, true AS p95_near FROM ev GROUP BY 1", "ev")
def a16_sketches(spark, sf):
    """Sketches of each day, merged; whether both durations are within two hundredths of their rank among all runs."""
    s = stages(spark, sf)
    found = K.merged_summary(K.stage_sketches(s, ["day"]))
    below = lambda c: F.count_if(F.col("ms") < F.col(c)) / F.count("*")
    upto = lambda c: F.count_if(F.col("ms") <= F.col(c)) / F.count("*")
    near = [((below(c) <= r + 0.02) & (upto(c) >= r - 0.02)).alias(f"{c}_near") for c, r in (("p50", 0.5), ("p95", 0.95))]
    checked = s.join(found.select("stage", "p50", "p95"), "stage").groupBy("stage").agg(*near)
    return found.select("stage", "n", "failures").join(checked, "stage")


def stages(spark, sf):
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    return S.read_events(spark, sf).select(stage.alias("stage"), (F.col("value") * 100).alias("ms"), (F.col("event_id") % 37 == 0).alias("failed"), F.to_date("ts").alias("day"))


@query("a17_failure_taxonomy", "SELECT CASE file_id % 3 WHEN 0 THEN 'no_content' WHEN 1 THEN 'llm_failed' ELSE 'unknown' END AS error_kind, collection, count(*) AS n FROM files WHERE extraction_status = 'failed' GROUP BY ALL", "files")
def a17(spark, sf):
    code = F.element_at(F.array(F.lit("no_content"), F.lit("llm_failed"), F.lit("disk_on_fire")), (F.col("file_id") % 3 + 1).cast("int"))
    return K.failure_report(S.read_files(spark, sf).withColumns({"error_code": code, "status": F.col("extraction_status")}))


@query("a18_low_yield", "SELECT doc_id, n_chars / (1 + doc_id % 5) AS per_page FROM documents WHERE n_chars / (1 + doc_id % 5) < 50")
def a18(spark, sf):
    d = S.read_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (1 + F.col("doc_id") % 5)).alias("per_page"))
    return d.where("per_page < 50")


@query("w3_last_turns", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user','assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def w3(spark, sf):
    return K.last_turns(S.read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), 6)


@query("w9_truncate_for_regenerate", "SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role='user' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn < m")
def w9(spark, sf):
    return K.truncate_for_regenerate(S.read_table(spark, sf, "conversations").select("conv_id", "turn", "role"))


@query("l1_newest_files", "WITH t AS (SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY user_id, collection ORDER BY created_at DESC, file_id) <= 5) SELECT user_id, file_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) AS pos FROM t", "summaries")
def l1(spark, sf):
    return K.newest_files(S.read_summaries(spark, sf), 5).select("user_id", "file_id", "pos")


@query("l2_list_sorts", "SELECT 'name' AS kind, file_id, row_number() OVER (PARTITION BY user_id ORDER BY lower(filename), file_id) AS pos FROM files UNION ALL SELECT 'status', file_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE coalesce(extraction_status,'done') WHEN 'failed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END, file_id) FROM files UNION ALL SELECT 'newest', file_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) FROM files UNION ALL SELECT 'oldest', file_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, file_id) FROM files UNION ALL SELECT 'type', file_id, row_number() OVER (PARTITION BY user_id ORDER BY filetype, file_id) FROM files", "files")
def l2(spark, sf):
    f = S.read_files(spark, sf)
    return K.federate([K.sort_files(f, k).select(F.lit(k).alias("kind"), "file_id", "pos") for k in ("name", "status", "newest", "oldest", "type")])


@query("l6_top_entities", "SELECT file_id, source || '|' || lang || '|' || 'INV-' || file_id AS top FROM (SELECT file_id, source, lang FROM summaries WHERE NOT is_private) t", "summaries")
def l6(spark, sf):
    s = S.read_summaries(spark, sf).where("NOT is_private").withColumn("index", F.from_json("index_json", S.INDEX_SCHEMA))
    return s.select("file_id", F.array_join(C.top_entities(F.col("index")), "|").alias("top"))


@query("l7_entity_panel", "SELECT file_id, unnest(['Entities','Document IDs','Topics','Dates','Key numbers']) AS label, unnest([source || '|' || upper(source) || '|' || lang, 'INV-' || file_id, lang, '2024-01-01', 'chars: ' || n_chars]) AS items FROM summaries WHERE NOT is_private", "summaries")
def l7(spark, sf):
    s = S.read_summaries(spark, sf).where("NOT is_private").withColumn("index", F.from_json("index_json", S.INDEX_SCHEMA))
    return K.entity_panel(s).withColumn("items", F.array_join("items", "|"))


@query("u1_federated_union", "SELECT collection, count(*) AS n FROM summaries GROUP BY 1", "summaries")
def u1(spark, sf):
    return K.federate([S.read_summaries(spark, sf, c) for c in K.COLLECTIONS]).groupBy("collection").agg(F.count("*").alias("n"))


@query("u3_ordered_distinct", "SELECT doc_id, source || '|' || lang AS folded, source || '|' || upper(source) || '|' || lang AS exact FROM documents")
def u3(spark, sf):
    items = F.array("source", F.upper("source"), "lang", F.lit(" "), "source")
    return S.read_table(spark, sf, "documents").select("doc_id", F.array_join(C.ordered_distinct(items), "|").alias("folded"), F.array_join(C.ordered_distinct(items, False), "|").alias("exact"))
