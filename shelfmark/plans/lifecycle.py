"""Queries over lifecycle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import lifecycle as L
from shelfmark.operators.catalogue import usage_daily
from shelfmark.plans.base import VIEWS, query
from shelfmark.plans.catalogue import USAGE
from shelfmark.sources import tables as S

AS_OF = "timestamp_ntz'2024-02-01 00:00:00'"
VIEWS["ses"] = "SELECT user_id, session_no, min(ts) AS begins, max(ts) AS last_used, count(*) AS n_events FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE)::INTEGER, 0) AS g FROM ev)) GROUP BY ALL"


def messages(spark, sf):
    return S.read_messages(S.read_message_values(spark, sf))


@query("x1_ingest_batch", "SELECT message_id FROM messages WHERE reason IS NULL AND delivery_attempt <= 3 AND message_id % 5 <> 0", "messages")
def x1(spark, sf):
    done = S.read_files(spark, sf).where("file_id % 5 = 0").select(F.col("user_id").cast("string").alias("user_id"), F.col("file_id").cast("string").alias("file_id"))
    return L.ingest_batch(messages(spark, sf)[0], done).select("message_id")


@query("x3_dead_letters", "SELECT message_id, CASE WHEN reason IS NOT NULL THEN 'discard' WHEN delivery_attempt > 3 THEN 'dead_letter' ELSE 'process' END AS route, CASE WHEN reason IS NOT NULL THEN reason WHEN delivery_attempt > 3 THEN 'too_many_attempts' END AS reason FROM messages", "messages")
def x3(spark, sf):
    return L.route_dead_letters(*messages(spark, sf))


@query("x4_orphan_sweep", "SELECT file_id, CASE WHEN extraction_status = 'processing' AND created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE THEN 'pending' ELSE extraction_status END AS extraction_status, CASE WHEN extraction_status = 'processing' AND created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE THEN 'stuck_in_processing' END AS reason FROM files", "files")
def x4(spark, sf):
    f = S.read_files(spark, sf).withColumn("updated_at", F.col("created_at"))
    return L.sweep_orphans(f, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("file_id", "extraction_status", "reason")


def status_events(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return S.read_events(spark, sf).select("event_id", "ts", F.col("k").alias("file_id"), s.alias("status"), F.when(s == "failed", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"))


STATUS_SQL = "SELECT k AS file_id, ['pending','processing','done','failed'][1 + (arg_max(event_id, (ts, event_id)) % 4)] AS status, CASE WHEN arg_max(event_id, (ts, event_id)) % 4 = 3 THEN 'error ' || arg_max(event_id, (ts, event_id)) END AS error, count(*) AS n_events FROM ev GROUP BY k"


@query("x5_latest_status", STATUS_SQL, "ev")
def x5(spark, sf):
    return L.latest_status(status_events(spark, sf))


@query("x6_rate_breaches", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS begins, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 3", "ev")
def x6(spark, sf):
    return L.rate_breaches(S.read_events(spark, sf), "1 day", 3)


def logins(spark, sf):
    return S.read_events(spark, sf).where("event_type IN ('error', 'signup')").select("event_id", "user_id", "ts", (F.col("event_type") == "signup").alias("ok"))


#: Each user's attempts one by one, as a recursion over their numbers.
LOCKOUTS = """WITH RECURSIVE a AS (SELECT user_id, ts, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, i, ts, CASE WHEN ok THEN 0 ELSE 1 END AS n, TIMESTAMP '1970-01-01 00:00:00' AS until, false AS locked FROM a WHERE i = 1
UNION ALL SELECT a.user_id, a.i, a.ts, CASE WHEN a.ts < s.until THEN s.n WHEN a.ok OR s.n >= 2 THEN 0 ELSE s.n + 1 END, CASE WHEN a.ts >= s.until AND NOT a.ok AND s.n >= 2 THEN a.ts + INTERVAL 15 MINUTE ELSE s.until END, a.ts >= s.until AND NOT a.ok AND s.n >= 2
FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1)
SELECT user_id, ts AS locked_at, until FROM s WHERE locked"""


@query("x7_lockouts", LOCKOUTS, "ev")
def x7(spark, sf):
    return L.lockouts(logins(spark, sf), failures=3)


@query("x8_idle_sessions", "SELECT * FROM ses", "ev", "ses")
def x8(spark, sf):
    return L.sessions(S.read_events(spark, sf))


@query("w4_newest_sessions", "SELECT user_id, session_no, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, session_no) AS rank FROM ses QUALIFY rank <= 5", "ev", "ses")
def w4(spark, sf):
    return L.newest_sessions(L.sessions(S.read_events(spark, sf))).select("user_id", "session_no", "rank")


@query("a15_session_stats", "SELECT user_id, count(*) AS n_sessions FROM (SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, session_no) <= 5) GROUP BY ROLLUP (user_id)", "ev", "ses")
def a15(spark, sf):
    return L.session_stats(L.newest_sessions(L.sessions(S.read_events(spark, sf))))


@query("x9_retention", "SELECT event_id, user_id, file_id FROM clicks WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 10 DAY", "clicks")
def x9(spark, sf):
    return L.retain(S.read_clicks(spark, sf), "ts", 10, F.expr(AS_OF)).select("event_id", "user_id", "file_id")


@query("x10_usage_rollup", USAGE, "ev")
def x10(spark, sf):
    return usage_daily(S.read_events(spark, sf))


@query("x11_privacy_toggle", "WITH c AS (SELECT file_id, is_private, file_id % 2 = 0 AS make FROM files WHERE file_id % 3 = 0) SELECT f.file_id, coalesce(c.make, f.is_private) AS is_private, CASE WHEN c.make <> f.is_private THEN 'pending' ELSE f.extraction_status END AS extraction_status, NOT coalesce(c.make <> f.is_private, false) AS indexed, coalesce(c.make <> f.is_private, false) AS queued FROM files f LEFT JOIN c USING (file_id)", "files")
def x11(spark, sf):
    files = S.read_files(spark, sf)
    changes = files.where("file_id % 3 = 0").select("file_id", (F.col("file_id") % 2 == 0).alias("make_private"))
    out, index, sent = L.apply_privacy_changes(changes, files, S.read_summaries(spark, sf))
    out = out.join(index.select("file_id", F.lit(True).alias("indexed")), "file_id", "left").join(sent.select("file_id", F.lit(True).alias("queued")), "file_id", "left")
    return out.select("file_id", "is_private", "extraction_status", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("queued", F.lit(False)).alias("queued"))


@query("x12_reextract", "SELECT d.doc_id AS file_id, CASE WHEN extraction_status = 'processing' THEN 'rejected' WHEN is_private THEN 'private_noop' ELSE 'queued' END AS outcome, CASE WHEN extraction_status = 'processing' OR is_private THEN extraction_status ELSE 'pending' END AS new_status, NOT (coalesce(extraction_status, 'done') = 'processing' OR is_private) AS wipe_chunks FROM documents d JOIN files ON file_id = doc_id WHERE doc_id % 4 = 0", "files")
def x12(spark, sf):
    req = S.read_table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("file_id"))
    return L.reextract(req, S.read_files(spark, sf))
