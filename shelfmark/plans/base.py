"""How queries are registered, and the SQL of the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.tables import PLACEHOLDER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "files": """SELECT doc_id AS file_id, doc_id % 20 AS user_id,
  concat(source,'_',lang,'_report_v',cast(doc_id % 3 AS varchar),'_',cast(doc_id AS varchar),
    CASE WHEN doc_id % 10 = 0 THEN '.png' WHEN doc_id % 10 = 1 THEN '.mp3' WHEN doc_id % 10 = 2 THEN '.mp4' WHEN doc_id % 10 = 3 THEN '.pdf' ELSE '.txt' END) AS filename,
  CASE WHEN doc_id % 10 = 0 THEN 'image/png' WHEN doc_id % 10 = 1 THEN 'audio/mpeg' WHEN doc_id % 10 = 2 THEN 'video/mp4' WHEN doc_id % 10 = 3 THEN 'application/pdf' ELSE 'text/plain' END AS filetype,
  CASE WHEN doc_id % 10 = 0 THEN 'Images' WHEN doc_id % 10 IN (1,2) THEN 'Media' ELSE 'Documents' END AS collection,
  sha256(text) AS file_hash,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 11 = 1 THEN 'pending' WHEN doc_id % 11 = 2 THEN 'processing' WHEN doc_id % 11 = 3 THEN NULL ELSE 'done' END AS extraction_status,
  doc_id % 17 = 0 AS is_private, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast((doc_id*37) % 43200 AS bigint)) AS created_at FROM documents""",
    "summaries": f"""SELECT f.file_id, f.user_id, f.collection, f.filename, CASE WHEN is_private THEN '{PLACEHOLDER}' ELSE d.text END AS summary,
  CASE WHEN is_private THEN '' ELSE d.text END AS raw_text, is_private, created_at, d.lang, d.source, d.n_chars FROM files f JOIN documents d ON d.doc_id = f.file_id""",
    "queries": """SELECT item_id AS query_id, item_id % 20 AS user_id, replace(text, chr(10), ' ') AS query FROM benchmark
  UNION ALL SELECT -1 - min(doc_id), doc_id % 20, concat(source,' ',lang,' report') FROM documents GROUP BY doc_id % 20, source, lang
  UNION ALL SELECT -1000000000000 - max(file_id), user_id, string_split(arg_max(filename, file_id), '.')[1] FROM files JOIN documents ON doc_id = file_id GROUP BY user_id, lang""",
    "ev": "SELECT event_id, ts, user_id, event_type, value, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events",
    "clicks": "SELECT event_id, user_id, event_id % 40 AS query_id, k AS file_id, 1 + event_id % 13 AS rank, ts FROM ev WHERE event_type = 'click'",
    "access": "SELECT k AS file_id, count(*) AS access_count, max(ts) AS last_accessed_at FROM ev WHERE event_type IN ('view','click') GROUP BY k",
    "chunks": "SELECT vec_id, vec_id % n AS file_id, vec_id // n AS chunk_index, embedding FROM embeddings, (SELECT greatest(100, count(*) // 5) AS n FROM embeddings)",
    "messages": """SELECT doc_id AS message_id, CASE WHEN doc_id % 29 = 0 THEN 'malformed' WHEN doc_id % 31 = 0 THEN 'missing:userId,fileName,gcsUrl' END AS reason, cast(doc_id % 6 AS integer) AS delivery_attempt,
  cast(doc_id AS varchar) AS file_id, cast(doc_id % 20 AS varchar) AS user_id, 'f ' || doc_id || '.txt' AS filename, 'Text/Plain' AS filetype,
  'https://storage.googleapis.com/b/' || (doc_id % 20) || '/' || doc_id AS url, doc_id % 17 = 0 AS is_private FROM documents""",
}
NEEDS = {"summaries": ["files"], "queries": ["files"], "clicks": ["ev"], "access": ["ev"]}


def with_views(body: str, *names: str) -> str:
    """``body`` after a WITH clause of the named views; a body that begins with WITH goes on with its own."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir), and its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views)
        return f

    return add
