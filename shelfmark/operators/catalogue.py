"""Catalogue operators: listings, deduplication, sinks, purges, tallies and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions.columns import collection_of, norm_filename, topic_of
from shelfmark.sources.tables import INDEX_SCHEMA, PLACEHOLDER

COLLECTIONS = ("Documents", "Images", "Media")
#: Order of the statuses in a list sorted by status; others come last.
STATUS_ORDER = ("failed", "processing", "pending", "done")


def collection_rank(c: Column) -> Column:
    out = F.lit(len(COLLECTIONS))
    for i, name in reversed(list(enumerate(COLLECTIONS))):
        out = F.when(c == name, i).otherwise(out)
    return out


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def file_text(summaries: DataFrame) -> DataFrame:
    """The body of a file, else its summary; the first collection that has the file counts."""
    one = best_per_key(summaries, ["user_id", "file_id"], [collection_rank(F.col("collection"))])
    return one.select("user_id", "file_id", F.coalesce(F.nullif("raw_text", F.lit("")), F.nullif("summary", F.lit("")), F.lit("")).alias("text"))


def list_files(files: DataFrame, summaries: DataFrame, collection: str = "all") -> DataFrame:
    """Catalogue rows; finished ones gain their summary and parsed index."""
    f = files.withColumn("status", F.coalesce("extraction_status", F.lit("done")))
    f = f if collection == "all" else f.where(F.col("collection") == collection)
    one = best_per_key(summaries, ["user_id", "file_id"], [collection_rank(F.col("collection"))]).select("user_id", "file_id", "summary", F.from_json("index_json", INDEX_SCHEMA).alias("index"), F.lit("done").alias("status"))
    return f.join(one, ["user_id", "file_id", "status"], "left")


def dedupe_uploads(incoming: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, duplicates) by (user, content hash), against the catalogue and within the batch."""
    n = F.row_number().over(W.partitionBy("user_id", "file_hash").orderBy("file_id"))
    known = files.select("user_id", "file_hash").distinct().withColumn("_known", F.lit(True))
    marked = incoming.withColumn("_n", n).join(known, ["user_id", "file_hash"], "left")
    fresh = F.col("_known").isNull() & (F.col("_n") == 1)
    return marked.where(fresh).drop("_n", "_known"), marked.where(~fresh).drop("_n", "_known")


def skip_indexed(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Messages whose file is not indexed yet."""
    return messages.join(summaries.select("user_id", "file_id"), ["user_id", "file_id"], "left_anti")


def to_messages(files: DataFrame) -> DataFrame:
    """Topic and JSON value of the message that asks for a file's extraction."""
    body = F.struct(F.col("file_id").cast("string").alias("_id"), F.col("user_id").cast("string").alias("userId"), norm_filename(F.col("filename")).alias("fileName"), F.col("filetype").alias("fileType"), F.concat(F.lit("https://storage.googleapis.com/b/"), "user_id", F.lit("/"), "file_hash").alias("gcsUrl"), F.col("is_private").alias("isPrivate"))
    return files.select("file_id", topic_of(F.col("filetype")).alias("topic"), F.to_json(body).alias("value"))


def route_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("topic", topic_of(F.col("filetype"))).withColumn("collection", collection_of(F.col("filetype")))


def build_summary_rows(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """K1: one index row per public file; images carry how they were processed, media their transcript's kind."""
    pub = files.where("NOT is_private").join(extracted, "file_id")
    kind = F.when(F.col("collection") == "Images", "caption").when(F.col("collection") == "Media", "transcript")
    return pub.select("file_id", "user_id", "collection", "filename", F.col("text").alias("summary"), F.col("text").alias("raw_text"), kind.alias("processing_type"), F.lit(False).alias("is_private"))


def private_stubs(files: DataFrame) -> DataFrame:
    """K2: index rows of private files: a placeholder, no body, no vector."""
    kind = F.when(F.col("collection") == "Images", "private")
    return files.where("is_private").select("file_id", "user_id", "collection", "filename", F.lit(PLACEHOLDER).alias("summary"), F.lit("").alias("raw_text"), kind.alias("processing_type"), F.lit(True).alias("is_private"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K3: rows of the keys in ``new`` are replaced; the others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def load_report(rows: DataFrame) -> DataFrame:
    """K4: inserted, skipped and all rows; a row without text or vector is skipped."""
    ok = F.col("embedding").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)
    return rows.agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("skipped"), F.count("*").alias("total"))


def evolve(df: DataFrame, target: DataFrame) -> DataFrame:
    """K5: the columns of ``target`` that are missing are added; none goes or changes type."""
    return df.unionByName(target.limit(0), allowMissingColumns=True)


def purge_files(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """K6: all tables without the files in ``keys`` (user_id, file_id)."""
    return {n: t.join(keys.select("user_id", "file_id"), ["user_id", "file_id"], "left_anti") for n, t in tables.items()}


def purge_users(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """K7: all tables without the users in ``users``."""
    return {n: t.join(users.select("user_id"), "user_id", "left_anti") for n, t in tables.items()}


def filter_files(files: DataFrame, kind: str) -> DataFrame:
    """P5."""
    where = {"all": "true", "images": "filetype LIKE 'image/%'", "media": "filetype LIKE 'audio/%' OR filetype LIKE 'video/%'", "docs": "NOT (filetype LIKE 'image/%' OR filetype LIKE 'audio/%' OR filetype LIKE 'video/%')", "failed": "extraction_status = 'failed'"}
    return files.where(where[kind])


def search_filename(files: DataFrame, text: str) -> DataFrame:
    """P6."""
    return files.where(F.contains(F.lower("filename"), F.lit(text.strip().lower())))


def split_private(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: (private, public)."""
    p = F.coalesce("is_private", F.lit(False))
    return df.where(p), df.where(~p)


def chat_readiness(files: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether a file can be asked about, whether its chunks exist, and why not."""
    have = chunks.select("file_id").distinct().withColumn("cached", F.lit(True))
    f = files.join(file_text(summaries), ["user_id", "file_id"], "left").join(have, "file_id", "left")
    status = F.coalesce("extraction_status", F.lit("done"))
    reason = F.when(F.col("is_private"), "private").when(status == "failed", "failed").when(status != "done", "not_ready").when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "no_text")
    return f.select("user_id", "file_id", reason.isNull().alias("ready"), (F.coalesce("cached", F.lit(False)) & reason.isNull()).alias("cached"), reason.alias("reason"))


def preview(texts: DataFrame, n: int = 200_000) -> DataFrame:
    """P13."""
    return texts.withColumns({"preview": F.substring("text", 1, n), "truncated": F.length("text") > n, "full_length": F.length("text").cast("long")}).drop("text")


def validate_queries(queries: DataFrame, longest: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason)."""
    reason = F.when(F.length(F.trim(F.coalesce("query", F.lit("")))) == 0, "empty").when(F.length("query") > longest, "too_long")
    q = queries.withColumn("reason", reason)
    return q.where("reason IS NULL").drop("reason"), q.where("reason IS NOT NULL")


def normalise_clicks(clicks: DataFrame) -> DataFrame:
    """Ranks from 1 to 100; the query lower-cased, trimmed, at most 500 characters."""
    return clicks.where("rank >= 1").withColumns({"rank": F.least("rank", F.lit(100)), "query": F.substring(F.trim(F.lower("query")), 1, 500)})


def quick_kind(filetype: Column, filename: Column) -> Column:
    """The kind of file that can be read at once, by MIME type or name, else null."""
    m, n = F.lower(F.coalesce(filetype, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    pdf = (m == "application/pdf") | n.endswith(".pdf")
    docx = m.contains("officedocument.wordprocessingml") | n.endswith(".docx")
    markdown = m.contains("markdown") | n.rlike(r"\.(md|markdown)$")
    text = m.startswith("text/") | n.rlike(r"\.(txt|log|csv|json|html|htm|xml|yml|yaml)$")
    return F.when(pdf, "pdf").when(docx, "docx").when(markdown, "markdown").when(text, "text")


def classify_blobs(blobs: DataFrame, most: int = 20 * 1024 * 1024) -> DataFrame:
    """Kind and the reason for a rejection; needs filetype, filename, length."""
    kind = quick_kind(F.col("filetype"), F.col("filename"))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large").when(kind.isNull(), "unsupported")
    return blobs.withColumns({"kind": kind, "reason": reason})


def catalogue_view(files: DataFrame) -> DataFrame:
    """What a listing shows; progress only while work goes on."""
    status = F.coalesce("extraction_status", F.lit("done"))
    return files.select(F.col("file_id").alias("id"), F.col("filename").alias("name"), F.col("filetype").alias("type"), status.alias("status"), F.when(status.isin("pending", "processing"), F.lit("queued")).alias("progress"), F.col("created_at").alias("uploaded_at"))


def collection_counts(files: DataFrame) -> DataFrame:
    """A1: files per user and collection, and in all."""
    return files.groupBy("user_id").agg(*[F.count_if(F.col("collection") == c).alias(c.lower()) for c in COLLECTIONS], F.count("*").alias("total"))


def status_counts(files: DataFrame) -> DataFrame:
    """A2."""
    s = F.coalesce("extraction_status", F.lit("done"))
    kinds = {"images": F.col("collection") == "Images", "media": F.col("collection") == "Media", "docs": F.col("collection") == "Documents"}
    return files.groupBy("user_id").agg(F.count_if(s.isin("pending", "processing")).alias("in_flight"), F.count_if(s == "failed").alias("failed"), *[F.count_if(c).alias(n) for n, c in kinds.items()], F.count("*").alias("all_files"))


def usage_daily(events: DataFrame) -> DataFrame:
    """A3: messages per user and day (UTC): clicks stand for persistent, views for ephemeral chats."""
    e = events.where("event_type IN ('click', 'view')")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "click").alias("persistent"), F.count_if(F.col("event_type") == "view").alias("ephemeral"))


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """A3: additive upsert."""
    return old.unionByName(new).groupBy("user_id", "day").agg(*[F.sum(c).alias(c) for c in ("messages", "persistent", "ephemeral")])


def ctr_at_1(clicks: DataFrame) -> DataFrame:
    """A5: share of clicks on the first result, per day."""
    return clicks.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_clicks"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("ctr1"))


def zero_click(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """Searches (user_id, query_id) that led to no click, counted per user."""
    return searches.select("user_id", "query_id").distinct().join(clicks, ["user_id", "query_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n_zero_click"))


def click_pairs(clicks: DataFrame) -> DataFrame:
    """A7."""
    return clicks.groupBy("query_id", "file_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_clicks"))


# Error codes that reports know (A17); others count as unknown.
ERROR_CODES = ("download_failed", "extraction_failed", "no_content", "llm_failed", "embedding_failed", "storage_failed", "unsupported_type", "invalid_message", "unknown")


def failure_report(results: DataFrame) -> DataFrame:
    """Failures per error code and collection."""
    code = F.when(F.col("error_code").isin(*ERROR_CODES), F.col("error_code")).otherwise("unknown")
    return results.where("status = 'failed'").groupBy(code.alias("error_kind"), "collection").agg(F.count("*").alias("n"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Runs, failures and duration percentiles of each stage."""
    return stages.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.percentile("ms", 0.5), 4).alias("p50"), F.round(F.percentile("ms", 0.95), 4).alias("p95"))


def stage_sketches(stages: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """A16 in parts: runs, failures and a quantile sketch of the durations of each stage and part ``by``, to be kept and merged."""
    return stages.groupBy("stage", *by).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.kll_sketch_agg_double("ms", k).alias("sketch"))


def merged_summary(sketches: DataFrame, ranks: dict[str, float] | None = None, k: int = 400) -> DataFrame:
    """A16 from kept parts: runs, failures and durations at the given ranks, whose error in rank is about 4.6 / k."""
    m = sketches.groupBy("stage").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    return m.select("stage", "n", "failures", *[F.kll_sketch_get_quantile_double("_s", F.lit(r)).alias(c) for c, r in (ranks or {"p50": 0.5, "p95": 0.95}).items()])


def merge_partials(partials: DataFrame, most_insights: int = 8) -> DataFrame:
    """One row per file from partial results (file_id, part, overview, insights, entities).

    Lists are united in order, case-insensitively, the first spelling staying;
    insights are capped; overviews are joined under section marks.
    """
    out = partials.where("length(trim(coalesce(overview, ''))) > 0").groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "overview"))), lambda x: F.concat(F.lit("[Section "), (x["part"] + 1).cast("string"), F.lit("] "), x["overview"])), "\n").alias("overview"))
    for name, most in (("insights", most_insights), ("entities", None)):
        items = partials.select("file_id", "part", F.posexplode(name).alias("pos", "item")).withColumn("item", F.trim("item")).where("item != ''")
        first = items.groupBy("file_id", F.lower("item").alias("_low")).agg(F.min(F.struct("part", "pos", "item")).alias("x"))
        lists = first.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias(name))
        out = out.join(lists.withColumn(name, F.slice(name, 1, most)) if most else lists, "file_id", "left")
    return out


def sort_files(files: DataFrame, kind: str) -> DataFrame:
    """L2: files with their place ``pos`` in each user's list."""
    s = F.coalesce("extraction_status", F.lit("done"))
    rank = F.lit(len(STATUS_ORDER))
    for i, x in reversed(list(enumerate(STATUS_ORDER))):
        rank = F.when(s == x, i).otherwise(rank)
    order = {"newest": [F.desc("created_at")], "oldest": [F.col("created_at")], "name": [F.lower("filename")], "type": [F.col("filetype")], "status": [rank]}[kind]
    return files.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy(*order, "file_id")))


def newest_files(summaries: DataFrame, n: int = 50) -> DataFrame:
    """L1, Q13: at most n newest of each user's collections, listed together."""
    order = [F.desc("created_at"), F.col("file_id")]
    some = top_k(summaries, ["user_id", "collection"], order, n, "_rn").drop("_rn")
    return some.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))


def entity_panel(files: DataFrame) -> DataFrame:
    """Categories of a file's index that hold something, with their labels; needs column ``index``."""
    labels = {"entities": "Entities", "document_ids": "Document IDs", "technical_topics": "Topics", "relevant_dates": "Dates", "key_numbers": "Key numbers"}
    pairs = F.array(*[F.struct(F.lit(v).alias("label"), F.filter(F.col(f"index.{k}"), lambda x: F.trim(x) != "").alias("items")) for k, v in labels.items()])
    return files.select("file_id", F.explode(pairs).alias("p")).where("size(p.items) > 0").select("file_id", "p.label", "p.items")


def last_turns(turns: DataFrame, n: int, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last n turns of the given roles."""
    return turns.where(F.col("role").isin(*roles)).withColumn("_rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_rn") <= n).drop("_rn")


def truncate_for_regenerate(turns: DataFrame) -> DataFrame:
    """Turns before the last user turn."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return turns.withColumn("_last", last).where("turn < _last").drop("_last")


def federate(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
