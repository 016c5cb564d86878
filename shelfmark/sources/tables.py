"""Readers, and the views over the driver's tables that stand for catalogue, index and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = "This file is private. Only its name can be searched."

INDEX_SCHEMA = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("entities", "relevant_dates", "document_ids", "technical_topics", "key_numbers")])

MESSAGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("_id", "userId", "fileName", "fileType", "gcsUrl", "uploadedAt")] + [T.StructField("isPrivate", T.BooleanType()), T.StructField("_corrupt_record", T.StringType())]
)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_files(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """The file catalogue, with ``more`` columns of the same rows."""
    d = read_table(spark, path, "documents")
    m10, m11 = F.col("doc_id") % 10, F.col("doc_id") % 11
    ext = F.when(m10 == 0, ".png").when(m10 == 1, ".mp3").when(m10 == 2, ".mp4").when(m10 == 3, ".pdf").otherwise(".txt")
    kind = F.when(m10 == 0, "image/png").when(m10 == 1, "audio/mpeg").when(m10 == 2, "video/mp4").when(m10 == 3, "application/pdf").otherwise("text/plain")
    status = F.when(m11 == 0, "failed").when(m11 == 1, "pending").when(m11 == 2, "processing").when(m11 == 3, None).otherwise("done")
    return d.select(
        F.col("doc_id").alias("file_id"),
        (F.col("doc_id") % 20).alias("user_id"),
        F.concat("source", F.lit("_"), "lang", F.lit("_report_v"), (F.col("doc_id") % 3).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), ext).alias("filename"),
        kind.alias("filetype"),
        F.when(m10 == 0, "Images").when(m10.isin(1, 2), "Media").otherwise("Documents").alias("collection"),
        F.sha2("text", 256).alias("file_hash"),
        status.alias("extraction_status"),
        (F.col("doc_id") % 17 == 0).alias("is_private"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((doc_id * 37) % 43200 AS int), 0)").alias("created_at"),
        *more,
    )


def read_summaries(spark: SparkSession, path: str, collection: str = "all") -> DataFrame:
    """One row per file; an unknown collection gives no rows."""
    private = F.col("is_private")
    index = F.to_json(
        F.struct(
            F.array("source", F.upper("source"), "lang").alias("entities"),
            F.array(F.lit("2024-01-01")).alias("relevant_dates"),
            F.array(F.concat(F.lit("INV-"), F.col("file_id").cast("string"))).alias("document_ids"),
            F.array("lang").alias("technical_topics"),
            F.array(F.concat(F.lit("chars: "), F.col("n_chars").cast("string"))).alias("key_numbers"),
        )
    )
    out = read_files(spark, path, "text", "lang", "source", "n_chars").select(
        "file_id",
        "user_id",
        "collection",
        "filename",
        F.when(private, PLACEHOLDER).otherwise(F.col("text")).alias("summary"),
        F.when(private, "").otherwise(F.col("text")).alias("raw_text"),
        F.when(~private, index).alias("index_json"),
        "is_private",
        "created_at",
    )
    return out if collection == "all" else out.where(F.col("collection") == collection)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """S3: chunk vectors; file_id and chunk_index are the key.  A file has five, and there are 100 files at least."""
    e = read_table(spark, path, "embeddings")
    n = max(100, e.count() // 5)
    return e.select("vec_id", (F.col("vec_id") % n).alias("file_id"), F.floor(F.col("vec_id") / n).alias("chunk_index"), "embedding")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Search queries: the benchmark passages, for each user the kinds of files that the user has, and for each user and language the name of a file (ids below 0)."""
    b = read_table(spark, path, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.col("item_id") % 20).alias("user_id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("query"),
    )
    f = read_files(spark, path, "source", "lang")
    kinds = f.groupBy("user_id", "source", "lang").agg((-1 - F.min("file_id")).alias("query_id"))
    named = f.groupBy("user_id", "lang").agg((-1000000000000 - F.max("file_id")).alias("query_id"), F.max_by(F.substring_index("filename", ".", 1), "file_id").alias("query"))
    return b.union(kinds.select("query_id", "user_id", F.concat("source", F.lit(" "), "lang", F.lit(" report")))).union(named.select("query_id", "user_id", "query"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    e = read_table(spark, path, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    e = read_events(spark, path).where("event_type = 'click'")
    return e.select("event_id", "user_id", (F.col("event_id") % 40).alias("query_id"), F.col("k").alias("file_id"), (1 + F.col("event_id") % 13).alias("rank"), "ts")


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """A4: how often and when each file was last opened."""
    e = read_events(spark, path).where("event_type IN ('view', 'click')")
    return e.groupBy(F.col("k").alias("file_id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed_at"))


def read_message_values(spark: SparkSession, path: str) -> DataFrame:
    """Queue messages as they arrive: message_id, value, delivery_attempt."""
    d = read_table(spark, path, "documents")
    i = F.col("doc_id").cast("string")
    user = (F.col("doc_id") % 20).cast("string")
    full = F.concat(
        F.lit('{"_id":"'), i, F.lit('","userId":"'), user, F.lit('","fileName":"f '), i, F.lit('.txt","fileType":"Text/Plain","gcsUrl":"https://storage.googleapis.com/b/'), user, F.lit("/"), i,
        F.lit('","isPrivate":'), F.when(F.col("doc_id") % 17 == 0, "true").otherwise("false"), F.lit("}"),
    )
    only_id = F.concat(F.lit('{"_id":"'), i, F.lit('"}'))
    value = F.when(F.col("doc_id") % 29 == 0, "{bad").when(F.col("doc_id") % 31 == 0, only_id).otherwise(full)
    return d.select(F.col("doc_id").alias("message_id"), value.alias("value"), (F.col("doc_id") % 6).cast("int").alias("delivery_attempt"))


def parse_messages(values: DataFrame) -> DataFrame:
    """Parsed messages with a reason for rejection (null if valid)."""
    m = F.from_json("value", MESSAGE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    p = values.withColumn("m", m)
    missing = F.filter(F.array(*[F.when(F.col(f"m.{c}").isNull(), F.lit(c)) for c in ("_id", "userId", "fileName", "gcsUrl")]), lambda x: x.isNotNull())
    reason = F.when(F.col("m._corrupt_record").isNotNull() | F.col("m").isNull(), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    return p.withColumn("reason", reason)


def read_messages(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); works on batches and on streams."""
    p = parse_messages(values)
    valid = p.where("reason IS NULL").select(
        "message_id", F.col("m._id").alias("file_id"), F.col("m.userId").alias("user_id"), F.col("m.fileName").alias("filename"), F.col("m.fileType").alias("filetype"),
        F.col("m.gcsUrl").alias("url"), F.coalesce("m.isPrivate", F.lit(False)).alias("is_private"), "delivery_attempt",
    )
    return valid, p.where("reason IS NOT NULL").select("message_id", "value", "reason", "delivery_attempt")


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Path, length, modificationTime and content of the files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def parse_blob_url(url: Column) -> Column:
    """Bucket and key of ``https://host/bucket/key``."""
    at = r"^https://[^/]+/([^/]+)/(.+)$"
    return F.struct(F.nullif(F.regexp_extract(url, at, 1), F.lit("")).alias("bucket"), F.nullif(F.regexp_extract(url, at, 2), F.lit("")).alias("key"))


# Extensions of the files that are read as plain text.
TEXT_EXTENSIONS = tuple("txt md log csv tsv py js ts java go sql json yaml yml sh".split())


def read_plain_text(blobs: DataFrame) -> DataFrame:
    """Path and trimmed text of blobs with a known extension; bytes that are no UTF-8 are replaced, empty texts go."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = blobs.where(ext.isin(*TEXT_EXTENSIONS)).select("path", F.trim(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return out.where("length(text) > 0")
