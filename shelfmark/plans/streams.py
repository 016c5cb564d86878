"""Queries that run a stream to its end, and operators that other queries only use in passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from shelfmark.operators import catalogue as K
from shelfmark.operators import retrieval as R
from shelfmark.operators import search as Q
from shelfmark.plans import lifecycle, retrieval, search
from shelfmark.operators.index import bm25
from shelfmark.plans.base import query
from shelfmark.plans.catalogue import USAGE
from shelfmark.sources import tables as S
from shelfmark.sources.stored import BatchSink, shared_folder
from shelfmark.streaming import jobs


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    # The star lets the table be one file or a folder of them.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result after all its present input; each batch replaces or adds to what was there."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("x2_stream_dedupe", "SELECT DISTINCT doc_id % 20 AS user_id, sha256(text) AS file_hash FROM documents")
def x2(spark, sf):
    d = stream_of(spark, sf, "documents")
    ups = d.select((F.col("doc_id") % 20).alias("user_id"), F.sha2("text", 256).alias("file_hash"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    return finished(jobs.dedupe_stream(ups), "append").select("user_id", "file_hash")


@query("x10_usage_stream", USAGE, "ev")
def x10(spark, sf):
    e = stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(jobs.usage_stream(e), "complete")


#: Rows of one file of a stream's input; all batches have as many files as the largest needs.
FILE_ROWS = 250_000


def arriving(spark: SparkSession, df: DataFrame, parts: list) -> DataFrame:
    """A stream of ``df`` in as many batches as there are conditions ``parts``: rows arrive with the part they fulfil.

    ``df`` is read once.  A batch is a fixed number of files, so each part gets that many, whatever its size: every
    file begins with a row that only holds its place.
    """
    folder, sorted_out = shared_folder(spark, "arriving"), shared_folder(spark, "parts")
    found = F.explode(F.array(*[F.when(part, F.lit(i)) for i, part in enumerate(parts)]))
    df.withColumn("_part", found).where("_part IS NOT NULL").write.partitionBy("_part").parquet(sorted_out)
    rows = spark.read.schema(StructType([*df.schema, StructField("_part", IntegerType())])).parquet(sorted_out)
    most = max([r["count"] for r in rows.groupBy("_part").count().collect()], default=0)
    files = max(1, -(-most // FILE_ROWS))
    place = spark.range(files).select(F.col("id").cast("int").alias("_file"), F.lit(False).alias("_row"))
    for i in range(len(parts)):
        some = rows.where(F.col("_part") == i).drop("_part").withColumns({"_file": F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int"), "_row": F.lit(True)})
        some.unionByName(place, allowMissingColumns=True).repartitionById(files, F.col("_file")).drop("_file").write.parquet(f"{folder}/{i:04d}")
    stream = spark.readStream.schema(StructType([*df.schema, StructField("_row", BooleanType())])).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{folder}/*").where("_row").drop("_row")


def run_batches(stream: DataFrame, write, mode: str) -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_folder(stream.sparkSession, "state")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("x5_status_stream", lifecycle.STATUS_SQL, "ev")
def x5(spark, sf):
    """Four batches by a hash, so that most events come late, and every seventh event twice."""
    e = lifecycle.status_events(spark, sf).where("file_id IS NOT NULL")
    h = F.pmod(F.xxhash64("event_id"), F.lit(4))
    s = arriving(spark, e, [(h == i) | ((F.col("event_id") % 7 == 0) & (h == i - 1)) for i in range(5)])
    sink = BatchSink(spark, shared_folder(spark, "status"), jobs.STATUS, ["file_id"])
    run_batches(jobs.status_stream(s), jobs.into(sink), "update")
    return sink.read().drop("batch")


@query("x7_lockout_stream", lifecycle.LOCKOUTS, "ev")
def x7(spark, sf):
    """Ten days a batch; attempts at their ends come up to fifty minutes late, in any order.  A far attempt ends the stream."""
    e = lifecycle.logins(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(True).alias("ok"))
    e = e.unionByName(end)
    span = F.when(F.col("event_id") < 0, 3).otherwise(F.floor((F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000)) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 864000))
    s = arriving(spark, e, [span <= 0, span == 1, (span >= 2) & (F.col("event_id") >= 0), F.col("event_id") < 0])
    sink = BatchSink(spark, shared_folder(spark, "lockouts"), "user_id long, locked_at timestamp_ntz, until timestamp_ntz")
    run_batches(jobs.lockout_stream(s, failures=3), jobs.into(sink), "append")
    return sink.read().drop("batch")


@query("x10_usage_merged", USAGE, "ev")
def x10_merged(spark, sf):
    """Running totals in update mode, merged into one folder a day after every second batch."""
    e = S.read_events(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = arriving(spark, e, [F.dayofmonth("ts").between(a, a + 5) | ((a == 25) & (F.dayofmonth("ts") > 30)) for a in range(1, 30, 6)])
    sink = jobs.usage_sink(spark, shared_folder(spark, "usage"), most=2)
    run_batches(jobs.usage_stream(s), jobs.into(sink), "update")
    return sink.read().drop("batch")


@query(
    "x1_ingest_stream",
    "SELECT m.user_id, m.file_id, 'Documents' AS collection, is_private, CASE WHEN is_private THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) END AS n_chunks, 'work' AS sink FROM messages m JOIN documents ON doc_id = message_id WHERE reason IS NULL AND delivery_attempt <= 3 UNION ALL SELECT NULL, cast(message_id AS varchar), NULL, NULL, NULL, 'dead' FROM messages WHERE NOT (reason IS NULL AND delivery_attempt <= 3)",
    "messages",
)
def x1(spark, sf):
    """Three batches; what came in the first comes in the last again and changes nothing."""
    v = S.read_message_values(spark, sf)
    s = arriving(spark, v, [F.col("message_id") % 3 == 0, F.col("message_id") % 3 == 1, (F.col("message_id") % 3 == 2) | ((F.col("message_id") % 3 == 0) & F.col("value").contains("fileName") & (F.col("delivery_attempt") <= 3))])
    d = S.read_table(spark, sf, "documents").select((F.col("doc_id") % 20).cast("string").alias("user_id"), F.col("doc_id").cast("string").alias("file_id"), "text")
    sinks = jobs.IngestSinks(spark, shared_folder(spark, "ingest"), lambda files: d, lines)
    jobs.run_ingest(s, sinks, shared_folder(spark, "state")).awaitTermination()
    n = sinks.chunks.read().groupBy("user_id", "file_id").agg(F.count("*").alias("n"))
    rows = sinks.rows.read().join(n, ["user_id", "file_id"], "left").select("user_id", "file_id", "collection", "is_private", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.lit("work").alias("sink"))
    none = F.lit(None).cast("string")
    dead = sinks.dead.read().select(none.alias("user_id"), F.col("message_id").cast("string").alias("file_id"), none.alias("collection"), F.lit(None).cast("boolean").alias("is_private"), F.lit(None).cast("long").alias("n_chunks"), F.lit("dead").alias("sink"))
    return rows.unionByName(dead)


def lines(texts: DataFrame) -> DataFrame:
    c = texts.select("user_id", "file_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
    return c.where("length(chunk_text) > 0")


@query("s6_plain_text", "SELECT filename AS path, trim(text) AS text FROM files JOIN documents ON doc_id = file_id WHERE ends_with(filename, '.txt') AND length(trim(text)) > 0", "files")
def s6(spark, sf):
    d = S.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    return S.read_plain_text(S.read_files(spark, sf).join(d, "file_id").select(F.col("filename").alias("path"), "content"))


@query("w1_rank_files", "SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM (SELECT query_id, file_id, min(n) AS n FROM (SELECT vec_id % 7 AS query_id, file_id, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY round(embedding[1]::DOUBLE, 4) DESC, file_id, chunk_index) AS n FROM chunks) WHERE n <= 20 GROUP BY ALL)", "chunks")
def w1(spark, sf):
    hits = S.read_chunks(spark, sf).select((F.col("vec_id") % 7).alias("query_id"), F.lit("Documents").alias("collection"), "file_id", "chunk_index", F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))
    return Q.rank_files(hits, 20).select("query_id", "file_id", "rank")


@query("w2_best_row_per_key", "SELECT user_id, file_id FROM files QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) = 1", "files")
def w2(spark, sf):
    return K.best_per_key(S.read_files(spark, sf), ["user_id"], [F.desc("created_at"), F.col("file_id")]).select("user_id", "file_id")


@query("l3_l5_top_k", "SELECT collection, file_id, row_number() OVER (PARTITION BY collection ORDER BY created_at DESC, file_id) AS rank FROM files QUALIFY rank <= 20", "files")
def l3(spark, sf):
    return K.top_k(S.read_files(spark, sf), ["collection"], [F.desc("created_at"), F.col("file_id")], 20).select("collection", "file_id", "rank")


@query("p7_p12_wildcard_names", "SELECT query_id, file_id FROM queries JOIN files USING (user_id) WHERE regexp_matches(lower(filename), array_to_string(list_transform(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 0), lambda w: regexp_escape(w)), '.*')) AND length(filename) > 0", "queries", "files")
def p7(spark, sf):
    """Whole queries as patterns: a star between their words."""
    q = S.read_queries(spark, sf).select("query_id", "user_id", F.replace(F.lower("query"), F.lit(" "), F.lit("*")).alias("part"))
    return Q.names_like(q, S.read_files(spark, sf)).select("query_id", "file_id")


@query("j4_personalisation", "SELECT f.file_id, coalesce(access_count, 0) AS access_count, last_accessed_at FROM files f LEFT JOIN access a ON a.file_id = f.file_id", "files", "access")
def j4(spark, sf):
    f = S.read_files(spark, sf).select("file_id").join(S.read_access(spark, sf), "file_id", "left")
    return f.withColumn("access_count", F.coalesce("access_count", F.lit(0)))


@query("j7_vector_join", "SELECT query_id, chunk_index, score FROM file_hits", "chunks", "fileq", "file_hits")
def j7(spark, sf):
    return R.vector_scores(search.file_questions(spark, sf), search.owned_chunks(spark, sf))


@query("u4_distinct_parents", "SELECT query_id, n, body FROM blocks", *retrieval.RERANK, "blocks")
def u4(spark, sf):
    b = R.context_blocks(retrieval.passages(spark, sf))
    return b.select("query_id", "n", F.regexp_replace("block", r"^\[Chunk \d+\](?: \(contains a table\))?\n", "").alias("body"))


@query("l4_top_results", "SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM (SELECT query_id, file_id, max(score) AS score FROM b_sum GROUP BY ALL) QUALIFY rank <= 30", *search.BASE, "b_sum_t", "b_sum_p", "b_sum")
def l4(spark, sf):
    hits = bm25(search.prepared(spark, sf), search.file_index(spark, sf))
    return Q.top_results(hits.groupBy("query_id", "file_id").agg(F.max("score").alias("score"))).select("query_id", "file_id", "rank")
