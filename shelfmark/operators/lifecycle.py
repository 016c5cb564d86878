"""Lifecycle of files, sessions and events, as batch operators; ``shelfmark.streaming`` runs them continuously."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.operators.catalogue import skip_indexed, to_messages, top_k


def route_dead_letters(valid: DataFrame, rejected: DataFrame, most: int = 3) -> DataFrame:
    """What happens to each message: process, dead_letter (tried too often) or discard (not readable)."""
    late = F.when(F.col("delivery_attempt") > most, "dead_letter").otherwise("process")
    return valid.select("message_id", late.alias("route"), F.when(late == "dead_letter", "too_many_attempts").alias("reason")).unionByName(rejected.select("message_id", F.lit("discard").alias("route"), "reason"))


def ingest_batch(valid: DataFrame, indexed: DataFrame) -> DataFrame:
    """A batch's messages that are to be processed: tried few enough times, one per file, not indexed yet."""
    one = top_k(valid.where("delivery_attempt <= 3"), ["user_id", "file_id"], [F.col("message_id")], 1, "_n").drop("_n")
    return skip_indexed(one, indexed)


def sweep_orphans(files: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Files whose processing began too long ago go back to pending, with the reason."""
    stuck = (F.col("extraction_status") == "processing") & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return files.withColumns({"extraction_status": F.when(stuck, "pending").otherwise(F.col("extraction_status")), "reason": F.when(stuck, "stuck_in_processing")})


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each file; an error text is cut to 1000 characters and goes when the file is done."""
    last = F.max_by(F.struct("status", "error"), F.struct("ts", "event_id")).alias("l")
    s = events.groupBy("file_id").agg(last, F.count("*").alias("n_events"))
    return s.select("file_id", "l.status", F.when(F.col("l.status") != "done", F.substring("l.error", 1, 1000)).alias("error"), "n_events")


def rate_breaches(events: DataFrame, window: str, most: int) -> DataFrame:
    """Users with more than ``most`` events in a tumbling window."""
    n = events.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return n.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begins"), "n")


def lockout_step(n: int, until: int, last: int, us: int, ok: bool, failures: int, span: int, idle: int) -> tuple[int, int, int, bool]:
    """One attempt at ``us`` (all times in microseconds): (failures in a row, end of the lock, last attempt, whether it locks)."""
    if n and us - last > idle:
        n = 0
    if us < until:
        return n, until, us, False
    n = 0 if ok else n + 1
    return (0, us + span, us, True) if n >= failures else (n, until, us, False)


def lockouts(events: DataFrame, failures: int = 5, minutes: int = 15, idle: timedelta = timedelta(days=90)) -> DataFrame:
    """When users were locked out: ``failures`` failed logins in a row; attempts while locked don't count, a success resets, as does a time of ``idle`` without attempts.

    Events: event_id, user_id, ts, ok; those without ts don't count.  A user's events pass in order and are never held together.
    """
    span, most = minutes * 60_000_000, int(idle.total_seconds()) * 1_000_000
    schema = pa.schema([("user_id", pa.int64()), ("locked_at", pa.int64()), ("until", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, n, until, last = object(), 0, 0, 0
        for batch in batches:
            out = []
            for u, us, ok in zip(*(batch.column(c).to_pylist() for c in ("user_id", "us", "ok")), strict=True):
                if u != user:
                    user, n, until, last = u, 0, 0, 0
                n, until, last, locked = lockout_step(n, until, last, us, ok, failures, span, most)
                if locked:
                    out.append((u, us, until))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    e = events.where("ts IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "ok")
    ordered = e.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    found = ordered.mapInArrow(run, "user_id long, locked_at long, until long")
    micros = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return found.select("user_id", micros("locked_at"), micros("until"))


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions that end after ``minutes`` without an event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    e = events.withColumn("session_no", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session_no").agg(F.min("ts").alias("begins"), F.max("ts").alias("last_used"), F.count("*").alias("n_events"))


def newest_sessions(found: DataFrame, k: int = 5) -> DataFrame:
    """At most k sessions of each user, by last use."""
    return top_k(found, ["user_id"], [F.desc("last_used"), F.col("session_no")], k)


def session_stats(live: DataFrame) -> DataFrame:
    """Live sessions per user, and in all (null user)."""
    return live.rollup("user_id").agg(F.count("*").alias("n_sessions"))


def retain(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows that are at most ``days`` old."""
    return df.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def apply_privacy_changes(changes: DataFrame, files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X11: (files, index, messages) after changes (file_id, make_private); what does not change is left alone."""
    f = files.join(changes, "file_id", "left").withColumn("_c", F.coalesce(F.col("make_private") != F.col("is_private"), F.lit(False)))
    moved = f.where("_c").select("file_id")
    out = f.withColumns({"is_private": F.when(F.col("_c"), F.col("make_private")).otherwise(F.col("is_private")), "extraction_status": F.when(F.col("_c"), "pending").otherwise(F.col("extraction_status"))})
    return out.drop("_c", "make_private"), index.join(moved, "file_id", "left_anti"), to_messages(out.where("_c"))


def reextract(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The outcome of each request (file_id): rejected while processing, nothing to do for private files, else queued."""
    status = F.coalesce("extraction_status", F.lit("done"))
    outcome = F.when(F.col("filename").isNull(), "unknown_file").when(status == "processing", "rejected").when(F.col("is_private"), "private_noop").otherwise("queued")
    r = requests.select("file_id").distinct().join(files, "file_id", "left")
    return r.select("file_id", outcome.alias("outcome"), F.when(outcome == "queued", "pending").otherwise(F.col("extraction_status")).alias("new_status"), (outcome == "queued").alias("wipe_chunks"))
