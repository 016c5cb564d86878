"""Structured Streaming jobs over the lifecycle operators.

Each takes a streaming DataFrame and returns one, or a started query.  State is
bounded by watermarks; files and sinks are written in ``foreachBatch``, which may
run a batch twice, so those writes are keyed by batch or idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from shelfmark.functions.columns import collection_of, norm_filename
from shelfmark.operators.catalogue import route_messages
from shelfmark.operators.lifecycle import ingest_batch, lockout_step, route_dead_letters
from shelfmark.sources.stored import BatchSink, settled, user_bucket
from shelfmark.sources.tables import PLACEHOLDER, read_messages


def dedupe_stream(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first upload of each (user, content hash) within the watermark; needs ts."""
    return uploads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "file_hash"])


def usage_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A3 per user and day, for update or append mode."""
    e = events.where("event_type IN ('click', 'view')").withWatermark("ts", delay)
    n = e.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "click").alias("persistent"), F.count_if(F.col("event_type") == "view").alias("ephemeral"))
    return n.select("user_id", F.to_date("w.start").alias("day"), "messages", "persistent", "ephemeral")


USAGE = "user_id long, day date, messages long, persistent long, ephemeral long"


def usage_sink(spark: SparkSession, path: str, most: int = 16) -> BatchSink:
    """The totals per user and day that ``usage_stream`` gives in update mode: a later batch's row of a key replaces the earlier one's; merged into folders by day."""
    return BatchSink(spark, path, USAGE, ["user_id", "day"], {"day": F.col("day")}, most)


def into(sink: BatchSink) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function that writes to ``sink``."""
    return lambda batch, number: sink.write(batch, number)


class IngestSinks:
    """Where the batches of messages go: what is to be processed, what is not, and the index rows, stubs and chunks of what was.

    Each is a ``BatchSink``, so a batch that runs twice changes nothing, and a file that comes again replaces its
    own rows (K1, K2, K3).  ``text`` gives a file's text (user_id, file_id, text) for a batch's files; ``chunk``
    makes rows of (user_id, file_id, chunk_index, chunk_text) of them.
    """

    WORK = "message_id long, user_id string, file_id string, filename string, topic string"
    DEAD = "message_id long, route string, reason string"
    ROW = "user_id string, file_id string, collection string, filename string, summary string, raw_text string, is_private boolean"
    CHUNK = "user_id string, file_id string, chunk_index int, chunk_text string"

    def __init__(self, spark: SparkSession, path: str, text: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], most: int = 16, buckets: int = 16) -> None:
        file, place = ["user_id", "file_id"], {"bucket": user_bucket(buckets)}
        self.text, self.chunk = text, chunk
        self.work = BatchSink(spark, f"{path}/work", self.WORK, None, None, most)
        self.dead = BatchSink(spark, f"{path}/dead_letters", self.DEAD, None, None, most)
        self.rows = BatchSink(spark, f"{path}/rows", self.ROW, file, {"collection": F.col("collection"), **place}, most)
        self.chunks = BatchSink(spark, f"{path}/chunks", self.CHUNK, file, place, most)

    def indexed(self) -> DataFrame:
        """Keys of the files that have a row."""
        return self.rows.read().select("user_id", "file_id")

    def write(self, batch: DataFrame, number: int) -> None:
        if all(s.has(number) for s in (self.work, self.dead, self.rows, self.chunks)):
            return
        # The messages of a batch are read once; a run that is repeated must not see its own rows as indexed.
        values = settled(batch)
        valid, rejected = read_messages(values)
        self.dead.write(route_dead_letters(valid, rejected).where("route != 'process'"), number)
        before = self.rows.read().where(F.col("batch") < number).select("user_id", "file_id")
        taken = settled(ingest_batch(valid, before))
        self.work.write(route_messages(taken).select("message_id", "user_id", "file_id", "filename", "topic"), number)
        texts = taken.where("NOT is_private").select("user_id", "file_id").join(self.text(taken), ["user_id", "file_id"])
        self.chunks.write(self.chunk(texts), number)
        f = taken.select("user_id", "file_id", collection_of(F.col("filetype")).alias("collection"), norm_filename(F.col("filename")).alias("filename"), "is_private")
        body = f.join(texts, ["user_id", "file_id"], "left")
        public = F.when(F.col("is_private"), "").otherwise(F.coalesce("text", F.lit("")))
        # The rows go last: a file counts as indexed when all else is there.
        self.rows.write(body.withColumns({"raw_text": public, "summary": F.when(F.col("is_private"), PLACEHOLDER).otherwise(public)}), number)


def run_ingest(values: DataFrame, sinks: IngestSinks, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Read messages, route them, skip what is indexed, and write all sinks, batch by batch."""
    return values.writeStream.foreachBatch(sinks.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATUS = "file_id long, status string, error string, n_events long"


def status_stream(events: DataFrame, delay: str = "40 days", ttl: timedelta = timedelta(days=30)) -> DataFrame:
    """X5 as a stream, for update mode: a row for each file of a batch, its last status so far by (ts, event_id).

    Events: event_id, ts, file_id, status, error.  Late events change nothing but the count, repeated ones nothing
    at all, and those later than ``delay`` are dropped.  A file's state, with the ids of its events, is forgotten when
    the watermark is ``ttl`` beyond its last event.
    """
    keep = int(ttl.total_seconds() * 1000)

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *last, seen = state.get if state.exists else (None, None, None, None, [])
        known = set(seen)
        for part in parts:
            for us, event, status, error in zip(*(part[c].tolist() for c in ("us", "event_id", "status", "error")), strict=True):
                if event not in known:
                    known.add(event)
                    if last[0] is None or (us, event) > (last[0], last[1]):
                        last = [int(us), int(event), status, None if pd.isna(error) else error]
        state.update((*last, [int(x) for x in known]))
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs(), 0) + keep)
        error = None if last[2] == "done" or last[3] is None else last[3][:1000]
        yield pd.DataFrame({"file_id": [key[0]], "status": [last[2]], "error": pd.Series([error], dtype=object), "n_events": [len(known)]})

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    e = e.select("file_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "status", "error")
    return e.groupBy("file_id").applyInPandasWithState(update, STATUS, "us long, event_id long, status string, error string, seen array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def lockout_stream(events: DataFrame, delay: str = "1 hour", failures: int = 5, minutes: int = 15, idle: timedelta = timedelta(days=90)) -> DataFrame:
    """X7 as a stream, for append mode: what ``lockouts`` gives, when the watermark has passed it.

    Attempts may come in any order within ``delay``; later ones are dropped.  They wait in the user's state until
    the watermark has passed them, and then count in order: an event-time timer stands at the first that waits.
    A user without attempts for ``idle`` is forgotten, by the same timer.
    """
    span, most = minutes * 60_000_000, int(idle.total_seconds()) * 1_000_000

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until, last, *waiting = state.get if state.exists else (0, 0, 0, [], [], [])
        rows = list(zip(*waiting, strict=True))
        if not state.hasTimedOut:
            rows += [(int(us), int(event), bool(ok)) for part in parts for us, event, ok in part[["us", "event_id", "ok"]].itertuples(index=False)]
        rows.sort()
        now = max(state.getCurrentWatermarkMs(), 0) * 1000
        ready = sum(r[0] < now for r in rows)
        out = []
        for us, _, ok in rows[:ready]:
            n, until, last, locked = lockout_step(n, until, last, us, ok, failures, span, most)
            if locked:
                out.append((key[0], us, until))
        rows = rows[ready:]
        if rows or (n or until > now) and last + most >= now:
            state.update((n, until, last, *([r[i] for r in rows] for i in range(3))))
            # A timer has to stand after the watermark.
            state.setTimeoutTimestamp(max((rows[0][0] if rows else last + most) // 1000 + 1, now // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "locked_at", "until"]).astype("int64")

    e = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "ok").withWatermark("ts", delay)
    found = e.withColumn("us", F.unix_micros("ts")).groupBy("user_id").applyInPandasWithState(
        update, "user_id long, locked_at long, until long", "n int, until long, last long, at array<long>, event array<long>, ok array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )
    micros = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return found.select("user_id", micros("locked_at"), micros("until"))
