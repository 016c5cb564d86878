"""Tables by partition, sinks of batches, and streams that end, die and go on."""

import datetime
import os
import re
from collections import Counter
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalogue as K
from shelfmark.operators import lifecycle
from shelfmark.plans.streams import arriving, run_batches
from shelfmark.sources import tables as S
from shelfmark.sources.stored import BatchSink, Manifest, Partitioned, user_bucket
from shelfmark.streaming import jobs


def files_of(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "user_id long, file_id long, v string, collection string")


def table(spark, path):
    rows = [(u, f, f"{u}-{f}", "a:b" if f % 2 else "Documents") for u in range(12) for f in range(4)]
    t = Partitioned(spark, f"{path}/t", chunks(spark, rows).schema, {"collection": F.col("collection"), "bucket": user_bucket(8)}, ["bucket"])
    t.add(chunks(spark, rows))
    return t, rows


def content(t):
    return Counter((r.user_id, r.file_id, r.v, r.collection) for r in t.read().collect())


def test_replacing_a_file_leaves_other_folders_alone(spark, tmp_path):
    t, rows = table(spark, tmp_path)
    before = files_of(t.path)
    new = [(3, 1, "x", "Documents"), (3, 1, "y", "Documents"), (3, 99, "z", "Documents")]
    touched = t.replace(chunks(spark, new), ["user_id", "file_id"])
    assert content(t) == Counter([r for r in rows if r[:2] != (3, 1)] + new)
    assert {f["collection"] for f in touched} == {"a:b", "Documents"} and len({f["bucket"] for f in touched}) == 1
    names = [f"bucket={f['bucket']}" for f in touched]
    assert {f for f in before if not any(n in f for n in names)} <= files_of(t.path)
    again = files_of(t.path)
    t.replace(chunks(spark, new), ["user_id", "file_id"])
    assert content(t) == Counter([r for r in rows if r[:2] != (3, 1)] + new) and len(files_of(t.path)) == len(again)


def test_deleting_tenants_empties_their_folders(spark, tmp_path):
    t, rows = table(spark, tmp_path)
    bucket = {r.user_id: r.b for r in spark.range(12).select(F.col("id").alias("user_id")).select("user_id", user_bucket(8).alias("b")).collect()}
    alone = [u for u in range(12) if list(bucket.values()).count(bucket[u]) == 1][:1] or [0]
    gone = {u for u in range(12) if bucket[u] == bucket[alone[0]]}
    before = files_of(t.path)
    t.delete(spark.createDataFrame([(u,) for u in gone], "user_id long"), ["user_id"])
    assert content(t) == Counter(r for r in rows if r[0] not in gone)
    assert files_of(t.path) == {f for f in before if f"bucket={bucket[alone[0]]}/" not in f}
    assert t.delete(spark.createDataFrame([(77,)], "user_id long"), ["user_id"]) == []


def test_scans_are_pruned(spark, tmp_path):
    t, _ = table(spark, tmp_path)
    plan = t._near(spark.createDataFrame([(3,)], "user_id long"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    plan = t.read().where("collection = 'Documents'")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*collection", plan)


def test_retention_drops_folders_and_rewrites_one(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1) + timedelta(hours=7 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    t = Partitioned(spark, f"{tmp_path}/t", df.schema, {"day": F.to_date("ts")})
    t.add(df)
    before = files_of(t.path)
    t.retain("day", datetime.date(2024, 1, 5), F.col("ts") >= F.lit(datetime.datetime(2024, 1, 5, 9)).cast("timestamp_ntz"))
    assert sorted(r.id for r in t.read().collect()) == [i for i, ts in rows if ts >= datetime.datetime(2024, 1, 5, 9)]
    later = {f for f in before if f > "day=2024-01-06"}
    assert later <= files_of(t.path) and not any(f < "day=2024-01-05" for f in files_of(t.path))


def test_an_empty_partitioned_table(spark, tmp_path):
    t = Partitioned(spark, f"{tmp_path}/t", chunks(spark, []).schema, {"bucket": user_bucket(2)})
    assert t.read().count() == 0 and t.delete(chunks(spark, [(1, 1, "", "")]), ["user_id"]) == []


# Sinks of batches


def test_batches_that_run_twice_change_nothing(spark, tmp_path):
    sink = BatchSink(spark, str(tmp_path), "k long, v string", ["k"], {"part": F.col("k") % 2}, most=3)
    want = {}
    for b in range(11):
        rows = [(b % 4, f"v{b}"), (100 + b, "once")]
        want |= dict(rows)
        sink.write(spark.createDataFrame(rows, "k long, v string"), b)
        sink.write(spark.createDataFrame([(0, "wrong")], "k long, v string"), b)
        assert {r.k: r.v for r in sink.read().collect()} == want
    assert len(sink.manifest.parts()) <= 4 and len(list((tmp_path / "parts").glob("batch=*"))) <= 3


def test_files_stay_few_after_a_hundred_batches(spark, tmp_path):
    sink = jobs.usage_sink(spark, str(tmp_path), most=25)
    day = datetime.date(2024, 1, 5)
    one = spark.createDataFrame([(1, day, 1, 1, 0)], jobs.USAGE).coalesce(1)
    for b in range(100):
        sink.write(one.withColumn("messages", F.lit(b).cast("long")), b)
    assert [(r.user_id, r.day, r.messages) for r in sink.read().collect()] == [(1, day, 99)]
    assert len(files_of(tmp_path)) <= 30


def test_a_merge_that_died_is_done_again(spark, tmp_path, monkeypatch):
    sink = BatchSink(spark, str(tmp_path), "k long, v string", ["k"], {"part": F.col("k") % 2}, most=100)
    for b in range(4):
        sink.write(spark.createDataFrame([(b % 2, f"v{b}"), (b + 10, "x")], "k long, v string"), b)
    before = Counter(map(tuple, sink.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda self, parts: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            sink.merge()
    assert Counter(map(tuple, sink.read().collect())) == before
    sink.merge()
    assert Counter(map(tuple, sink.read().collect())) == before and not list((tmp_path / "parts").glob("batch=*"))


# Streams


def ingest(spark, path, chunk):
    d = spark.createDataFrame([(str(u), str(f), f"line {f}\n\nmore") for u in range(2) for f in range(9)], "user_id string, file_id string, text string")
    return jobs.IngestSinks(spark, f"{path}/out", lambda files: d, chunk, most=2)


def lines(texts):
    return texts.select("user_id", "file_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text")).where("chunk_text != ''")


def test_ingest_that_dies_goes_on(spark, tmp_path):
    message = '{{"_id":"{0}","userId":"{1}","fileName":"f {0}.txt","fileType":"text/plain","gcsUrl":"u","isPrivate":{2}}}'
    rows = [(f, message.format(f, f % 2, "true" if f == 4 else "false"), 5 if f == 7 else 0, f // 3) for f in range(9)] + [(90, "{bad", 0, 1), (91, message.format(0, 0, "false"), 0, 2)]
    values = spark.createDataFrame(rows, "message_id long, value string, delivery_attempt int, b int")
    stream = arriving(spark, values, [F.col("b") == i for i in range(3)])
    calls = []

    def dies(texts):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return lines(texts)

    state = str(tmp_path / "state")
    with pytest.raises(Exception, match="lost"):
        jobs.run_ingest(stream, ingest(spark, tmp_path, dies), state).awaitTermination()
    half = ingest(spark, tmp_path, lines)
    assert {r.file_id for r in half.rows.read().collect()} == {"0", "1", "2"}
    jobs.run_ingest(stream, half, state).awaitTermination()
    done = ingest(spark, tmp_path, lines)
    kept = [f for f in range(9) if f != 7]
    assert sorted((r.user_id, r.file_id, r.is_private) for r in done.rows.read().collect()) == [(str(f % 2), str(f), f == 4) for f in sorted(kept, key=lambda f: (str(f % 2), str(f)))]
    assert Counter(r.file_id for r in done.chunks.read().collect()) == {str(f): 2 for f in kept if f != 4}
    assert sorted(r.message_id for r in done.work.read().collect()) == kept
    assert sorted((r.message_id, r.route) for r in done.dead.read().collect()) == [(7, "dead_letter"), (90, "discard")]


def test_lockouts_in_any_order_within_the_delay(spark, tmp_path):
    """The stream gives what the batch gives, and forgets users who are idle."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, at + timedelta(minutes=(i * 37) % 600 + 600 * (i // 100)), (i * 7) % 11 == 0) for i in range(400)]
    rows += [(1000, 1, at + timedelta(days=200), False), (1001, 1, at + timedelta(days=201), False), (1002, 1, at + timedelta(days=400), False)]
    end = [(9999, 77, at + timedelta(days=3000), True)]
    schema = "event_id long, user_id long, ts timestamp, ok boolean"
    e = spark.createDataFrame(rows + end, schema)
    part = F.when(F.col("event_id") >= 1000, F.col("event_id") - 990).otherwise(F.floor(F.col("event_id") / 100))
    stream = arriving(spark, e, [part == i for i in (0, 1, 2, 3, 10, 11, 12)] + [part > 100])
    sink = BatchSink(spark, str(tmp_path), "user_id long, locked_at timestamp_ntz, until timestamp_ntz")
    run_batches(jobs.lockout_stream(stream, "11 hours", failures=3), jobs.into(sink), "append")
    want = Counter(map(tuple, lifecycle.lockouts(e, failures=3).collect()))
    assert Counter((r.user_id, r.locked_at, r.until) for r in sink.read().collect()) == want and want
    # Two failures, then a third after more than ninety days: no lock.
    assert not any(u == 1 and ts > at + timedelta(days=100) for u, ts, _ in want)


def test_status_late_and_twice(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 5, at + timedelta(minutes=(i * 13) % 97), ("pending", "failed", "done")[i % 3], "e" * 1200 if i % 3 == 1 else None) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, file_id long, ts timestamp, status string, error string")
    stream = arriving(spark, e, [F.col("event_id") % 4 == i for i in range(4)] + [F.col("event_id") % 7 == 0])
    sink = BatchSink(spark, str(tmp_path), jobs.STATUS, ["file_id"], most=2)
    run_batches(jobs.status_stream(stream), jobs.into(sink), "update")
    want = Counter(map(tuple, lifecycle.latest_status(e).select("file_id", "status", "error", "n_events").collect()))
    assert Counter((r.file_id, r.status, r.error, r.n_events) for r in sink.read().collect()) == want


def test_status_of_old_files_is_forgotten(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(0, 1, at, "pending", None), (1, 2, at + timedelta(days=100), "pending", None), (2, 2, at + timedelta(days=200), "done", None), (3, 1, at + timedelta(days=200), "done", None)]
    e = spark.createDataFrame(rows, "event_id long, file_id long, ts timestamp, status string, error string")
    sink = BatchSink(spark, str(tmp_path), jobs.STATUS, ["file_id"])
    run_batches(jobs.status_stream(arriving(spark, e, [F.col("event_id") == i for i in range(4)]), "1 day", timedelta(days=30)), jobs.into(sink), "update")
    # The count of file 1 begins anew, as its state had gone.
    assert {r.file_id: r.n_events for r in sink.read().collect()}[1] == 1


def test_sketches_of_parts_are_near_the_exact_ranks(spark, sf):
    e = S.read_events(spark, sf).select(F.lit("s").alias("stage"), (F.col("value") * 100).alias("ms"), F.lit(False).alias("failed"), (F.col("event_id") % 9).alias("part"))
    r = K.merged_summary(K.stage_sketches(e, ["part"])).first()
    values = sorted(x.ms for x in e.collect())
    for got, rank in ((r.p50, 0.5), (r.p95, 0.95)):
        assert values[int(len(values) * (rank - 0.02))] <= got <= values[min(len(values) - 1, int(len(values) * (rank + 0.02)))]
    assert (r.n, r.failures) == (len(values), 0) and os.path.isdir(sf)
