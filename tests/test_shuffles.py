"""What wide or whole tables are not shuffled, or held by one task, for."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import chunking as C
from shelfmark.plans import retrieval, streams
from shelfmark.plans.registry import QUERIES


@pytest.fixture
def shuffled_joins(spark):
    """Joins as tables of any size have them."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def after_python(df):
    """The steps of the plan that come after the chunks are made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    return lines[: next(i for i, x in enumerate(lines) if "Arrow" in x)]


def test_chunk_contexts_shuffle_texts_of_passing_files_only(spark, sf, shuffled_joins):
    stored = retrieval.stored_chunks(spark, sf)
    assert "embedding" not in stored.columns and not [x for x in after_python(stored) if "Exchange" in x]
    plan = QUERIES["r6_chunk_contexts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_chunk_contexts_of_many_files(spark, sf, monkeypatch):
    """Files that are too many to be sent give the same."""
    few = Counter(map(tuple, QUERIES["r6_chunk_contexts"](spark, sf).collect()))
    monkeypatch.setattr(retrieval, "FEW_FILES", 0)
    assert Counter(map(tuple, QUERIES["r6_chunk_contexts"](spark, sf).collect())) == few and few


def test_chunks_of_the_table_are_not_shuffled(spark, sf, shuffled_joins):
    assert not [x for x in after_python(QUERIES["c9_chunk_table"](spark, sf)) if "Exchange" in x]


def sorts(df):
    """The columns of every sort of the plan, each as a set."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) Sort\nInput \[\d+\]: \[(.*)\]", plan)]


@pytest.mark.parametrize("name", ["c9_chunk_table", "c6_hierarchical_chunks", "c7_flat_chunks"])
def test_texts_are_not_sorted_with_lines_or_blocks(spark, sf, shuffled_joins, name):
    found = [x for x in sorts(QUERIES[name](spark, sf)) if x & {"pos", "island", "block_no"}]
    assert len(found) > 1 and not [x for x in found if x & {"line", "ls", "text"}]


def test_blocks_are_cut_from_odd_texts(spark):
    """Blocks without any letter go, a fence may stay open, and a document may lack its id."""
    odd = [(1, None), (2, ""), (3, "\t\n# h #\n \n\t- a\n2. b\nc\n"), (4, "```\n# no\n\n| no |"), (5, "| a |\n```\n```\n```\n```\n\n\n x\t"), (None, "## u\nv")]
    got = {}
    for r in C.parse_blocks(spark.createDataFrame(odd, "doc_id long, text string")).orderBy("block_no").collect():
        got.setdefault(r.doc_id, []).append((r.block_no, r.kind, r.level, r.text))
    assert got == {
        3: [(0, "heading", 1, "# h #"), (1, "list", None, "- a\n2. b\nc")],
        4: [(0, "code", None, "```\n# no\n\n| no |")],
        5: [(0, "table", None, "| a |"), (1, "code", None, "```\n```"), (2, "code", None, "```\n```"), (3, "paragraph", None, "x")],
        None: [(0, "heading", 2, "## u"), (1, "paragraph", None, "v")],
    }


def test_chunk_table_with_repeated_and_missing_vectors(spark):
    """A row for each vector of a chunk; none for vectors without chunk, files without vectors or private files."""
    files = spark.createDataFrame([(i, 1, "Documents", f"f{i}", i == 3) for i in range(5)], "file_id long, user_id long, collection string, filename string, is_private boolean")
    texts = spark.createDataFrame([(i, "# a\n\n" + "Some words are here. " * 200) for i in range(4)] + [(4, None)], "file_id long, text string")
    held = [(0, 0, "a"), (0, 0, "b"), (0, 2, "c"), (0, 99, "d"), (0, None, "e"), (1, -1, "f"), (3, 0, "g"), (4, 0, "h"), (None, 0, "i"), (1, 1, None)]
    vectors = spark.createDataFrame(held, "file_id long, chunk_index int, vector string")
    got = C.build_chunks(files, texts, vectors).collect()
    want = {(r.doc_id, r.chunk_index): r for r in C.chunk_documents(texts.withColumnRenamed("file_id", "doc_id"), 1500, 400, 60).collect()}
    assert Counter((r.file_id, r.chunk_index, r.vector) for r in got) == Counter([(0, 0, "a"), (0, 0, "b"), (0, 2, "c"), (1, 1, None)])
    for r in got:
        assert all(r[c] == want[r.file_id, r.chunk_index][c] for c in ("parent_index", "chunk_text", "parent_text", "has_table", "heading_path", "tokens"))


def test_batches_of_a_stream_come_whole_and_in_order(spark, monkeypatch, tmp_path):
    """A batch is a part, of many rows, none or one, in files of a bounded number of rows that no single task writes."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    df = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("x"))
    parts = [F.col("id") < 1500, F.lit(False), F.col("id") == 7, (F.col("id") >= 1500) | (F.col("id") == 8)]
    stream = streams.arriving(spark, df, parts)
    assert stream.columns == df.columns
    got = {}
    streams.run_batches(stream, lambda batch, number: got.update({number: Counter(map(tuple, batch.collect()))}), "append")
    assert [got[i] for i in range(4)] == [Counter(map(tuple, df.where(p).collect())) for p in parts] and len(got) == 4
    assert [len(list(tmp_path.glob(f"arriving/{i:04d}/*.parquet"))) for i in range(4)] == [15] * 4


@pytest.mark.parametrize("name", ["q6_signal_hybrid", "q7_consolidation"])
def test_chunk_vectors_are_not_shuffled(spark, sf, shuffled_joins, name):
    df = QUERIES[name](spark, sf)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    moved = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert moved and not [x for x in moved if x & {"embedding", "rows"}]
