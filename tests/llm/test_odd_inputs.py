"""Inputs that once ended a job, lost rows or took columns away."""

import struct
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import html_extract, langid, mixing, near_dedup, tiff


def test_whole_passes_stay_whole(spark):
    """Equal weights give a repeat of 1, and a document without words is in every whole pass."""
    rows = [(10 * s + i, f"s{s}", "w " * n) for s in range(5) for i, n in enumerate((90 + 4 * s, 0))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.schedule(docs, mixing.MixConfig(entropy=0.0))
    assert Counter(r.doc_id for r in out.collect()) == {r[0]: 1 for r in rows}


def test_lift_makes_the_bisection_run(spark):
    rows = [(i, f"s{i % 3}", "w " * (10 if i % 3 else 30)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counted = docs.select("source", mixing.token_count(F.col("text")).alias("tokens"))
    natural = mixing.source_weights(counted, mixing.MixConfig(entropy=0.0)).first().exponent
    lifted = mixing.source_weights(counted, mixing.MixConfig(entropy=0.0, lift=0.5)).first().exponent
    assert natural == 1.0 and 0 < lifted < 1


def with_tag(data, tag, value):
    """``data`` with another value of a tag of its first directory."""
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    out = bytearray(data)
    for i in range(n):
        if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag:
            kind = struct.unpack_from("<H", data, at + 4 + 12 * i)[0]
            struct.pack_into("<I" if kind == 4 else "<H", out, at + 10 + 12 * i, value)
    return bytes(out)


@pytest.mark.parametrize("tag, value", [(256, 0), (257, 0), (322, 0), (323, 0), (277, 0), (256, 60000), (257, 65000)])
def test_bad_sizes_are_rows_with_an_error(spark, tag, value):
    made = [tiff.write_payload(bytes([k]) * 640) for k in range(12)]
    bad = [b for b in (with_tag(d, tag, value) for d in made) if b not in made]
    files = spark.createDataFrame([(i, b, "old") for i, b in enumerate(bad + made)], "id long, media binary, error string")
    rows = tiff.read_pages(files).collect()
    assert len(rows) == len(bad) + len(made)
    assert all(r.error for r in rows if r.id < len(bad)) and all(r.error is None and len(r.pixels) == 640 for r in rows if r.id >= len(bad))


@pytest.mark.parametrize("part", ["<a ", "<div>", "<canvas>", "<p><button><div>", "<!-- ", '<a ">'])
def test_pages_are_parsed_in_a_time_like_their_length(part):
    def took(n):
        began = time.process_time()
        html_extract.parse(part * n)
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 12 * max(took(10_000), 0.01)


def test_columns_with_names_of_ours_stay(spark):
    docs = spark.createDataFrame([(1, "the house is red and old", "en", 7, 8), (1, "the house is red and old", "en", 7, 8), (2, "12", "en", 7, 8)], "doc_id long, text string, lang string, _row long, _found long")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {(r._row, r._found) for r in kept.collect()} == {(7, 8)}
    alone = near_dedup.drop_near_duplicates(docs)
    assert alone.columns == docs.columns and sorted((r.doc_id, r._row) for r in alone.collect()) == [(1, 7), (2, 7)]
