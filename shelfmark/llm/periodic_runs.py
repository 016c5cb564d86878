"""Periodic runs of words: stretches that repeat with some period, and texts without the repeats.

The diagonal of lag q holds the words that equal the word q before.  A run of period q is a
maximal stretch of that diagonal, and one pass from left to right finds it: each word's earlier
occurrences tell which lags are active, an active lag that goes on gains a word, and one that
doesn't go on ends and gives its run if it is long enough.

A frequent word has very many earlier occurrences.  Lags are therefore looked at by scale: for
lags from w/2 to w - 1 the words are taken w at a time.  A run of period q and three periods holds
2q >= w words of its diagonal, and inside it w words, more than a period, recur at multiples of q
only.  So at that scale the nearest earlier occurrence alone is active, every run is found at the
scale of its smallest period, and multiples of that period give nothing.  Places whose w words
don't recur are left out of all larger scales, so the work goes down as w grows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.llm.common import mix64, slices_of, table, utf8
from shelfmark.llm.words import NOT_SPACE, hashed_words

#: Bytes of text that are looked at together.
GROUP = 4 << 20

#: What sets the names of single places apart.
MULTIPLIER = np.uint64(0x9E6C63D0876A9A47)
OWN = np.uint64(0x71D67FFFEDA60000)

#: A run has at least as many words, and as many times its period.
MIN_WORDS, MIN_TIMES = 24, 3


def diagonals(hashes: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted; ``owner`` numbers the texts, and no run leaves its text.

    Exact for ``min_times`` of three or more, which the argument above needs.
    """
    if min_times < 3:
        raise ValueError("runs of fewer than three periods are not found by the nearest occurrence")
    n, w = len(hashes), 2
    # Names of the w words that begin at each place; two halves make the next scale.
    name = hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    left = np.searchsorted(owner, owner, side="right") - np.arange(n) if n else np.zeros(0, np.int64)
    place = np.arange(n)
    found = []
    while len(place):
        place = place[left[place] >= w]
        if len(place) < 2:
            break
        second = name[place + w // 2]
        here = mix64(name[place] * MULTIPLIER + (second ^ (second >> np.uint64(29))) + np.uint64(w))
        order = np.argsort(here, kind="stable")
        same = here[order[1:]] == here[order[:-1]]
        recurs = np.zeros(len(place), bool)
        recurs[order[1:][same]] = True
        lag = np.zeros(len(place), np.int64)
        lag[order[1:][same]] = place[order[1:][same]] - place[order[:-1][same]]
        lag[(lag < w // 2) | (lag >= w)] = 0
        # Consecutive places with one lag are one stretch of its diagonal.
        begins = np.flatnonzero((lag > 0) & ((np.diff(place, prepend=-2) != 1) | (np.diff(lag, prepend=0) != 0)))
        if len(begins):
            stops = np.flatnonzero((lag > 0) & ((np.diff(place, append=-2) != 1) | (np.diff(lag, append=0) != 0)))
            period = lag[begins]
            start = place[begins] - period
            length = place[stops] + w - start
            long = length >= np.maximum(min_words, min_times * period)
            found.append(np.stack([start[long], length[long], period[long]], axis=1))
        recurs[order[:-1][same]] = True
        # Places whose w words don't recur get a name of their own, for good.
        name[place[~recurs]] = mix64(place[~recurs].astype(np.uint64) + OWN)
        place, here = place[recurs], here[recurs]
        name[place] = here
        w *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run beyond its first period."""
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


Rewrite = Callable[[str, int], "np.ndarray | None"]

RUN = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _look(keys: list[str], texts: list[bytes], rewrite: Rewrite | None) -> pa.StructArray:
    """The result of a group of texts."""
    hashes, counts = hashed_words(texts, NOT_SPACE, lower=False)
    ends = np.cumsum(counts)
    firsts = ends - counts
    taken = np.arange(len(hashes))
    moved = np.zeros(len(texts), bool)
    for i, (key, n) in enumerate(zip(keys, counts.tolist(), strict=True)):
        at = rewrite(key, n) if rewrite else None
        if at is not None:
            taken[firsts[i] : ends[i]] = firsts[i] + at
            moved[i] = True
    owner = np.repeat(np.arange(len(texts)), counts)
    runs = diagonals(hashes[taken], owner)
    gone = repeats(len(hashes), runs)
    cuts = np.searchsorted(runs[:, 0], np.append(firsts, len(hashes)))
    collapsed = []
    for i, text in enumerate(texts):
        parts = text.split()
        if moved[i] or cuts[i] < cuts[i + 1]:
            at = taken[firsts[i] : ends[i]][~gone[firsts[i] : ends[i]]] - firsts[i]
            parts = [parts[k] for k in at.tolist()]
        collapsed.append(b" ".join(parts))
    starts = runs[:, 0] - firsts[owner[runs[:, 0]]] if len(runs) else runs[:, 0]
    rows = pa.StructArray.from_arrays([pa.array(starts), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(counts), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str, text: str, rewrite: Rewrite | None = None, name: str = "found") -> DataFrame:
    """``docs`` with the struct ``name``: n_words, runs (sorted by start, then period) and collapsed.

    Words are separated by U+0020 and U+0009 to U+000D.  A run is a maximal stretch of words with
    smallest period ``period`` that has 24 words and three periods at least; its start is the number
    of its first word.  ``collapsed`` joins by one space the words that lie in no run beyond its first
    period.  A null text has no words.  Rows are looked at one by one, so repeated rows give equal
    results; a column of ``docs`` that is called ``name`` is replaced.  ``rewrite`` may name, for the
    key (as text, null as the empty text) and the number of words, the words to be read instead.
    """
    kept = [c for c in docs.columns if c != name]
    sent = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices_of(part, 2, GROUP):
                found = _look(some.column(1).to_pylist(), some.column(2).to_pylist(), rewrite)
                yield pa.RecordBatch.from_arrays([some.column(0), found], names=["row", name])

    schema = sent.select("row").schema.add(name, DataType.fromDDL(f"struct<n_words: long, runs: {RUN}, collapsed: string>"))
    return sent.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in kept], f"`{name}`")


def planted(key: str, n: int) -> np.ndarray | None:
    """The contract's planted run: a tenth of the keys repeat from a word on."""
    h = zlib.crc32(utf8(key))
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", planted)
    runs = F.col("found.runs")
    # The greatest exponent; of equal ones the first by start, then by period, as the runs are sorted.
    ratio = F.transform(runs, lambda r: r["length"].cast("double") / r["period"])
    best = F.try_element_at(runs, F.array_position(ratio, F.array_max(ratio)).cast("int"))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size(runs) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return docs.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
