"""Benchmark decontamination: verbatim matches of benchmark items in training texts, by suffix arrays.

The words of a task's texts, as numbers of the benchmark's vocabulary, are cut into shards of
a fixed number of words.  Each shard's suffixes are sorted, and every benchmark suffix is searched
in them, one word at a time: the suffixes that begin with its first d words are a range of the array,
and the last range that is not empty gives the longest match and where it is.  A range's own
order beyond the first words matters only if a benchmark suffix enters it, so it is sorted then.

Texts stay in their task and only the benchmark is sent to all, in packs of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.llm.common import HashIndex, cut, slices_of, table, utf8
from shelfmark.llm.words import ALNUM, hashed_words

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of a shard, and bytes of text that are looked at together.
SHARD, GROUP = 1 << 21, 12 << 20
#: Bytes of benchmark items that are sent to all workers at a time.
PACK = 16 << 20
#: Pairs of documents and items that are made at a time.
PAIRS = 1 << 22


@dataclass
class Items:
    """Distinct word sequences of a pack of benchmark items, one after the other with a 0 between."""

    vocabulary: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    names: list[list[str]]
    window: int

    def __post_init__(self) -> None:
        self.per_key = max(1, 63 // int(len(self.vocabulary) + 1).bit_length())
        self.bits = np.uint64(63 // self.per_key)
        self.index = HashIndex(self.vocabulary)
        self.longest = int(self.size.max(initial=0))
        # Suffixes that can begin a window, with the words that are left and the words of the window.
        kept = np.where(self.size > self.window, self.size - self.window + 1, np.minimum(self.size, 1))
        self.item = np.repeat(np.arange(len(self.size)), kept)
        within = np.arange(len(self.item)) - np.repeat(np.cumsum(kept) - kept, kept)
        self.at = self.begin[self.item] + within
        self.within = within
        self.left = self.size[self.item] - within
        self.least = np.minimum(self.size, self.window)[self.item]
        self.keys = packed(self.words, self.per_key, self.bits)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        return self.index.find(hashes) + np.int32(1)


def packed(words: np.ndarray, per_key: int, bits: np.uint64) -> np.ndarray:
    """For each place, its first ``per_key`` words as one number that sorts as they do."""
    n = len(words)
    wide = np.concatenate([words.astype(np.uint64), np.zeros(per_key, np.uint64)])
    out = wide[:n].copy()
    for i in range(1, per_key):
        out <<= bits
        out |= wide[i : i + n]
    return out


def pack_items(rows: list[tuple[str, str | None]], window: int) -> Items:
    hashes, counts = hashed_words([utf8(t) for _, t in rows], ALNUM, lower=True)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes).astype(np.int32) + np.int32(1)
    ends = np.cumsum(counts)
    names: dict[bytes, set[str]] = defaultdict(set)
    for (name, _), begin, end in zip(rows, ends - counts, ends, strict=True):
        if end > begin:
            names[numbers[begin:end].tobytes()].add(name)
    parts, begins, sizes, at = [], [], [], 0
    for sequence in names:
        part = np.frombuffer(sequence, np.int32)
        parts += [part, np.zeros(1, np.int32)]
        begins.append(at)
        sizes.append(len(part))
        at += len(part) + 1
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Items(vocabulary, words, np.array(begins, np.int64), np.array(sizes, np.int64), [sorted(x) for x in names.values()], window)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + lo[owner], owner


class SuffixArray:
    """The suffixes of one shard, sorted by their first words, and deeper where it is asked."""

    def __init__(self, words: np.ndarray, owned: int, items: Items) -> None:
        """``words`` go on beyond the ``owned`` ones, at which suffixes begin, by as many as the longest item has."""
        self.keys = np.append(packed(words, items.per_key, items.bits), np.uint64(0))
        place = np.flatnonzero(words[:owned])
        first = self.keys[place]
        order = np.argsort(first)
        self.suffix, self.first = place[order], first[order]
        self.per_key = items.per_key

    def _key(self, at: np.ndarray, depth: int) -> np.ndarray:
        return self.keys[np.minimum(self.suffix[at] + depth, len(self.keys) - 1)]

    def refine(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> None:
        """Sort each of the ranges, whose suffixes share ``depth`` words, by the words that follow."""
        ranges = np.unique(np.stack([lo, hi], axis=1)[hi - lo > 1], axis=0)
        if len(ranges):
            at, owner = spread(ranges[:, 0], ranges[:, 1])
            self.suffix[at] = self.suffix[at[np.lexsort((self._key(at, depth), owner))]]

    def bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, key: np.ndarray, right: bool) -> np.ndarray:
        """The first place of each range whose words from ``depth`` on are ``key`` or more (``right``: more)."""
        if depth == 0:
            return np.clip(np.searchsorted(self.first, key, "right" if right else "left"), lo, hi)
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            value = self._key(mid, depth)
            up = value <= key[open_] if right else value < key[open_]
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


def search(array: SuffixArray, items: Items, windows: list, best: np.ndarray, best_at: np.ndarray) -> None:
    """Search all benchmark suffixes at once.

    Adds (words, places, suffix number of each) of the windows that occur to ``windows``, and writes
    to ``best`` and ``best_at`` the longest match at each place and the suffix that has it.
    """
    live = np.arange(len(items.at))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(array.suffix), np.int64)
    depth = 0
    while len(live):
        past, into = depth // items.per_key * items.per_key, depth % items.per_key
        if past and not into:
            array.refine(lo, hi, past)
        open_bits = items.bits * np.uint64(items.per_key - into - 1)
        low = items.keys[np.minimum(items.at[live] + past, len(items.keys) - 1)] >> open_bits << open_bits
        high = low | ((np.uint64(1) << open_bits) - np.uint64(1))
        more = items.left[live] > depth
        lo2 = np.where(more, array.bound(lo, hi, past, low, False), lo)
        hi2 = np.where(more, array.bound(lo, hi, past, high, True), lo)
        # What doesn't go on with a window or more behind it is a longest match.
        done = (items.least[live] <= depth) & ((lo2 > lo) | (hi2 < hi))
        if depth and done.any():
            ranges, which = np.unique(np.stack([lo, hi], axis=1)[done], axis=0, return_index=True)
            at, owner = spread(ranges[:, 0], ranges[:, 1])
            place = array.suffix[at]
            best[place], best_at[place] = depth, live[done][which][owner]
        some = hi2 > lo2
        live, lo, hi = live[some], lo2[some], hi2[some]
        depth += 1
        full = items.least[live] == depth
        if full.any():
            ranges, which = np.unique(np.stack([lo, hi], axis=1)[full], axis=0, return_inverse=True)
            at, owner = spread(ranges[:, 0], ranges[:, 1])
            windows.append((depth, array.suffix[at], owner, which.ravel(), live[full]))


def documents_and_items(doc: np.ndarray, window: np.ndarray, window_of: np.ndarray, suffix: np.ndarray, items: Items) -> np.ndarray:
    """Distinct pairs (document, item) from distinct pairs (document, window) and the suffixes of each window."""
    pairs = np.unique(doc * np.int64(window_of.max() + 1) + window)
    doc, window = np.divmod(pairs, np.int64(window_of.max() + 1))
    order = np.argsort(window_of, kind="stable")
    item = items.item[suffix[order]]
    lo = np.searchsorted(window_of[order], window, "left")
    hi = np.searchsorted(window_of[order], window, "right")
    n_items = np.int64(len(items.size))
    out, total = np.zeros(0, np.int64), np.cumsum(hi - lo)
    begin = 0
    while begin < len(doc):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        at, owner = spread(lo[begin:end], hi[begin:end])
        out = np.union1d(out, doc[begin:end][owner] * n_items + item[at])
        begin = end
    return out


MATCH = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("words", pa.int64()), ("begin", pa.int64()), ("item_id", pa.string()), ("item_begin", pa.int64())]))])
MATCH_SQL = "struct<n_words: long, spans: array<array<bigint>>, items: array<string>, longest: struct<words: long, begin: long, item_id: string, item_begin: long>>"


def match_group(texts: list[bytes], items: Items, shard: int = SHARD) -> list[dict]:
    """The matches of a group of texts."""
    hashes, counts = hashed_words(texts, ALNUM, lower=True)
    # One 0 after each text keeps matches inside it.
    begin = np.cumsum(counts + 1) - counts - 1
    n = int(counts.sum()) + len(texts)
    words = np.zeros(n, np.int32)
    inside = np.ones(n, bool)
    inside[begin + counts] = False
    words[inside] = items.numbers(hashes)
    del hashes, inside
    reach, best, best_at = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    pairs = np.zeros(0, np.int64)
    for at in range(0, n, shard):
        part = words[at : at + shard + items.longest]
        owned = min(shard, n - at)
        windows: list = []
        search(SuffixArray(part, owned, items), items, windows, best[at : at + owned], best_at[at : at + owned])
        for size, place, owner, window_of, suffix in windows:
            # A later shard or size may only lengthen what a place reaches.
            reach[at + place] = np.maximum(reach[at + place], size)
            doc = np.searchsorted(begin, at + place, "right") - 1
            pairs = np.union1d(pairs, documents_and_items(doc, owner, window_of, suffix, items))
    place = np.flatnonzero(reach)
    end = np.maximum.accumulate(place + reach[place]) if len(place) else place
    doc = np.searchsorted(begin, place, "right") - 1
    new = np.flatnonzero(np.append(True, (place[1:] > end[:-1]) | (doc[1:] != doc[:-1]))) if len(place) else place
    out = [{"n_words": int(c), "spans": [], "items": [], "longest": None} for c in counts]
    last = np.append(new[1:], len(place)) - 1 if len(place) else new
    for a, b in zip(new.tolist(), last.tolist(), strict=True):
        d = int(doc[a])
        out[d]["spans"].append([int(place[a] - begin[d]), int(end[b] - begin[d])])
    n_items = np.int64(max(len(items.size), 1))
    for d, i in zip((pairs // n_items).tolist(), (pairs % n_items).tolist(), strict=True):
        out[d]["items"] += items.names[i]
    at = np.flatnonzero(best)
    doc = np.searchsorted(begin, at, "right") - 1
    order = np.lexsort((at, -best[at], doc))
    for k in order[np.flatnonzero(np.diff(doc[order], prepend=-1))].tolist() if len(at) else []:
        p, d, s = int(at[k]), int(doc[k]), int(best_at[at[k]])
        out[d]["longest"] = {"words": int(best[p]), "begin": p - int(begin[d]), "item_id": items.names[items.item[s]][0], "item_begin": int(items.within[s])}
    return out


def merge(old: dict | None, new: dict) -> dict:
    """The matches of one text with two packs of items."""
    if not old:
        return new
    spans: list = []
    for b, e in sorted(old["spans"] + new["spans"]):
        if spans and b <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([b, e])
    both = [x for x in (old["longest"], new["longest"]) if x]
    return {"n_words": new["n_words"], "spans": spans, "items": sorted({*old["items"], *new["items"]}), "longest": max(both, key=lambda x: (x["words"], -x["begin"]), default=None)}


def find_matches(docs: DataFrame, text: str, tests: DataFrame, test_id: str, test_text: str, window: int = WINDOW, name: str = "match", pack: int = PACK) -> DataFrame:
    """``docs`` with the struct ``name``: n_words, spans, items, longest.

    ``spans`` are the word ranges (end excluded) that windows of items cover, merged where they meet;
    ``items`` the ids (as text, a null id as the empty text) of items with an occurring window, sorted;
    ``longest`` the longest verbatim match of a window or more: its words, its place here, its first
    item and its place there; null if there is none.  Words are runs of ASCII letters and digits and
    of all characters beyond ASCII; A-Z counts as lower case.  Null texts have no words and items without
    words no window.  Rows are looked at one by one; a column called ``name`` is replaced.
    Memory holds ``pack`` bytes of items, or one longer item; more packs are more passes over ``docs``.
    """
    t = tests.select(F.coalesce(F.col(f"`{test_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{test_text}`"), F.lit("")).alias("text")).distinct()
    size = t.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_packs = max(1, -(-size // pack))
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")).schema.add("found", DataType.fromDDL(MATCH_SQL))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.lit(None).cast(MATCH_SQL).alias("found"))
    for number in range(n_packs):
        rows = t.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_packs)) == number).collect()
        shared = docs.sparkSession.sparkContext.broadcast(pack_items([(r.id, r.text) for r in rows], window))

        def run(parts: Iterator[pa.RecordBatch], shared=shared, first=number == 0) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for some in slices_of(part, 2, GROUP):
                    found = match_group([x or b"" for x in some.column(2).to_pylist()], shared.value)
                    if not first:
                        found = [merge(a, b) for a, b in zip(some.column(1).to_pylist(), found, strict=True)]
                    for x in found:
                        x["items"] = sorted(set(x["items"]))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, MATCH)], names=["row", "found"])

        if number:
            out = cut(out)
        out = out.select("row", "found", F.col(f"row.`{text}`").cast("binary").alias("_text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in kept], F.col("found").alias(name))


def n_hit(match: str) -> F.Column:
    """Words that lie in the spans."""
    return F.aggregate(F.col(f"{match}.spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminate(docs: DataFrame, text: str, tests: DataFrame, test_id: str, test_text: str, window: int = WINDOW) -> DataFrame:
    """``docs`` without those in which a window of an item occurs."""
    name = "_match"
    while name in docs.columns:
        name += "_"
    return find_matches(docs, text, tests, test_id, test_text, window, name).where(F.size(f"{name}.items") == 0).drop(name)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id",
        F.col("match.n_words").alias("n_words"),
        n_hit("match").alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit("match") > 0).alias("contaminated"),
    )


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(cast(item_id AS varchar), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS i FROM b WHERE len(w) > 0)),
here AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
occ AS (SELECT here.r, here.k, here.i, win.item FROM here JOIN win ON here.k = win.k AND here.g = win.g),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, k, i FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
