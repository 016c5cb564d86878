"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles, ``HASHES`` minima (kept as a byte
   each, and as ``BANDS`` band values) and a 128-bit key of the set; texts of equal
   sets form one class, and only class representatives (least doc_id) go on.
2. A bucket is a band value that two classes share.  Each bucket picks a pivot, the
   first by one of a few orders, and members are paired with pivots only, so a
   bucket of g members gives g - 1 pairs.
3. Pairs are compared batch by batch of the signature; a pair is pruned as soon
   as the posterior probability of reaching the threshold (uniform prior,
   binomial matches) falls below ``MISS``.  Bytes match a little more often than
   the minima do, so they prune less, never more.  Survivors are verified on full sets.
4. What pivots have not joined is finished.  Buckets that still hold several
   components are gathered under the member that most of them share (a group of near
   copies shares most buckets, so its rows meet once, not once a band).  The members
   outside the largest component are compared, in blocks of bounded bytes, with all
   members of other components: by signature, then on full sets inside the task.
   A task joins components as it finds links and looks no further at joined ones,
   so it emits fewer links than it has components.

So no link between candidates is lost, and no group is expanded into all pairs.
A pair at exactly the threshold shares no band with probability
(1 - 0.8^5)^32 = 3e-6.  Members of one bucket that are never similar enough are
compared with one another inside tasks: that work is quadratic in the bucket, its
shuffle grows with (bytes of the group / BLOCK_BYTES) copies of a row.

Defined results: a null text, or one without words, has n_shingles 0 and is
alone.  A text with fewer words than a shingle has the whole sequence as its one
shingle.  doc_id is a key; a row that is repeated whole gives a row each time.  A
null doc_id keeps component_id null and is kept.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import batches_of, cut, free_name, mix64, scratch, slices_of, small, table, word_hashes
from shelfmark.llm.components import components, merged

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Each of these, by exclusive or, gives another order of the documents.
ORDERS = [0x2B7E151628AED2A6, 0x3243F6A8885A308D, 0x13198A2E03707344, 0x243F6A8885A308D3]
#: Signatures and sets of one side of a block; a larger text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Text that a worker holds as sets at once.
TEXT_BYTES = 1 << 19
#: Groups up to this many are broadcast (tens of MB); of more, only those above ``HOT`` rows are.
MAX_BROADCAST = 200_000
HOT = 10_000

_rng = np.random.default_rng(20240209)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for begin, end in batches_of(texts, 1 << 20):
        hashes, counts = word_hashes(texts[begin:end])
        at = np.cumsum(counts) - counts
        chain = hashes.copy()
        for k in range(1, words):
            chain[:-k] = mix64(chain[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        for a, n in zip(at.tolist(), counts.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(chain[a : a + n - words + 1]))
            elif n:
                one = hashes[a : a + 1]
                for k in range(1, n):
                    one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + hashes[a + k])
                out.append(mix64(one + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) uint32 minima; every set must hold something."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), HASHES), np.uint32)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sets):
        base = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, base + (1 << 18), "right")))
        values = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        starts = (ends[begin:end] - sizes[begin:end] - base).astype(np.int64)
        for k in range(HASHES):
            out[begin:end, k] = np.minimum.reduceat(values * _MUL[k] + _ADD[k], starts)
        begin = end
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches compared: the fewest matches at which P(similarity >= threshold) is ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail
    at t equals the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sets_of(parts: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of (doc_id, text), some hundred KB of text at a time."""
    for part in parts:
        for some in slices_of(part, 1, TEXT_BYTES):
            yield some.column(0), shingle_sets([b"" if t is None else t for t in some.column(1).to_pylist()], words)


def band_values(sigs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64: a hash of each band's minima and its number."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), 1))
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sigs[:, r::ROWS].astype(np.uint64))
    return out.view(np.int64)


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets_of(parts, words):
            some = np.flatnonzero([len(s) > 0 for s in sets])
            sigs = signatures([sets[i] for i in some]) if len(some) else np.zeros((0, HASHES), np.uint32)
            place = np.full(len(sets), -1)
            place[some] = np.arange(len(some))
            low = (sigs >> np.uint32(24)).astype(np.uint8)
            k1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            k2 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(place >= 0) * BANDS]).astype(np.int32), band_values(sigs).ravel())
            sig = pa.array([low[i].tobytes() if i >= 0 else None for i in place], pa.binary())
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), bands, sig]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "k1", "k2", "bands", "sig"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles) of the documents named by ``ids`` (column node)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets_of(parts, words):
            made = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), made], names=["node", "n", "shingles"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.join(small(ids, MAX_BROADCAST), rows["doc_id"] == ids["node"], "left_semi")
    return rows.mapInArrow(run, "node long, n long, shingles binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, and more) whose full sets are similar enough."""
    names = pairs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fits = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = shared(x, y) if den * min(len(x), len(y)) >= num * max(len(x), len(y)) else 0
                fits.append(den * both >= num * (len(x) + len(y) - both))
            yield part.select(names).filter(pa.array(fits, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select(*names, "sa", "sb")
    return both.mapInArrow(run, pairs.schema)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted sets share."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _sequential(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Compare signatures batch by batch; keep (a, b, matches) of the pairs that no batch prunes."""
    need = least_matches(threshold)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part) == 0:
                continue
            x = np.frombuffer(b"".join(part["sa"]), np.uint8).reshape(-1, HASHES)
            y = np.frombuffer(b"".join(part["sb"]), np.uint8).reshape(-1, HASHES)
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, least in enumerate(need):
                cols = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, cols] == y[alive, cols]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pd.DataFrame({"a": part["a"].array[alive], "b": part["b"].array[alive], "matches": matches[alive]})

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long, matches long")


def _with_component(df: DataFrame, col: str, comp: DataFrame, name: str) -> DataFrame:
    """Add the component of ``col``; a node outside ``comp`` is its own."""
    other = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return df.join(other, df[col] == F.col("_n"), "left").withColumn(name, F.coalesce("_c", col)).drop("_n", "_c")


def _grouped(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``groups`` (one row each, and its number ``rows`` of rows).

    A few groups are broadcast.  Of many, only the hot ones are, so that no task
    gets all rows of one; the others are shuffled.
    """
    if groups.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(groups.drop("rows")), on)
    hot = small(groups.where(F.col("rows") > HOT).drop("rows"), MAX_BROADCAST)
    rest = groups.where(F.col("rows") <= HOT).drop("rows")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))


def compare_block(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links between components: of ``left`` and ``right`` rows (c, sig, shingles) of different ones, on full sets."""
    need = least_matches(num / den)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    found = []
    y = np.frombuffer(b"".join(right["sig"]), np.uint8).reshape(-1, HASHES)
    y_sets = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    y_n = np.array([len(x) for x in y_sets])
    names, y_c = np.unique(right["c"].to_numpy(), return_inverse=True)
    roots = names.copy()
    for c, sig, own in zip(left["c"], left["sig"], left["shingles"], strict=True):
        mine, x = np.frombuffer(own, np.uint64), np.frombuffer(sig, np.uint8)
        alive = np.flatnonzero((roots[y_c] != root(c)) & (den * np.minimum(y_n, len(mine)) >= num * np.maximum(y_n, len(mine))))
        matches = np.zeros(len(alive), np.int64)
        for k, least in enumerate(need):
            if not len(alive):
                break
            cols = slice(k * BATCH, (k + 1) * BATCH)
            matches += (y[alive, cols] == x[cols]).sum(axis=1)
            alive, matches = alive[matches >= least], matches[matches >= least]
        # The likeliest first: once a component is joined, its other members need no look.
        for i in alive[np.argsort(-matches, kind="stable")].tolist():
            if roots[y_c[i]] == root(c):
                continue
            both = shared(mine, y_sets[i])
            if den * both >= num * (len(mine) + y_n[i] - both):
                found.append((int(c), int(names[y_c[i]])))
                old, new = root(c), int(roots[y_c[i]])
                parent[old] = new
                roots[roots == old] = new
    return found


def _remaining(docs: DataFrame, inside: DataFrame, comp: DataFrame, sigs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between the components that buckets still hold several of."""
    rows = cut(_with_component(inside.select("key", "node"), "node", comp, "c"))
    split = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("rows")).where("a != b")
    rows = cut(_grouped(rows, cut(split.select("key", "rows")), ["key"]))
    degree = rows.groupBy("node").agg(F.count("*").alias("d"))
    hubs = rows.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("d", "node")).alias("hub"), F.count("*").alias("rows"))
    met = cut(_grouped(rows, cut(hubs), ["key"]).select("hub", "node", "c").distinct())
    sets = cut(_sets(docs, cut(met.select("node").distinct()), words).join(sigs, "node"))
    met = met.join(sets.select("node", (F.col("n") * 8 + HASHES).alias("size")), "node")
    per = met.groupBy("hub", "c").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    per = per.groupBy("hub").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"), F.sum("rows").alias("rows"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES).cast("int"))
    per = cut(per.select("hub", "main", "rows", blocks(F.col("all")).alias("wide"), blocks(F.col("all") - F.col("most")).alias("deep")))
    mixed = _grouped(met.drop("size"), per, ["hub"]).join(sets.drop("n"), "node")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    kept = ["c", "sig", "shingles"]
    others = mixed.where("c != main").select("hub", deal("deep").alias("i"), F.explode(spread("wide")).alias("j"), F.lit(True).alias("left"), *kept)
    everyone = mixed.select("hub", F.explode(spread("deep")).alias("i"), deal("wide").alias("j"), F.lit(False).alias("left"), *kept)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["left"]], part[~part["left"]]
        found = compare_block(left, right, num, den) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return others.unionByName(everyone).groupBy("hub", "i", "j").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text) -> one row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when den * |intersection| >= num * |union| of their
    ``words``-word shingle sets; component_id is the least doc_id that links reach.
    """
    threshold = num / den
    features = cut(_features(docs, words))
    full = features.where("n > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    several = cut(classes.where("rep < last").drop("last"))
    copies = cut(_grouped(full.select("doc_id", "n", "k1", "k2"), several, ["k1", "k2", "n"]).where("doc_id != rep").select("doc_id", "rep").distinct())
    sigs = full.join(small(copies.select("doc_id"), MAX_BROADCAST), "doc_id", "left_anti")
    sigs = sigs.select(F.col("doc_id").alias("node"), "bands", "sig")
    if not full.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Rows that are repeated whole; the rare case is worth a shuffle, the usual one isn't.
        docs, sigs = docs.dropDuplicates(["doc_id"]), sigs.dropDuplicates(["node"])
    sigs = cut(sigs)

    keys = sigs.select("node", F.explode("bands").alias("key"))
    sigs = sigs.drop("bands")
    # A few orders of all documents, shared by the buckets: members of a group meet few pivots.
    mask = F.element_at(F.array(*[F.lit(m) for m in ORDERS]), F.pmod("key", F.lit(len(ORDERS))).cast("int") + 1)
    buckets = keys.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.col("node").bitwiseXOR(mask)).alias("m"))
    buckets = cut(buckets.where("rows > 1").select("key", "rows", F.col("m").bitwiseXOR(mask).alias("pivot")))
    inside = cut(_grouped(keys, buckets, ["key"]))
    pairs = inside.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = cut(_sequential(pairs, sigs, threshold))

    ids = cut(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
    sets = cut(_sets(docs, ids, words))
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
    comp = cut(components(_verify(best, sets, num, den).toDF("u", "v")))
    apart = _with_component(_with_component(likely.select("a", "b"), "a", comp, "u"), "b", comp, "v").where("u != v")
    comp = merged(comp, _verify(apart, sets, num, den).select("u", "v"))
    comp = merged(comp, _remaining(docs, inside, comp, sigs, words, num, den))

    found = features.select("doc_id", F.col("n").alias("n_shingles"))
    to = copies.select(F.col("doc_id").alias("_d"), "rep")
    found = found.join(small(to, MAX_BROADCAST), F.col("doc_id") == F.col("_d"), "left").withColumn("rep", F.coalesce("rep", "doc_id")).drop("_d")
    out = _with_component(found, "rep", comp, "component_id").drop("rep")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (nulls last), and of rows that share it the first.

    Rows are linked by a key of their own, so repeated rows and rows without doc_id take part.
    """
    folder, row = scratch(docs.sparkSession, "rows"), free_name(docs, "_row")
    # The keys hold once they are written.
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, num, den)
    linked = cut(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_c")))
    groups = cut(linked.groupBy("_c").agg(F.count("*").alias("rows")).where("rows > 1"))
    several = cut(_grouped(linked, groups, ["_c"]).join(rows.select(F.col(row).alias("_row"), "doc_id"), "_row"))
    first = several.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")).select("_first._row")
    gone = cut(several.select("_row").join(first, "_row", "left_anti").select(F.col("_row").alias("_gone")))
    return rows.join(small(gone, MAX_BROADCAST), rows[row] == gone["_gone"], "left_anti").drop(row)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
