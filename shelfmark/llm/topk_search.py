"""Exact top-k by inner product, over vectors in order of descending length.

Components are scaled to integers, so scores are exact.  Candidates are cut into
levels of descending norm and levels into blocks of about ``BLOCK`` vectors
(dealt by hash, so that equal norms don't meet in one block).  Queries are packed
``PACK`` at a time.

1. Each pack meets the first block of longest vectors, which gives each query a
   score that its k-th best will not fall below.
2. By Cauchy-Schwarz a level whose longest vector can't reach that score can't
   hold a better one, nor can the levels after it: a pack is sent only to the
   blocks of the levels before.
3. In a block, vectors go by descending norm in chunks; a chunk that no query
   can use ends the block.  Vectors are rotated by the right singular vectors of
   the data, so the first coordinates hold most of the product.  Partial sums grow
   in stages (``STAGES``); after each, the sum plus the product of the norms of
   what is left bounds a pair, queries and candidates without a pair go, and only
   pairs that pass the last stage are computed in full.  Bounds of all pairs of a
   chunk are one matrix product.  A stage before the last that sends off too few
   is left out for the rest of the block.
4. A task keeps the best of each pack over all blocks that it meets.

The first block's results are kept from step 1; it is not met again.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are compared as if padded with zeros;
an empty vector scores 0.  A row is no candidate for a query of its own vec_id;
rows with a null vec_id take no part.  Ties go to the smaller vec_id; a repeated
candidate row counts each time.  Scores must stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.llm.common import cut, table

BLOCK, PACK, CHUNK, LEVELS = 4096, 2048, 512, 64
#: Bytes of queries that are sent to every task, and that a task holds at a time.
SEND = 1 << 26
#: Shares of the rotated coordinates in the partial sums.
STAGES = (0.25, 0.5, 0.75)
#: Below this share of open pairs of a chunk, they are computed one by one.
SPARSE = 0.02
#: A stage before the last that leaves more than this share of a chunk's rows times columns is no gain.
WORTH = 0.75
FOUND = ["query_id", "vec_id", "score"]


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from their d x d Gram matrix; it is summed in a tree."""

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = np.zeros((dim, dim)), 0
        for part in parts:
            at = int(part["at"].iloc[0]) if len(part) else at
            m = _matrix(part["v"], dim)
            total += m.T @ m
        yield pd.DataFrame({"at": [at], "g": [total.tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [int(part["at"].iloc[0])], "g": [sum(np.frombuffer(x, np.float64) for x in part["g"]).tobytes()]})

    rows = vectors.select(F.spark_partition_id().cast("long").alias("at"), "v").mapInPandas(gram, "at long, g binary")
    got = rows.groupBy(F.pmod("at", F.lit(256))).applyInPandas(add, "at long, g binary").toPandas()
    if not len(got) or not dim:
        return np.eye(dim)
    values, basis = np.linalg.eigh(sum(np.frombuffer(x, np.float64) for x in got["g"]).reshape(dim, dim))
    return np.ascontiguousarray(basis[:, np.argsort(-values)])


class Block:
    """Candidates in order of descending norm, with what a pack needs of them at each stage."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, basis: np.ndarray) -> None:
        self.vectors, self.ids, self.norm = vectors, ids, np.linalg.norm(vectors, axis=1)
        self.stages, self.whole, self.room = staged(vectors, self.norm, basis), exact(vectors, self.norm), np.zeros(0)

    def product(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of all rows of the two, in memory that is used again."""
        kind, size = np.result_type(q, c), len(q) * len(c)
        if len(self.room) < size or self.room.dtype != kind:
            self.room = np.empty(size, kind)
        return np.matmul(q, c.T, out=self.room[:size].reshape(len(q), len(c)))


def staged(vectors: np.ndarray, norm: np.ndarray, basis: np.ndarray) -> list[np.ndarray]:
    """For each stage the first rotated coordinates and after them the norm of the rest: the product of two such rows is
    a partial sum plus the product of what is left.  Halves of the usual width hold them if that can't overflow."""
    dim = vectors.shape[1]
    edges = sorted({max(1, int(dim * x)) for x in STAGES})
    rotated = vectors @ basis[:, : edges[-1]]
    kind = np.float32 if norm.max(initial=0) < 1e15 else np.float64
    rest = lambda e: np.sqrt(np.maximum(0, norm**2 - (rotated[:, :e] ** 2).sum(axis=1)))
    return [np.column_stack([rotated[:, :e], rest(e)]).astype(kind) for e in edges]


def exact(vectors: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The vectors, in half the width where sums of products of two such stay below 2^24, so that they are exact."""
    return vectors.astype(np.float32) if norm.max(initial=0) < 4096 else vectors


class Pack:
    """Queries with the k best candidates of the blocks met so far; only such as reach ``low`` count."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, basis: np.ndarray, k: int) -> None:
        self.vectors, self.ids, self.low, self.k, self.norm = vectors, ids, low.copy(), k, np.linalg.norm(vectors, axis=1)
        self.stages, self.whole = staged(vectors, self.norm, basis), exact(vectors, self.norm)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, block: Block) -> list[int]:
        """Numbers of pairs: all, those that pass the norms, then those that pass each stage (one that is left out passes all)."""
        n, top, last = len(block.ids), block.norm.max(initial=0), len(self.stages) - 1
        pairs = [len(self.ids) * n, 0] + [0] * len(self.stages)
        # Rounding of the rotated products stays below this.
        narrow = all(x[0].dtype == np.float32 for x in (self.stages, block.stages))
        slack = ((self.vectors.shape[1] + 8) * 2.0**-22 if narrow else 1e-6) * self.norm * top + 1e-6
        idle: set[int] = set()
        for a in range(0, n, CHUNK):
            rows = np.flatnonzero(self.norm * block.norm[a] + slack >= self.low)
            if not len(rows):
                break
            cols = np.arange(a, min(a + CHUNK, n))
            size = still = len(rows) * len(cols)
            pairs[1] += size
            for i, (q, c) in enumerate(zip(self.stages, block.stages, strict=True)):
                if i not in idle:
                    least = (self.low - slack)[rows]
                    if narrow:
                        # Rounded down.
                        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                    open_ = block.product(q[rows], c[cols]) >= least[:, None]
                    still = min(still, int(np.count_nonzero(open_)))
                    some, other = open_.any(axis=1), open_.any(axis=0)
                    if int(some.sum()) * int(other.sum()) <= WORTH * open_.size:
                        rows, cols, open_ = rows[some], cols[other], open_[np.ix_(some, other)]
                    elif i < last:
                        # Most rows and columns stay: the stage is left out for the rest of the block.
                        idle.add(i)
                pairs[2 + i] += still
            self._take(rows, cols, open_, block, still > SPARSE * size)
        return pairs

    def _take(self, rows: np.ndarray, cols: np.ndarray, open_: np.ndarray, block: Block, dense: bool) -> None:
        """Exact scores of the open pairs; the best of them and of those before stay."""
        if dense:
            scores = block.product(self.whole[rows], block.whole[cols])
            open_ = scores >= self.low[rows].astype(scores.dtype)[:, None]
        at = np.flatnonzero(open_)
        if not len(at):
            return
        x, y = rows[at // len(cols)], cols[at % len(cols)]
        s = scores.ravel()[at].astype(np.float64) if dense else np.einsum("ij,ij->i", self.vectors[x], block.vectors[y])
        fits = (s >= self.low[x]) & (self.ids[x] != block.ids[y])
        x, s, ids = x[fits], s[fits], block.ids[y[fits]]
        if not len(x):
            return
        mine = np.unique(x)
        held = self.score[mine] > -np.inf
        x = np.concatenate([np.repeat(mine, held.sum(axis=1)), x])
        s, ids = np.concatenate([self.score[mine][held], s]), np.concatenate([self.found[mine][held], ids])
        order = np.lexsort((ids, -s, x))
        x, s, ids = x[order], s[order], ids[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        best = rank < self.k
        self.score[x[best], rank[best]], self.found[x[best], rank[best]] = s[best], ids[best]
        self.low[mine] = np.maximum(self.low[mine], self.score[mine, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns query_id, vec_id and score."""
        i, j = np.nonzero(self.score > -np.inf)
        return self.ids[i], self.found[i, j], np.round(self.score[i, j]).astype(np.int64)


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, low: np.ndarray, basis: np.ndarray, k: int) -> tuple[list, np.ndarray, list[int]]:
    """One pack against one block: rows (query, vec_id, score), the raised lower bounds, and the numbers of pairs of ``Pack.meet``."""
    pack = Pack(q, q_ids, low, basis, k)
    pairs = pack.meet(Block(c, c_ids, basis))
    return list(zip(*(x.tolist() for x in pack.rows()), strict=True)), pack.low, pairs


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """Both tables (vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = candidates.sparkSession

    def prepare(df: DataFrame) -> DataFrame:
        ok = df.where("vec_id is not null").where(usable(F.col("embedding")))
        v = ok.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
        return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))

    out_schema = "query_id long, rank int, vec_id long, score long"
    cand, query = cut(prepare(candidates)), cut(prepare(queries).dropDuplicates(["vec_id", "v"]))
    size = cand.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = query.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n or not asked.n:
        return spark.createDataFrame([], out_schema)
    # Vectors may all be empty.
    dim = max(1, size.d, asked.d)
    basis = rotation(cand, dim)
    n_levels = min(LEVELS, -(-size.n // BLOCK))
    # Norms at which levels begin, descending; the list is at most LEVELS long.
    edges = sorted(set(cand.approxQuantile("norm", [i / n_levels for i in range(1, n_levels)], 0.002)), reverse=True) if n_levels > 1 else []
    listed = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    cand = cand.withColumn("level", F.size(F.filter(listed(edges, "double"), lambda e: e > F.col("norm"))))
    levels = sorted(cand.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect(), key=lambda r: r.level)
    parts = {r.level: -(-r.n // BLOCK) for r in levels}
    deal = F.pmod(F.xxhash64("vec_id", "v"), F.get(listed([parts.get(a, 1) for a in range(len(edges) + 1)], "long"), F.col("level"))).cast("int")

    def pack(keys: list[str]):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["norm", "vec_id"], ascending=[False, True])
            row = {c: [part[c].iloc[0]] for c in keys}
            return pd.DataFrame(row | {"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "m": [_matrix(part["v"], dim).tobytes()]})

        return run

    blocks = cut(cand.withColumn("sub", deal).groupBy("level", "sub").applyInPandas(pack(["level", "sub"]), "level int, sub int, ids binary, m binary"))
    n_packs = -(-asked.n // PACK)
    packs = query.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(n_packs)).cast("int")).groupBy("pack").applyInPandas(pack(["pack"]), "pack int, ids binary, m binary")
    packs = packs.withColumnsRenamed({"ids": "q_ids", "m": "q_m"})

    read = lambda ids, m: (np.frombuffer(m, np.float64).reshape(-1, dim), np.frombuffer(ids, np.int64))
    tops = [(r.level, r.top) for r in levels]

    def begin(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_:
            for r in part.itertuples(index=False):
                pack = Pack(*read(r.q_ids, r.q_m), np.full(len(r.q_ids) // 8, -np.inf), basis, k)
                pack.meet(Block(*read(r.ids, r.m), basis))
                last = max(a for a, top in tops if a == tops[0][0] or (pack.norm * top * (1 + 1e-9) + 1e-6 >= pack.low).any())
                row = {"pack": [r.pack], "q_ids": [r.q_ids], "q_m": [r.q_m], "low": [pack.low.tobytes()], "last": [last], "met": [r.sub]}
                yield pd.DataFrame(row | {n: [x.tolist()] for n, x in zip(FOUND, pack.rows(), strict=True)})

    # One block of at most a few MB meets every pack.
    first = blocks.where(F.col("level") == tops[0][0]).orderBy("sub").limit(1).select("sub", "ids", "m")
    begun = cut(packs.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").drop("one").mapInPandas(begin, "pack int, q_ids binary, q_m binary, low binary, last int, met int, query_id array<long>, vec_id array<long>, score array<long>"))
    asked_of = begun.select("pack", "q_ids", "q_m", "low", "last", "met")
    if asked.n * dim * 8 <= SEND:
        # All packs go to every task, and blocks are dealt evenly.
        spread = blocks.repartition(min(sum(parts.values()), 4 * spark.sparkContext.defaultParallelism))
        sent = spread.join(F.broadcast(asked_of), F.col("level") <= F.col("last"))
    else:
        reach = F.filter(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("n")) for a, b in parts.items()]), lambda x: x["level"] <= F.col("last"))
        to = asked_of.withColumn("to", F.explode(reach)).select(*asked_of.columns, F.col("to.level").alias("level"), F.explode(F.sequence(F.lit(0), F.col("to.n") - 1)).alias("sub"))
        sent = blocks.join(to, ["level", "sub"])
    sent = sent.where((F.col("level") != tops[0][0]) | (F.col("sub") != F.col("met")))

    def meet(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task keeps the best of each pack, so later blocks meet higher bounds.
        held: dict[int, Pack] = {}
        at, block = None, None
        for part in parts_:
            for r in part.itertuples(index=False):
                if at != (r.level, r.sub):
                    at, block = (r.level, r.sub), Block(*read(r.ids, r.m), basis)
                if r.pack not in held:
                    if sum(p.vectors.nbytes for p in held.values()) > SEND:
                        for p in held.values():
                            yield pd.DataFrame(dict(zip(FOUND, p.rows(), strict=True)))
                        held.clear()
                    held[r.pack] = Pack(*read(r.q_ids, r.q_m), np.frombuffer(r.low, np.float64), basis, k)
                held[r.pack].meet(block)
        for p in held.values():
            yield pd.DataFrame(dict(zip(FOUND, p.rows(), strict=True)))

    near = sent.select("level", "sub", "ids", "m", "pack", "q_ids", "q_m", "low").mapInPandas(meet, "query_id long, vec_id long, score long")
    near = near.unionByName(begun.select(F.explode(F.arrays_zip(*FOUND)).alias("f")).select("f.*"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP6_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
