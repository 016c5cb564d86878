"""Exact vector search for many queries: blocks of vectors against packs of queries.

Vectors of a tenant's collection are packed into blocks of bounded size, chosen by a hash of
their keys, and queries of a tenant into packs.  A block meets each pack of its tenant once, and
one matrix product gives all cosines of the two; what leaves is a short list for each query
of the block, so cosines are never rows of a table.  Packs of up to ``SENT_BYTES`` go to every task
and blocks stay where they are.  For more, blocks carry a salt and packs are copied for
every salt of their tenant, so a tenant that holds most vectors is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.operators.catalogue import top_k

#: Vectors of a block, queries of a pack, and blocks of a salt.
BLOCK, PACK, SALT = 1024, 256, 16
#: Query vectors that are sent to every task.
SENT_BYTES = 64 << 20
#: Half a unit of the sixth decimal, and more: cosines this near may be equal when rounded and scaled.
NEAR = 4e-6


def _numbered(df: DataFrame, group: list[str], size: int, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, a number below ``_n``: hashes deal each group into parts of about ``size`` rows."""
    n = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(size)).alias("_n"))
    return df.join(n, group).withColumn(name, F.pmod(F.xxhash64(*by), F.col("_n")))


def packs_of(vectors: DataFrame, keys: list[str], scope: list[str], extra: list[str]) -> DataFrame:
    """Blocks: scope, extra, _salt, _salts and rows (keys, embedding); null vectors take no part."""
    v = _numbered(vectors.where("embedding IS NOT NULL").select(*scope, *extra, *keys, "embedding"), scope, BLOCK, keys, "_block")
    v = v.withColumn("_salts", F.ceil(F.col("_n") / F.lit(SALT))).withColumn("_salt", F.pmod("_block", "_salts"))
    return v.groupBy(*scope, *extra, "_salt", "_salts", "_block").agg(F.collect_list(F.struct(*keys, "embedding")).alias("rows"))


def packs_in_place(vectors: DataFrame, scope: list[str], extra: list[str]) -> DataFrame:
    """Blocks of ``BLOCK`` vectors at most, without keys, made by each task of the rows that it has: nothing is shuffled."""
    group = [*scope, *extra]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            t = pa.Table.from_batches([part]).combine_chunks()
            g = t.select(group).append_column("_at", pa.array(np.arange(len(t)))).group_by(group, use_threads=False).aggregate([("_at", "list")]).combine_chunks()
            lists = g["_at_list"].combine_chunks() if isinstance(g["_at_list"], pa.ChunkedArray) else g["_at_list"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = -(-np.diff(ends) // BLOCK)
            of = np.repeat(np.arange(len(n)), n)
            begins = ends[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            rows = pa.StructArray.from_arrays([pc.take(t["embedding"].combine_chunks(), lists.flatten())], names=["embedding"])
            blocks = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*[g[c].combine_chunks().take(pa.array(of)) for c in group], blocks], names=[*group, "rows"])

    v = vectors.where("embedding IS NOT NULL").select(*group, "embedding")
    schema = v.select(*group).schema.add("rows", DataType.fromDDL(f"array<struct<embedding: {v.schema['embedding'].dataType.simpleString()}>>"))
    made = v.mapInArrow(run, schema)
    return made.withColumn("_salts", F.lit(SALT).cast("long")).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALT)).cast("long"))


def few(queries: DataFrame) -> bool:
    """Whether the vectors of ``queries`` go to every task; reads them once."""
    r = queries.where("query_vector IS NOT NULL").agg(F.coalesce(F.sum(16 + 8 * F.size("query_vector")), F.lit(0)).alias("n")).first()
    return r.n <= SENT_BYTES


def _meet(queries: DataFrame, blocks: DataFrame, scope: list[str]) -> DataFrame:
    q = _numbered(queries.where("query_vector IS NOT NULL").select(*scope, "query_id", "query_vector"), scope, PACK, ["query_id"], "_pack")
    q = q.groupBy(*scope, "_pack").agg(F.collect_list(F.struct("query_id", "query_vector")).alias("asked"))
    if few(queries):
        return blocks.drop("_salts", "_salt", "_block").join(F.broadcast(q.drop("_pack")), scope)
    salts = blocks.select(*scope, "_salts").distinct()
    q = q.join(salts, scope).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts", "_pack")
    return blocks.drop("_salts", "_block").join(q, [*scope, "_salt"]).drop("_salt")


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, null components as 0 and short ones filled with 0, and their lengths."""
    size = np.diff(lists.offsets.to_numpy())
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, np.sqrt((out * out).sum(axis=1))


def cosines(block: pa.ListArray, asked: pa.ListArray) -> np.ndarray:
    """T19 for all pairs: a row for each query; the longer vectors count as far as the shorter go only where lengths are equal."""
    (d, dl), (q, ql) = _matrix(block), _matrix(asked)
    n = min(d.shape[1], q.shape[1])
    like = (q[:, :n] @ d[:, :n].T) / (ql[:, None] * dl[None, :] + 1e-9)
    return np.round(like, 6) + 0.0


def block_lists(queries: DataFrame, blocks: DataFrame, keys: list[str], scope: list[str], k: int, near: float = 0.0) -> DataFrame:
    """For each query and block: scope, the block's other columns, query_id, low, high and the ``k`` best (keys, score), with what ties with the last."""
    met = _meet(queries, blocks, scope)
    plain = [c for c in met.columns if c not in ("rows", "asked")]
    fields = "".join(f"{c}: {blocks.schema['rows'].dataType.elementType[c].dataType.simpleString()}, " for c in keys)
    query_type = met.schema["asked"].dataType.elementType["query_id"].dataType
    schema = met.select(*plain).schema.add("query_id", query_type).add("low", "double").add("high", "double").add("best", DataType.fromDDL(f"array<struct<{fields}score: double>>"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                rows, asked = part.column(part.schema.get_field_index("rows"))[i].values, part.column(part.schema.get_field_index("asked"))[i].values
                like = cosines(rows.field("embedding"), asked.field("query_vector"))
                ids = [rows.field(c) for c in keys]
                taken, ends = [], [0]
                for score in like if k else ():
                    at = np.arange(len(score))
                    if len(score) > k:
                        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - near)
                    taken.append(at)
                    ends.append(ends[-1] + len(at))
                flat = np.concatenate(taken) if taken else np.zeros(0, np.int64)
                scores = like[np.repeat(np.arange(len(taken)), np.diff(ends)), flat] if taken else np.zeros(0)
                items = pa.StructArray.from_arrays([*[c.take(pa.array(flat)) for c in ids], pa.array(scores)], names=[*keys, "score"])
                lists = pa.ListArray.from_arrays(pa.array(ends if k else [0] * (len(like) + 1), pa.int32()), items)
                same = [part.column(part.schema.get_field_index(c)).slice(i, 1).take(pa.array(np.zeros(len(like), np.int64))) for c in plain]
                yield pa.RecordBatch.from_arrays([*same, asked.field("query_id"), pa.array(like.min(axis=1)), pa.array(like.max(axis=1)), lists], names=[*plain, "query_id", "low", "high", "best"])

    return met.select(*plain, "rows", "asked").mapInArrow(run, schema)


def score_ranges(queries: DataFrame, blocks: DataFrame, keys: list[str], scope: list[str], by: list[str]) -> DataFrame:
    """The least and the greatest cosine of each (query_id, ``by``)."""
    return block_lists(queries, blocks, keys, scope, 0).groupBy("query_id", *by).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def nearest(queries: DataFrame, vectors: DataFrame, keys: list[str], scope: list[str], k: int, order: list[Column] | None = None) -> DataFrame:
    """The k nearest vectors of each query in its scope: query_id, scope, keys, score, rank; ties go by ``order``, else by the keys."""
    blocks = packs_of(vectors, keys, scope, [])
    rows = block_lists(queries, blocks, keys, scope, k).select(*scope, "query_id", F.explode("best").alias("b")).select(*scope, "query_id", "b.*")
    return top_k(rows, ["query_id"], [F.desc("score"), *(order or map(F.col, keys))], k)
