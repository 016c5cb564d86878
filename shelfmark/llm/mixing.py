"""Temperature mixing: sources to target weights, realised as budgeted block permutations.

1. Token shares ``p`` of the sources are summed on Spark (map-side first).
2. Weights are ``p^a`` normalised.  Entropy falls and the largest repetition
   (budget * weight / tokens of a source) falls too as ``a`` rises from 0 to 1,
   so ``a`` is bisected: to the target entropy, then, if that repeats a source
   more than ``max_repeats`` times, up to the exponent at which it does not.
3. A source with repetition ``r`` gets ``floor(r)`` whole passes and a part of a
   pass.  Its documents are dealt by hash into blocks, each block is permuted by
   a seeded hash, and the part takes documents in that order while the middle of
   the document lies within the block's budget (so the rounding has no bias).

Scale: a hot source is many blocks; only (source, block, hash, tokens) is
shuffled, never a text.  Blocks number at most ``max_blocks`` plus one per source.

Defined results: a null or blank text has no token, takes no part in shares and
is emitted in whole passes only; a source of such texts alone has weight 0 and one
pass.  A null source is a source of its own.  A budget above ``max_repeats`` is an error.  An empty table gives an
empty schedule.  Repeated rows are separate documents (equal
rows stand at one place of the permutation: a partial pass takes all of them or none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.llm.common import cut, small, table

MAX_SOURCES = 100_000


@dataclass(frozen=True)
class MixConfig:
    #: Target entropy of the weights, as a share of that of equal weights.
    entropy: float = 0.97
    #: The target is also this share of the way from the entropy of the natural shares to that of equal weights, at least.
    lift: float = 0.0
    #: No source is repeated more often than this.
    max_repeats: float = 4.0
    #: Tokens to emit, as a multiple of the corpus.
    budget: float = 1.0
    seed: int = 17
    block_tokens: int = 250_000
    max_blocks: int = 1 << 16


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def solve(tokens: np.ndarray, cfg: MixConfig) -> tuple[float, np.ndarray]:
    """The exponent and the weights for token totals ``tokens`` (all positive)."""
    if cfg.budget > cfg.max_repeats:
        raise ValueError("a budget above max_repeats has no weights")
    logp = np.log(tokens / tokens.sum())

    def weights(a: float) -> np.ndarray:
        w = np.exp(a * logp - (a * logp).max())
        return w / w.sum()

    def entropy(a: float) -> float:
        w = weights(a)
        return float(-(w * np.log(np.maximum(w, 1e-300))).sum())

    def repeats(a: float) -> float:
        return float((cfg.budget * tokens.sum() * weights(a) / tokens).max())

    def bisect(too_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if too_low(mid) else (low, mid)
        return high

    equal = np.log(len(tokens))
    target = max(cfg.entropy * equal, entropy(1.0) + cfg.lift * (equal - entropy(1.0))) if len(tokens) > 1 else 0.0
    a = 1.0 if entropy(1.0) >= target else bisect(lambda x: entropy(x) > target)
    if repeats(a) > cfg.max_repeats:
        a = max(a, bisect(lambda x: repeats(x) > cfg.max_repeats))
    return a, weights(a)


def source_weights(counted: DataFrame, cfg: MixConfig) -> DataFrame:
    """Per source: tokens, weight, exponent, passes, part, blocks.  ``counted`` has source and tokens."""
    totals = cut(counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens")))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    rows = sorted(totals.collect(), key=lambda r: (r.source is not None, r.source or ""))
    schema = "source string, source_tokens long, weight double, exponent double, repeats double, passes int, part double, n_blocks int"
    if not rows:
        return counted.sparkSession.createDataFrame([], schema)
    t = np.array([r.source_tokens for r in rows], dtype=np.float64)
    some = t > 0
    a, w, r = 1.0, np.zeros(len(t)), np.ones(len(t))
    if some.any():
        a, w[some] = solve(t[some], cfg)
        # Rounded, so that whole passes stay whole.
        r[some] = np.round(cfg.budget * t.sum() * w[some] / t[some], 9)
    size = max(cfg.block_tokens, t.sum() / cfg.max_blocks)
    out = [(x.source, int(x.source_tokens), float(w[i]), a, float(r[i]), int(r[i]), float(r[i] - int(r[i])), max(1, int(np.ceil(t[i] / size)))) for i, x in enumerate(rows)]
    return counted.sparkSession.createDataFrame(out, schema)


def _keyed(docs: DataFrame, weights: DataFrame, cfg: MixConfig, *keep: str) -> DataFrame:
    """Add tokens, block and the place ``perm`` in the block's permutation."""
    d = docs.select(*keep, token_count(F.col("text")).alias("_tokens"), F.xxhash64(F.lit(cfg.seed), "doc_id", "text").alias("_perm"))
    d = d.join(F.broadcast(weights), d["source"].eqNullSafe(weights["source"])).drop(weights["source"])
    return d.withColumn("_block", F.pmod(F.xxhash64(F.lit(cfg.seed + 1), "_perm"), F.col("n_blocks")).cast("int"))


def _ranked(keyed: DataFrame) -> DataFrame:
    """Mark by ``_in`` the documents that the last, partial pass takes."""
    block = W.partitionBy("source", "_block")
    upto = block.orderBy("_perm", "doc_id").rangeBetween(W.unboundedPreceding, 0)
    d = keyed.withColumn("_cum", F.sum("_tokens").over(upto)).withColumn("_all", F.sum("_tokens").over(block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return d.withColumn("_in", (F.col("_cum") - F.col("_tokens") / 2 < F.col("part") * F.col("_all")) & (F.col("_tokens") > 0))


def schedule(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """One row per emitted document: doc_id, source, tokens, pass_no, block, block_order, position, weight, repeats.

    Reading order is (pass_no, block_order, position): in each pass the blocks
    of all sources are permuted together.
    """
    weights = source_weights(docs.select("source", token_count(F.col("text")).alias("tokens")), cfg)
    d = _ranked(_keyed(docs, weights, cfg, "doc_id", "source"))
    d = d.withColumn("position", F.row_number().over(W.partitionBy("source", "_block").orderBy("_perm", "doc_id")))
    copies = F.col("passes") + F.col("_in").cast("int")
    d = d.where(copies > 0).withColumn("pass_no", F.explode(F.sequence(F.lit(0), copies - 1)))
    order = F.xxhash64(F.lit(cfg.seed + 2), "source", "_block", "pass_no").alias("block_order")
    return d.select("doc_id", "source", F.col("_tokens").alias("tokens"), "pass_no", F.col("_block").alias("block"), order, "position", "weight", "repeats")


def mix(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` (all its columns) with each row as often as the schedule emits it; texts are not shuffled."""
    weights = source_weights(docs.select("source", token_count(F.col("text")).alias("tokens")), cfg)
    ranked = _ranked(_keyed(docs, weights, cfg, "doc_id", "source"))
    # Where the partial pass of a block ends: one row per block, a bounded table.
    ends = cut(ranked.where("_in").groupBy(F.col("source").alias("_s"), F.col("_block").alias("_bl")).agg(F.max(F.struct("_perm", "doc_id")).alias("_end")))
    d = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "doc_id", "source", "text")
    d = _keyed(d, weights, cfg, "_row", "doc_id", "source")
    d = d.join(small(ends, cfg.max_blocks + MAX_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_bl")), "left")
    partial = F.coalesce((F.struct("_perm", "doc_id") <= F.col("_end")) & (F.col("_tokens") > 0), F.lit(False))
    copies = F.col("passes") + partial.cast("int")
    return d.where(copies > 0).select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MixConfig(lift=0.5))
