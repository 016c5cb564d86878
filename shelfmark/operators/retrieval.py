"""Questions about one file: retrieval, rerank, context, citations and grades; for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions.columns import cosine
from shelfmark.functions.text import table_intent
from shelfmark.operators.catalogue import top_k

# Scores at which a passage counts, and an answer is graded; the refusal.
FLOOR, HIGH, MEDIUM = 4, 8, 6
REFUSAL = "I don't have enough information in this file to answer that."
CITATION = r"(?i)\[chunk\s*(\d+)\]"


def conversation_context(turns: DataFrame, n: int = 6) -> DataFrame:
    """For each user turn after the first, the n turns before it as labelled lines."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    before = F.collect_list(line).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1))
    t = turns.where(F.col("role").isin("user", "assistant")).withColumn("context", F.array_join(before, "\n"))
    return t.where("role = 'user'").select("conv_id", "turn", "context")


def vector_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Query vectors (query_id, user_id, file_id, query_vector) against the chunks of the same tenant's file."""
    hit = chunks.where("embedding IS NOT NULL").join(queries, ["user_id", "file_id"])
    return hit.select("query_id", "chunk_index", F.round(cosine(F.col("embedding"), F.col("query_vector")), 6).alias("score"))


def over_retrieve(variants: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """Variants of a question (query_id, variant, user_id, file_id, query_vector): k chunks each, then the best score of each chunk."""
    hit = chunks.where("embedding IS NOT NULL AND chunk_index >= 0").join(variants, ["user_id", "file_id"])
    hit = hit.select("query_id", "variant", "chunk_index", F.round(cosine(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    some = top_k(hit, ["query_id", "variant"], [F.desc("score"), F.col("chunk_index")], k, "_n")
    return some.groupBy("query_id", "chunk_index").agg(F.max("score").alias("score"))


def table_boost(candidates: DataFrame) -> DataFrame:
    """Chunks with tables gain in questions for figures; needs question and has_table."""
    up = F.least(F.lit(1.0), F.col("score") * 1.15 + 0.05)
    return candidates.withColumn("score", F.when(table_intent(F.col("question")) & F.col("has_table"), up).otherwise(F.col("score")))


def apply_rerank(candidates: DataFrame, scores: DataFrame, keep: int = 5, pool: int = 20) -> DataFrame:
    """Few candidates keep ten times their score; else outside scores decide, and what has none goes.

    A question without any outside score falls back to its first candidates.
    """
    w = W.partitionBy("query_id")
    c = top_k(candidates, ["query_id"], [F.desc("score"), F.col("chunk_index")], pool, "place")
    c = c.withColumn("_n", F.count("*").over(w)).join(scores.withColumnRenamed("score", "outside"), ["query_id", "chunk_index"], "left")
    own = (F.col("_n") <= keep) | (F.count("outside").over(w) == 0)
    c = c.withColumn("rerank", F.when(own, F.col("score") * 10).otherwise(F.col("outside").cast("double"))).where("rerank IS NOT NULL")
    return top_k(c, ["query_id"], [F.desc("rerank"), F.col("place")], keep).drop("_n", "outside", "place")


def gate(questions: DataFrame, reranked: DataFrame) -> DataFrame:
    """Per question how many chunks pass the floor, and whether it is refused; questions without candidates are."""
    n = reranked.groupBy("query_id").agg(F.count_if(F.col("rerank") >= FLOOR).alias("n_passing"), F.max("rerank").alias("top"))
    out = questions.select("query_id").join(n, "query_id", "left").withColumn("n_passing", F.coalesce("n_passing", F.lit(0)))
    return out.withColumn("refused", F.col("n_passing") == 0)


def exposed(reranked: DataFrame) -> DataFrame:
    """The chunks shown: those that pass, or the first three of a refused question."""
    any_passes = F.max((F.col("rerank") >= FLOOR).cast("int")).over(W.partitionBy("query_id")) == 1
    return reranked.withColumn("_p", any_passes).where((F.col("_p") & (F.col("rerank") >= FLOOR)) | (~F.col("_p") & (F.col("rank") <= 3))).drop("_p")


def context_blocks(passing: DataFrame) -> DataFrame:
    """Numbered bodies of a question, each once: the parent if it is longer than the chunk."""
    body = F.when(F.length("parent_text") > F.length("chunk_text"), F.col("parent_text")).otherwise(F.col("chunk_text"))
    first = top_k(passing.withColumn("body", body), ["query_id", "body"], [F.col("rank")], 1, "_m")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    mark = F.when(F.col("has_table"), " (contains a table)").otherwise("")
    return first.withColumn("n", n).select("query_id", "n", F.concat(F.lit("[Chunk "), F.col("n").cast("string"), F.lit("]"), mark, F.lit("\n"), "body").alias("block"))


def context_text(blocks: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n---\n\n")
    return blocks.groupBy("query_id").agg(F.max("n").alias("n_blocks"), joined.alias("context"))


def clean_citations(answer: Column, n_valid: Column) -> Column:
    """struct(answer, removed, cited): citations beyond the blocks go, and the gaps they leave."""
    nums = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda x: x.cast("int"))
    ok = lambda n: n.between(1, n_valid)
    kept = F.transform(nums, lambda n: F.when(ok(n), F.concat(F.lit("[Chunk "), n.cast("string"), F.lit("]"))).otherwise(""))
    joined = F.array_join(F.zip_with(F.split(answer, CITATION, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+([.,;:!?])", "$1"), " {2,}", " "))
    return F.struct(tidy.alias("answer"), F.size(F.filter(nums, lambda n: ~ok(n))).alias("removed"), F.array_distinct(F.filter(nums, ok)).alias("cited"))


def grade(top: Column, n_cited: Column, n_chunks: Column, out_of_scope: Column) -> Column:
    """R9."""
    cited = n_cited > 0
    return F.when(out_of_scope | (n_chunks == 0), "none").when((top >= HIGH) & cited, "high").when((top >= MEDIUM) & cited, "medium").otherwise("low")


def finalise_answers(answers: DataFrame) -> DataFrame:
    """From query_id, answer, n_valid, top to the answer table; an answer without a valid citation is refused."""
    a = answers.withColumn("c", clean_citations(F.col("answer"), F.col("n_valid")))
    said_no = F.contains(F.lower("answer"), F.lit(REFUSAL.lower()))
    refused = said_no | (F.size("c.cited") == 0)
    return a.select("query_id", F.when(refused & ~said_no, REFUSAL).otherwise(F.col("c.answer")).alias("answer"), F.col("c.removed").alias("removed"), F.size("c.cited").alias("n_cited"), refused.alias("refused"), grade(F.col("top"), F.size("c.cited"), F.col("n_valid"), refused).alias("confidence"))
