"""Operators over tables of texts: reports, choices, plans and joins by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.columns import bind, norm_list
from shelfmark.operators.catalogue import best_per_key


def boilerplate_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """Per document the trimmed lines of 4 to 120 characters that occur ``least`` times or more."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.length("line").between(4, 120))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_repeats(text: Column, least: int = 3) -> Column:
    """``text`` without its boilerplate lines.

    Lines repeat within one document, so the count is taken inside the row.  Each
    step is bound to a lambda variable: a filter that the planner moves below this
    column then sorts the lines once a row, not once for each line.
    """

    def keep(lines: Column, frequent: Column) -> Column:
        kept = F.filter(lines, lambda x: ~F.array_contains(frequent, F.trim(x)))
        return F.when(F.size(frequent) > 0, F.array_join(kept, "\n"))

    def count(lines: Column) -> Column:
        # Sorted, equal lines are neighbours: a line is frequent if it equals the one ``least - 1`` places on.
        frequent = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + (least - 1)) == x))
        ordered = F.array_sort(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x).between(4, 120)))
        return bind(bind(ordered, frequent), lambda f: keep(lines, f))

    return bind(text, lambda t: F.coalesce(bind(F.split(t, "\n"), count), t))


def strip_boilerplate(docs: DataFrame, least: int = 3) -> DataFrame:
    """T8 over a table with a column ``text``; nothing is shuffled."""
    return docs.withColumn("text", without_repeats(F.col("text"), least))


def redaction_report(docs: DataFrame) -> DataFrame:
    """Matches per kind over a batch."""
    # The outer form keeps the planner from repeating the redaction in a filter below it.
    counts = X.redact(docs).select(F.explode_outer("counts").alias("kind", "n")).where("kind IS NOT NULL")
    return counts.groupBy("kind").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_texts"))


def entity_filter(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files of the tenant whose lists share an item with the query's, and the items; needs column ``index``."""
    asked = queries.select("query_id", "user_id", F.explode(norm_list(F.col("items"))).alias("item"))
    lists = F.concat(*[F.coalesce(F.col(f"index.{c}"), F.array().cast("array<string>")) for c in ("entities", "relevant_dates", "document_ids", "technical_topics")])
    held = summaries.select("file_id", "user_id", F.explode(norm_list(lists)).alias("item"))
    return asked.join(held, ["user_id", "item"]).groupBy("query_id", "file_id").agg(F.sort_array(F.collect_set("item")).alias("matched"))


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """Per file the first text, by preference, that passes the gate; the plain text needs only to hold something."""
    gate = X.quality_gate(F.col("text"))
    ok = ~gate["bad"] | ((F.col("method") == "plain") & (F.length(F.trim("text")) > 0))
    rank = F.when(F.col("method") == "primary", 0).when(F.col("method") == "secondary", 1).otherwise(2)
    return best_per_key(candidates.where(ok).withColumn("_p", rank), ["file_id"], [F.col("_p")]).drop("_p")


def triage_blobs(blobs: DataFrame) -> DataFrame:
    """What kind of PDF a blob is; needs content (null: no PDF), length and the characters its text layer gave."""
    head = F.substring("content", 1, 4096).cast("string")
    pdf = F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")
    verdict = F.when(~F.coalesce(pdf, F.lit(False)), "not_pdf").when(F.contains(head, F.lit("/Encrypt")), "encrypted").when((F.col("text_chars") < 50) & (F.col("length") > 100_000), "image_only").otherwise("ok")
    return blobs.withColumn("verdict", verdict)


def embedding_inputs(summaries: DataFrame, most_tokens: int = 1900) -> DataFrame:
    """Texts to embed: the summary with its keywords, and each insight with a hint of the first entities."""
    limit = lambda c: F.substring(F.trim(c), 1, 4 * most_tokens)
    hint = F.array_join(F.slice("entities", 1, 3), ", ")
    whole = F.concat("summary", F.lit("\n\nKeywords: "), F.array_join("entities", ", "))
    one = summaries.select("file_id", F.lit("summary").alias("kind"), F.lit(0).alias("pos"), limit(whole).alias("text"), F.col("summary").alias("_s")).where("length(trim(_s)) > 0").drop("_s")
    each = summaries.select("file_id", hint.alias("_h"), F.posexplode("insights").alias("pos", "i")).where("length(trim(i)) > 0")
    each = each.select("file_id", F.lit("insight").alias("kind"), "pos", limit(F.when(F.col("_h") != "", F.concat("i", F.lit(" ("), "_h", F.lit(")"))).otherwise(F.col("i"))).alias("text"))
    return one.unionByName(each)
