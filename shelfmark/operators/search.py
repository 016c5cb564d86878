"""Federated ranked search for many queries at once.

Six signals are ranked per (query, collection), united, fused by weighted
reciprocal ranks, boosted, cut to the best rows and re-ordered for diversity.
Queries and files meet on equi-join keys only: the tenant with a term, or with three
characters of a name.  Words are read from stored indexes (``operators.index``), vectors
in blocks (``operators.vectors``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.functions.columns import dot
from shelfmark.operators import vectors as V
from shelfmark.operators.catalogue import federate, top_k
from shelfmark.operators.index import Index, bm25
from shelfmark.sources.stored import settled

#: Patterns, and rows of a query and collection, that are sent to every task; more are joined by a shuffle.
FEW = 200_000

# The constant of reciprocal ranks, and the weight of each signal.
RRF_K = 60
WEIGHTS = {"filename:full": 3.0, "filename:tokenized": 2.0, "chunk:bm25": 2.0, "summary:bm25": 2.0, "chunk:hybrid": 1.5, "raw_text:bm25": 1.5}


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Q1: query_id, user_id, query, keywords and the text that is matched by words."""
    return queries.select("query_id", "user_id", "query", X.keywords(F.col("query")).alias("kw"), X.keyword_query(F.col("query")).alias("bm25_query"))


def rank_files(hits: DataFrame, k: int, tie: str = "chunk_index") -> DataFrame:
    """The k best hits of each (query, collection), then ranks over distinct files, each by its best hit."""
    first = top_k(hits, ["query_id", "collection"], [F.desc("score"), F.col("file_id"), F.col(tie)], k, "_n")
    best = top_k(first, ["query_id", "collection", "file_id"], [F.col("_n")], 1, "_m")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "collection").orderBy("_n"))).drop("_n", "_m")


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters; none for shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


def names_like(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """``patterns`` (query_id, user_id, part) with the files of their tenant whose lower-case name fits ``part``.

    A pattern fits if the name holds its literals, the pieces between its ``*``, one after the
    other; one without ``*`` is a single literal.  A pattern without any literal, or null, fits nothing.
    A name that fits holds all runs of three characters of the literals, so a pattern meets the names
    that hold the run that the fewest names of the tenant hold, and none if a run is nowhere.  Patterns
    whose literals have one or two characters, which most names hold, meet all names of their tenant.
    """
    names = files.select("user_id", "collection", "file_id", "created_at", F.lower("filename").alias("name")).where("length(name) > 0")
    p = patterns.withColumn("_id", F.struct("query_id", "part")).withColumn("_literals", F.filter(F.split("part", r"\*"), lambda x: F.length(x) > 0))
    p = p.where("size(_literals) > 0").distinct().withColumn("_grams", F.array_distinct(F.flatten(F.transform("_literals", grams_of))))
    quoted = F.transform("_literals", lambda x: F.regexp_replace(x, r"([\\%_])", r"\\$1"))
    p = p.withColumn("_like", F.concat(F.lit("%"), F.array_join(quoted, "%"), F.lit("%")))
    # Few patterns go to every task, so that names and their runs stay where they are.
    sent = F.broadcast if patterns.count() <= FEW else lambda df: df
    fits = F.expr("name LIKE _like")
    grams = p.select("user_id", "_id", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    # Runs that no pattern has go before names are counted or shuffled by them.
    held = names.select("*", F.explode(grams_of(F.col("name"))).alias("gram")).join(sent(grams.select("user_id", "gram").distinct()), ["user_id", "gram"], "left_semi")
    count = held.groupBy("user_id", "gram").agg(F.count("*").alias("_count"))
    best = grams.join(count, ["user_id", "gram"]).groupBy("user_id", "_id").agg(F.first("_n").alias("_n"), F.count("*").alias("_found"), F.min_by("gram", F.struct("_count", "gram")).alias("gram"))
    rarest = best.where("_found = _n").select("user_id", "_id", "gram")
    long = held.join(sent(p.join(rarest, ["user_id", "_id"])), ["user_id", "gram"]).where(fits).select(*patterns.columns, "collection", "file_id", "created_at", "name")
    short = names.join(sent(p.where("size(_grams) = 0")), "user_id").where(fits).select(*long.columns)
    return long.unionByName(short)


def names_holding(parts: DataFrame, files: DataFrame) -> DataFrame:
    """``parts`` (query_id, user_id, part) with the files of their tenant whose lower-case name holds the part, ``*`` being a character like others."""
    star = F.lit("\ue000")
    hidden = parts.withColumn("part", F.replace("part", F.lit("*"), star))
    met = names_like(hidden, files.withColumn("filename", F.replace("filename", F.lit("*"), star)))
    return met.withColumns({c: F.replace(c, star, F.lit("*")) for c in ("part", "name")})


def sig_filename_full(queries: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """Q3: the name holds the whole query."""
    hit = names_holding(queries.select("query_id", "user_id", F.lower(F.trim("query")).alias("part")), files)
    return top_k(hit, ["query_id", "collection"], [F.desc("created_at"), F.col("file_id")], k).select("query_id", "collection", "file_id", "rank")


def sig_filename_tokens(queries: DataFrame, files: DataFrame, k: int = 20) -> DataFrame:
    """Q4: the name holds keywords; more of them rank higher."""
    hit = names_holding(queries.select("query_id", "user_id", F.explode(F.array_distinct("kw")).alias("part")), files)
    hit = hit.groupBy("query_id", "collection", "file_id", "created_at").agg(F.count("*").alias("matched"))
    return top_k(hit, ["query_id", "collection"], [F.desc("matched"), F.desc("created_at"), F.col("file_id")], k).select("query_id", "collection", "file_id", "rank")


def min_max(score: Column, low: Column, high: Column) -> Column:
    return F.when(score.isNull(), None).when(high == low, 1.0).otherwise((score - low) / (high - low))


def hybrid(queries: DataFrame, words: DataFrame, keys: list[str], vectors: DataFrame, alpha: float = 0.5, above: float = 0.55, held: DataFrame | None = None) -> DataFrame:
    """Q6: alpha of the cosine and the rest of BM25, each scaled to [0, 1] within (query, collection); scores over ``above``, which is ``alpha`` at least.

    ``queries`` has query_vector (null: words only), ``words`` the scores by ``bm25``, ``vectors`` the
    tenant, the collection, the keys and embedding; or, with ``held`` (vec_id, embedding), vec_id in its place, so that
    embeddings are not shuffled with the keys.  A side that is missing counts 0.  Rows without words score ``alpha``
    at most, so only rows with words can pass: their cosines are taken one by one, and of all others
    blocks give the least and the greatest (``operators.vectors``).
    """
    if above < alpha:
        raise ValueError("rows without words could pass: use vectors.nearest for them")
    id_keys = ["collection", "user_id", *keys]
    group = ["query_id", "collection"]
    words = words.withColumnRenamed("score", "words")
    # One row for each query and collection; few of them go to every task.
    sent = F.broadcast if queries.count() <= FEW else lambda df: df
    span = words.groupBy(*group).agg(F.min("words").alias("_wl"), F.max("words").alias("_wh"))
    words = words.join(sent(span), group).withColumn("_w", min_max(F.col("words"), F.col("_wl"), F.col("_wh"))).select("query_id", *id_keys, "_w")
    words = words.where((1 - alpha) * F.col("_w") + alpha > above - 1e-6)
    whole = vectors if held is None else vectors.join(held, "vec_id")
    dense = V.score_ranges(queries, V.packs_in_place(whole, ["user_id"], ["collection"]), [], ["user_id"], ["collection"])
    length = lambda v: F.sqrt(dot(v, v))
    measured = lambda df, by: df.where("embedding IS NOT NULL").select(*by, "embedding", length(F.col("embedding")).alias("_dl"))
    q = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector", length(F.col("query_vector")).alias("_ql"))
    like = F.round(dot(F.col("embedding"), F.col("query_vector")) / (F.col("_dl") * F.col("_ql") + F.lit(1e-9)), 6)
    if held is None:
        met = words.join(measured(vectors, id_keys), id_keys, "left")
    else:
        met = words.join(vectors.select(*id_keys, "vec_id"), id_keys, "left").join(measured(held, ["vec_id"]), "vec_id", "left")
    met = met.join(F.broadcast(q) if V.few(queries) else q, "query_id", "left").join(sent(dense), group, "left")
    score = alpha * F.coalesce(min_max(like, F.col("low"), F.col("high")), F.lit(0.0)) + (1 - alpha) * F.col("_w")
    return met.select("query_id", *id_keys, F.round(score, 6).alias("score")).where(F.col("score") > above)


def consolidate(signals: dict[str, DataFrame]) -> DataFrame:
    """All signals in one table; the best rank per (query, file, signal), and the chunk that matched (signals of chunks only)."""
    chunk = lambda s, n: F.col("chunk_index").cast("long") if n.startswith("chunk:") and "chunk_index" in s.columns else F.lit(None).cast("long")
    rows = federate([s.select("query_id", "file_id", "rank", chunk(s, n).alias("matched_chunk"), F.lit(n).alias("signal")) for n, s in signals.items()])
    return rows.groupBy("query_id", "file_id", "signal").agg(F.min("rank").alias("rank"), F.min_by("matched_chunk", "rank").alias("matched_chunk"))


def rrf(ranks: DataFrame) -> DataFrame:
    """Q8, Q10: fused score, the signals that found a file, strongest first, and the chunk that matched, by words if there is one, else by vectors."""
    if "matched_chunk" not in ranks.columns:
        ranks = ranks.withColumn("matched_chunk", F.lit(None).cast("long"))
    pairs = [x for n, v in WEIGHTS.items() for x in (F.lit(n), F.lit(v))]
    weight = F.element_at(F.create_map(*pairs), F.col("signal"))
    place = F.element_at(F.create_map(*[x for i, n in enumerate(WEIGHTS) for x in (F.lit(n), F.lit(i))]), F.col("signal"))
    names = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "signal"))), lambda x: x["signal"])
    chunk = lambda n: F.max(F.when(F.col("signal") == n, F.col("matched_chunk")))
    matched = F.coalesce(*[chunk(n) for n in WEIGHTS if n.startswith("chunk:")])
    return ranks.groupBy("query_id", "file_id").agg(F.sum(weight / (RRF_K + F.col("rank"))).alias("base"), names.alias("matched_in"), matched.alias("matched_chunk"))


def age_days(as_of: Column, at: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 86400)


def boosts(scored: DataFrame, files: DataFrame, access: DataFrame, as_of: Column) -> DataFrame:
    """A little for new files and for files in use; files without a name go (P12).  Collection and type come along where ``files`` has them (Q10)."""
    more = [c for c in ("collection", "filetype") if c in files.columns]
    s = scored.join(files.select("file_id", "filename", "created_at", *more), "file_id").join(access, "file_id", "left").where(F.length("filename") > 0)
    recent = F.when(F.col("created_at").isNull(), 0.0).otherwise(0.08 * F.exp(-age_days(as_of, F.col("created_at")) / 30))
    fresh = F.when(F.col("last_accessed_at").isNull(), 0.5).otherwise(F.exp(-age_days(as_of, F.col("last_accessed_at")) / 14))
    used = F.when(F.coalesce("access_count", F.lit(0)) > 0, 0.12 * F.least(F.lit(1.0), F.log1p("access_count") * fresh / 3)).otherwise(0.0)
    return s.withColumn("score", F.round(F.col("base") * (1 + recent + used), 6))


def top_results(scored: DataFrame, n: int = 30) -> DataFrame:
    """L4."""
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("file_id")], n)


def mmr(results: DataFrame, lam: float = 0.7) -> DataFrame:
    """Q11: ``results`` with ``position``: greedy re-order of each query's results (at most a few dozen rows) by score and unlikeness of names."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        names = [set(x) for x in part["words"]]
        left, like = list(range(len(part))), [0.0] * len(part)
        picked: list[int] = []
        while left:
            if len(part) <= 2 or not picked:
                i = left[0]
            else:
                i = max(left, key=lambda x: (lam * part["score"][x] - (1 - lam) * like[x], -x))
            left.remove(i)
            picked.append(i)
            for x in left:
                if names[x] and names[i]:
                    like[x] = max(like[x], len(names[x] & names[i]) / min(len(names[x]), len(names[i])))
        out = part.loc[picked].drop(columns="words").reset_index(drop=True)
        out["position"] = range(1, len(out) + 1)
        return out

    schema = T.StructType([*results.schema.fields, T.StructField("position", T.IntegerType())])
    return results.withColumn("words", X.filename_tokens(F.col("filename"))).groupBy("query_id").applyInPandas(one, schema)


def search_signals(queries: DataFrame, files: DataFrame, chunks: Index, summaries: Index, bodies: Index, vectors: DataFrame | None = None, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six signals.  The indexes are of chunks (file_id, chunk_index), summaries and bodies (file_id); ``vectors`` are of chunks (``held``: see ``hybrid``), and the queries' query_vector."""
    q = prepare_queries(queries)
    # Several plans read the words' scores, and those of files count twice if summaries and bodies are one index.
    words = settled(bm25(q, chunks))
    ranked = {id(i): rank_files(bm25(q, i).withColumn("chunk_index", F.lit(0)), 20) for i in (summaries, bodies)}
    of_files = lambda index: ranked[id(index)]
    if summaries is bodies:
        ranked[id(bodies)] = settled(ranked[id(bodies)])
    out = {
        "filename:full": sig_filename_full(q, files),
        "filename:tokenized": sig_filename_tokens(q, files),
        "chunk:bm25": rank_files(words, 20),
        "summary:bm25": of_files(summaries),
        "raw_text:bm25": of_files(bodies),
    }
    if vectors is not None:
        out["chunk:hybrid"] = rank_files(hybrid(queries.select("query_id", "user_id", "query_vector"), words, chunks.keys, vectors, held=held), 20)
    return out


def with_passages(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q10: ``results`` with matched_text, the text of the chunk that matched (file_id, chunk_index, text); null if none did."""
    c = chunks.select("file_id", F.col("chunk_index").cast("long").alias("matched_chunk"), F.col("text").alias("matched_text"))
    return results.join(c, ["file_id", "matched_chunk"], "left")


def federated_search(queries: DataFrame, files: DataFrame, chunks: Index, summaries: Index, bodies: Index, access: DataFrame, as_of: Column, vectors: DataFrame | None = None, texts: DataFrame | None = None, n: int = 30, held: DataFrame | None = None) -> DataFrame:
    """Q12, Q10: for each query its best files with score, rank, the file's properties, the signals that found it and the chunk that matched.

    ``texts`` (file_id, chunk_index, text) gives the chunk's text; ``diverse_search`` goes on to Q11's order.
    """
    fused = rrf(consolidate(search_signals(queries, files, chunks, summaries, bodies, vectors, held)))
    found = top_results(boosts(fused, files, access, as_of), n)
    return found if texts is None else with_passages(found, texts)


def diverse_search(*args, **kwargs) -> DataFrame:
    """Q12 to its end: the rows of ``federated_search`` with their ``position`` in the order for diversity."""
    return mmr(federated_search(*args, **kwargs))
