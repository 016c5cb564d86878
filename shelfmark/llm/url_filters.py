"""URL filters: a blocked Bloom filter in front of an exact hash join.

A *rule* is a listed canonical URL prefix ``host/path``.  It fits a URL when
the URL's host is the rule's host or a subdomain of it and the URL's path
starts with the rule's path.  Every URL is expanded into the (host suffix, path
prefix) expressions whose shape occurs in the list; the filter drops nearly all
of them, and the hash join on the expression removes the filter's false
positives.  The longest fitting rule wins (ties: longer host, then text).

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits nothing; a URL with an empty host has its path, fits nothing and is not
listed.  Rules may be of any length.  Empty tables give empty results.  Repeated URLs are judged
once and joined back.  Extra columns of ``pages`` are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, small, table

#: The list that the query judges by: (action, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
WORDS = 8
LANE_BITS = 6
#: A filter of up to so many 512-bit blocks (4 MB) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 16


def url_host(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _probe(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Add the filter block of ``key`` and its bit in each of the block's words."""
    df = df.withColumn("_h", F.xxhash64(key)).withColumn("_g", F.xxhash64(F.lit(97), key))
    df = df.withColumn("_block", F.pmod("_h", F.lit(n_blocks)).cast("int"))
    lane = (1 << LANE_BITS) - 1
    for i in range(WORDS):
        at = F.shiftrightunsigned("_g", LANE_BITS * i).bitwiseAND(F.lit(lane)).cast("int")
        df = df.withColumn(f"_b{i}", F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return df.drop("_h", "_g")


def build_filter(listed: DataFrame, key: str, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``listed[key]`` as rows (block, eight 64-bit words); it grows with the list."""
    n = max(1, listed.count())
    n_blocks = max(1, math.ceil(n * bits_per_key / (64 * WORDS)))
    words = [F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(WORDS)]
    return _probe(listed.select(key), key, n_blocks).groupBy("_block").agg(*words), n_blocks


def possible_hits(candidates: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Candidates all of whose bits are set in their block of the filter."""
    probed = _probe(candidates, key, n_blocks)
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"_b{i}").bitwiseAND(F.col(f"_w{i}")) != 0)
    kept = probed.join(F.broadcast(bloom) if n_blocks <= BROADCAST_BLOCKS else bloom, "_block").where(hit)
    return kept.drop("_block", *[f"_b{i}" for i in range(WORDS)], *[f"_w{i}" for i in range(WORDS)])


def judge_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """One row per distinct URL with ``host, path, rule, verdict, listed``.

    ``rules``: columns action, host, path.  ``listed``: column ``canonical``
    (host followed by path); a URL that no rule fits is blocked if its canonical
    form is listed, else allowed.
    """
    labels = lambda host: F.size(F.split(host, "[.]"))
    exact = rules.where("length(host) > 0").select(F.concat("host", "path").alias("rule"), "action", F.concat_ws(" ", "host", "path").alias("_key"), F.length("host").alias("_hl"), labels("host").alias("_labels"), F.length("path").alias("_pl"))
    exact = cut(exact)
    # Which lengths of path the list has for each number of labels; a URL is expanded to those that it can hold.
    shapes = cut(exact.groupBy("_labels").agg(F.collect_set("_pl").alias("_pls")))
    base = urls.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    base = base.withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url")))
    hosted = base.where("host != ''")
    wide = hosted.withColumn("_labels", F.explode(F.sequence(F.lit(1), labels("host")))).join(small(shapes, 1000), "_labels")
    wide = wide.withColumn("_pl", F.explode(F.filter("_pls", lambda p: p <= F.length("path"))))
    suffix = F.array_join(F.slice(F.split("host", "[.]"), -F.col("_labels"), F.col("_labels")), ".")
    candidates = wide.select("_url", F.concat_ws(" ", suffix, F.col("path").substr(F.lit(1), F.col("_pl"))).alias("_key"))
    bloom, n_blocks = build_filter(exact, "_key")
    hits = possible_hits(candidates, "_key", bloom, n_blocks)
    ruled = hits.join(small(exact, 100_000), "_key")
    order = F.struct(F.length("rule"), F.col("_hl"), F.col("rule"))
    best = ruled.groupBy("_url").agg(F.max_by(F.struct("rule", "action"), order).alias("_best"))
    out = base.join(best, "_url", "left")
    if listed is None:
        out = out.withColumn("listed", F.lit(False))
    else:
        names = cut(listed.select(F.col("canonical").alias("_canon")).where("_canon is not null").distinct())
        bloom2, blocks2 = build_filter(names, "_canon")
        mine = hosted.select(F.concat("host", "path").alias("_canon")).distinct()
        found = possible_hits(mine, "_canon", bloom2, blocks2).join(names, "_canon", "left_semi").withColumn("listed", F.lit(True))
        out = out.withColumn("_canon", F.when(F.col("host") != "", F.concat("host", "path"))).join(found, "_canon", "left").drop("_canon")
    out = out.withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce(F.col("_best.action"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("_url").alias(url), "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "listed")


def filter_pages(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and listed; one row per row of ``pages``."""
    judged = judge_urls(pages, rules, listed)
    rows = pages.select("page_id", "url")
    known = F.coalesce(F.col("verdict"), F.lit("allow")).alias("verdict")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")]
    return rows.join(judged, "url", "left").select("page_id", *empty, "rule", known, F.coalesce("listed", F.lit(False)).alias("listed"))


def recrawled(pages: DataFrame) -> DataFrame:
    """Canonical URLs that more than one fetched address leads to: the block list that the data themselves give."""
    forms = pages.select("url").where("url is not null").distinct().select(F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("canonical"))
    return forms.where("canonical != ''").groupBy("canonical").count().where("count > 1").select("canonical")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_pages(pages, rules, recrawled(pages))


OP1_SQL = r"""
WITH rules(action, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
p AS (SELECT row_number() OVER () AS rid, page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (SELECT host || path AS c FROM (SELECT DISTINCT url, host, path FROM p WHERE url IS NOT NULL) WHERE host || path <> '' GROUP BY 1 HAVING count(*) > 1),
fit AS (SELECT rid, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rhost || rpath DESC) AS rn
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN c IS NOT NULL AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict, c IS NOT NULL AND host <> '' AS listed
FROM p LEFT JOIN fit ON p.rid = fit.rid AND rn = 1 LEFT JOIN canon ON host || path = c
"""
