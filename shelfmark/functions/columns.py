"""Column functions of the catalogue: names, kinds, labels, lists and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it, and wherever the planner moves it."""
    return F.transform(F.array(value), body)[0]


def collection_of(filetype: Column) -> Column:
    """The collection that a MIME type belongs to."""
    t = F.lower(filetype)
    return F.when(t.startswith("image/"), "Images").when(t.startswith("audio/") | t.startswith("video/"), "Media").otherwise("Documents")


def topic_of(filetype: Column) -> Column:
    """Media go to the media worker, everything else (images too) to the document worker."""
    t = F.lower(filetype)
    return F.when(t.startswith("audio/") | t.startswith("video/"), "media-topic").otherwise("document-topic")


def norm_filename(name: Column) -> Column:
    """White-space runs become an underscore."""
    return F.regexp_replace(F.trim(name), r"\s+", "_")


def type_label(filetype: Column) -> Column:
    """The first label that fits."""
    t = F.lower(F.coalesce(filetype, F.lit("")))
    out = F.when(t.contains("pdf"), "PDF").when(t.contains("image"), "Image").when(t.contains("video") | t.contains("media"), "Video")
    out = out.when(t.contains("doc"), "Doc").when(t.contains("sheet") | t.contains("excel"), "Sheet")
    return out.when(t == "", "File").otherwise(filetype)


def norm_list(items: Column) -> Column:
    """Lower-case, trimmed, without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def ordered_distinct(items: Column, fold: bool = True) -> Column:
    """Each string once, in order.  With ``fold`` case does not tell strings apart and the first spelling stays."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    if not fold:
        return F.array_distinct(clean)
    low = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def top_entities(index: Column, n: int = 3) -> Column:
    """The first distinct items over entities, ids, topics and dates."""
    parts = [F.coalesce(index[c], F.array().cast("array<string>")) for c in ("entities", "document_ids", "technical_topics", "relevant_dates")]
    return F.slice(ordered_distinct(F.concat(*parts)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length, with a small constant under the line."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def any_of(column: Column, values: Column) -> Column:
    """The array holds one of the values."""
    return F.arrays_overlap(column, values)
