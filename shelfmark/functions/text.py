"""Text functions: each is one column expression, so it runs inside code generation over any number of rows.

Word edges are written out as look-arounds over ASCII letters, digits and the
underscore, because the edge of the regular-expression engine knows more letters.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import bind

W = "[A-Za-z0-9_]"
B = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Words that are no keywords.
STOP_WORDS = (
    "i me my mine we our ours a an the is are was were be been being have has had do does did for of to from with in on at by about and or but if as "
    "this that these those find show get search looking want need remember stored saved uploaded file files where which"
).split()
# Abbreviations that don't end a sentence.
ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof Sr Jr Hon Inc Ltd Co Corp Llc Plc vs etc ie eg Eg Ie Etc Vs U.S U.K U.S.A E.U St Ave Blvd Mt Ft No Vol Op Cit Ed "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
).split()
# Phrases that ask for figures.
TABLE_WORDS = ["total", "sum", "count", "how many", "how much", "number of", "list of", "column", "row", "highest", "lowest", "average", "mean", "median", "breakdown", "table", "figures?"]
# Short phrases that need no search.
SMALL_TALK = {
    "thanks": ["thanks", "thank you", "thx", "ty"],
    "assent": ["ok", "okay", "k", "got it", "great", "cool", "nice", "perfect", "awesome", "yep"],
    "answer": ["yes", "no", "nope"],
    "greeting": ["hi", "hello", "hey", "good morning", "good afternoon", "good evening"],
    "farewell": ["bye", "goodbye", "good night"],
}
# First and last code points by language, in order of precedence.
SCRIPTS = [("he", r"\x{0590}-\x{05FF}"), ("ar", r"\x{0600}-\x{06FF}"), ("zh", r"\x{4E00}-\x{9FFF}"), ("ja", r"\x{3040}-\x{309F}"), ("ko", r"\x{AC00}-\x{D7AF}"), ("hi", r"\x{0900}-\x{097F}"), ("ru", r"\x{0400}-\x{04FF}")]
# Phrases of legal and of financial documents.
LEGAL = ["hereby agree", "whereas", "this agreement", "parties hereto", "governing law", "in witness whereof"]
FINANCIAL = ["revenue", "earnings", "fiscal", "quarter", "ebitda", "gross margin", "$"]
# Parts of messages of failures that last, and of those that pass.
PERMANENT = ["400", "401", "403", "404", "invalid argument", "invalid_argument", "permission denied", "permission_denied", "unauthenticated", "not found"]
RETRYABLE = [
    "429", "500", "502", "503", "504", "rate limit", "rate-limit", "resource exhausted", "resource_exhausted", "deadline exceeded", "deadline_exceeded",
    "timeout", "timed out", "internal error", "internal_error", "unavailable", "service unavailable", "connection reset", "connection refused",
]


def either(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def keywords(text: Column) -> Column:
    """Words of three letters or more that are no stop words, each once, in order."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def keyword_query(text: Column) -> Column:
    """Q1: the keywords, or the query itself if it has none."""
    k = keywords(text)
    return F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(text)


def token_count(text: Column) -> Column:
    """A quarter of the characters, one at least; none for no text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def truncate_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def language_tag(text: Column) -> Column:
    """By script in the first 500 characters, else by the share of non-ASCII in the first 2000."""
    out = F.lit(None).cast("string")
    head = F.substring(text, 1, 500)
    wide = F.substring(text, 1, 2000)
    out = F.when(F.length(F.regexp_replace(wide, r"[\x{0000}-\x{007F}]", "")) > 0.1 * F.length(wide), "non-en").otherwise("en")
    for tag, span in reversed(SCRIPTS):
        out = F.when(head.rlike(f"[{span}]"), tag).otherwise(out)
    return out


#: The start of a text that holds its first 200 words.
FIRST_WORDS = r"^\s*+(?:\S++\s*+){0,200}+"


def quality_gate(text: Column) -> Column:
    """T4: struct(bad, reason).  The text and its words are bound, so that each is computed once and no more is cut into words than counts."""

    def judge(t: Column, words: Column) -> Column:
        symbols = bind(F.substring(t, 1, 5000), lambda head: F.length(F.regexp_replace(head, r"[a-zA-Z0-9\s]+", "")) / F.length(head))
        unique = F.size(F.array_distinct(words)) / F.size(words)
        reason = F.when(F.length(t) == 0, "empty").when(F.length(t) < 50, "too_short").when(symbols > 0.4, "high_symbol_ratio")
        return reason.when((F.size(words) >= 30) & (unique < 0.15), "low_unique_ratio")

    words = lambda t: F.regexp_extract_all(F.lower(F.regexp_extract(t, FIRST_WORDS, 0)), F.lit(r"\S+"), 0)
    reason = bind(F.coalesce(text, F.lit("")), lambda t: bind(words(t), lambda w: judge(t, w)))
    return bind(reason, lambda r: F.struct(r.isNotNull().alias("bad"), r.alias("reason")))


def doc_type(text: Column) -> Column:
    """T5."""
    t = F.lower(F.substring(text, 1, 2000))
    hits = lambda words: functools.reduce(operator.add, [F.contains(t, F.lit(w)).cast("int") for w in words])
    code = functools.reduce(operator.or_, [F.regexp_count(t, F.lit(w)) >= 3 for w in ("```", "function ", "def ")])
    return F.when(code, "code").when(hits(LEGAL) >= 2, "legal").when(hits(FINANCIAL) >= 3, "financial").otherwise("generic")


def luhn_ok(number: Column) -> Column:
    """T7."""
    digits = F.regexp_replace(number, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, r"\D", "")).between(10, 15)


def _public_ip(m: Column) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    a, b = part(1), part(2)
    inside = functools.reduce(operator.and_, [part(i) <= 255 for i in (1, 2, 3, 4)])
    return inside & ~(a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)))


# The rules in their order: kind, what a match becomes, its pattern, a test of each match, and what a text must hold at least.
REDACTION = [
    ("EMAIL", "[REDACTED:EMAIL]", B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + B, None, "@"),
    ("SSN", "[REDACTED:SSN]", B + r"(?!000|666|9\d\d)\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}" + B, None, r"\d{4}"),
    ("CREDIT_CARD", "[REDACTED:CREDIT_CARD]", B + r"(?:\d[ -]*?){13,19}" + B, luhn_ok, r"\d[ -]*\d[ -]*\d[ -]*\d"),
    ("PHONE", "[REDACTED:PHONE]", r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){1,3}\d{3,4}[\s.-]?\d{3,4}" + B, _phone, r"\d{3}"),
    ("API_KEY", "[REDACTED:API_KEY]", B + r"sk-[A-Za-z0-9_-]{20,}" + B, None, "sk-"),
    ("API_KEY", "[REDACTED:AWS_ACCESS_KEY]", B + r"AKIA[0-9A-Z]{16}" + B, None, "AKIA"),
    ("API_KEY", "[REDACTED:GITHUB_TOKEN]", B + r"gh[pousr]_[A-Za-z0-9]{36,}" + B, None, "gh[pousr]_"),
    ("API_KEY", "[REDACTED:SLACK_TOKEN]", B + r"xox[abps]-[A-Za-z0-9-]{10,}" + B, None, "xox"),
    ("JWT", "[REDACTED:JWT]", B + r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+" + B, None, "eyJ"),
    ("IPV4", "[REDACTED:IP]", B + r"(?:\d{1,3}\.){3}\d{1,3}" + B, _public_ip, r"\d\.\d"),
]


def _apply_rule(state: Column, token: str, pattern: str, test, least: str) -> Column:
    """One rule on struct(text, n): the text split at its matches, the matches tested, and the parts joined again."""

    def with_text(v: Column) -> Column:
        text, n = v["text"], v["n"]

        def with_hits(hits: Column) -> Column:
            good = F.filter(hits, lambda m: test(m)) if test else hits
            swap = F.transform(hits, lambda m: F.when(test(m), F.lit(token)).otherwise(m) if test else F.lit(token))
            parts = F.split(text, pattern, -1)
            joined = F.array_join(F.zip_with(parts, swap, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
            return F.struct(F.when(F.size(good) > 0, joined).otherwise(text).alias("text"), F.concat(n, F.array(F.size(good))).alias("n"))

        # Most texts hold none of it: the rule's own pattern is tried on the others only.
        none = F.struct(text.alias("text"), F.concat(n, F.array(F.lit(0))).alias("n"))
        return F.when(text.rlike(least), bind(F.regexp_extract_all(text, F.lit(pattern), 0), with_hits)).otherwise(none)

    return bind(state, with_text)


def redact(df: DataFrame, col: str = "text") -> DataFrame:
    """Add ``redacted`` and ``counts`` (kind to number of matches); ``col`` stays.

    The rules form one expression whose steps are bound to lambda variables, so it
    grows with the number of rules and nothing leaves the engine.
    """
    state = F.struct(F.coalesce(F.col(col), F.lit("")).alias("text"), F.array().cast("array<int>").alias("n"))
    for _, token, pattern, test, least in REDACTION:
        state = _apply_rule(state, token, pattern, test, least)
    kinds = list(dict.fromkeys(k for k, *_ in REDACTION))
    sums = [functools.reduce(operator.add, [F.col("_redaction.n")[i] for i, (x, *_) in enumerate(REDACTION) if x == k]) for k in kinds]
    counts = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*sums))
    df = df.withColumn("_redaction", state)
    return df.withColumns({"redacted": F.col("_redaction.text"), "counts": F.map_filter(counts, lambda _, n: n > 0)}).drop("_redaction")


# Where a sentence may end, and what stands at the end of a part that goes on.
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z(\"'])"
SENTENCE_OPEN = rf"(?:^|\s)(?:{either(ABBREVIATIONS)}|[A-Z]|\$?\d+)\.?\s*$"
#: Two control characters that no text holds together.
SENTENCE_END = "\x01\x02"


def sentences(text: Column) -> Column:
    """Split after ``.!?`` before a capital, a quote or a parenthesis; not after abbreviations, initials and bare numbers."""
    parts = F.split(text, SENTENCE_BREAK)
    # Whether two parts belong together depends on the end of the first alone: mark the true ends and split there.
    marked = F.transform(parts, lambda p: F.concat(p, F.when(p.rlike(SENTENCE_OPEN), " ").otherwise(SENTENCE_END)))
    joined = F.regexp_replace(F.array_join(marked, ""), rf"(?:{SENTENCE_END}|\s)+$", "")
    return F.when(F.length(F.trim(text)) > 0, F.split(joined, SENTENCE_END)).otherwise(F.array().cast("array<string>"))


# Forms of dates in queries, in order.
DATE_RULES = [
    r"(?:20\d{2}|19\d{2})[-/.]\d{1,2}[-/.]\d{1,2}",
    r"(?:19|20)\d{2}",
    r"q[1-4][\s\-/]?(?:19|20)\d{2}",
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+(?:19|20)\d{2}",
    r"fy\s?\d{2,4}",
]


def query_dates(text: Column) -> Column:
    """Dates named in a query, in the order of the rules, each once."""
    low = F.lower(text)
    # Each form begins and ends with a word character, so these are its boundaries; whether it can begin here is looked at first.
    whole = lambda r: rf"(?=[0-9a-z])(?<!{W})(?:{r})(?!{W})"
    return F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(whole(r)), 0) for r in DATE_RULES]))


# Forms of document ids in queries.
ID_AFTER_WORD = r"(?i:invoice|po|ticket|contract|order|ref|case)[\s#-]+([A-Za-z0-9\-]{2,})"
ID_PLAIN = r"([A-Z]{2,}-\d+(?:-[A-Za-z0-9]+)*)"


def query_doc_ids(text: Column) -> Column:
    """Ids after a word like invoice, and upper-case ids with a hyphen."""
    both = F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?=[A-Za-z])(?<!{W})" + r + B), 1) for r in (ID_AFTER_WORD, ID_PLAIN)])
    return F.array_distinct(F.transform(both, lambda x: F.lower(x)))


def extraction_confidence(*lists: Column) -> Column:
    """T12."""
    return F.least(F.lit(0.95), F.lit(0.3) + F.lit(0.2) * functools.reduce(operator.add, [F.size(x) for x in lists]))


def needs_model(text: Column) -> Column:
    """Long enough, three words or more, and one with a capital."""
    return (F.length(text) >= 8) & (F.size(F.split(F.trim(text), r"\s+")) >= 3) & text.rlike("[A-Z][a-z]")


def table_intent(text: Column) -> Column:
    """T15."""
    return F.lower(text).rlike(B + f"(?:{'|'.join(TABLE_WORDS)})" + B)


def small_talk_kind(text: Column) -> Column:
    """The kind of a short phrase that is only small talk, else null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z ]+", " "), r"\s+", " "))
    out = F.lit(None).cast("string")
    for kind, phrases in SMALL_TALK.items():
        out = F.when((F.length(F.trim(text)) <= 30) & plain.isin(*phrases), kind).otherwise(out)
    return out


def filename_tokens(name: Column) -> Column:
    """T17."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[\s_.\-]+"), lambda w: F.length(w) > 1))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared members over the size of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def summary_gate(overview: Column, insights: Column) -> Column:
    """The reason to reject a summary, else null."""

    def judge(o: Column, found: Column) -> Column:
        useful = F.exists(found, lambda x: F.length(F.trim(x)) >= 10)
        return F.when(o == "", "empty").when(F.length(o) < 30, "too_short").when(o.endswith("?") & (F.length(o) < 80), "question").when(F.size(found) == 0, "no_insights").when(~useful, "short_insights")

    # Bound: both are named several times.
    return bind(F.trim(F.coalesce(overview, F.lit(""))), lambda o: bind(insights, lambda found: judge(o, found)))


def format_summary(overview: Column, insights: Column) -> Column:
    """T21."""
    return F.concat(overview, F.lit("\n\n"), F.array_join(F.transform(insights, lambda x: F.concat(F.lit("- "), x)), "\n"))


def retry_triage(message: Column) -> Column:
    """Permanent causes first, then known passing ones; retry by default."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike(either(PERMANENT)), "permanent").when(m.rlike(either(RETRYABLE)), "retryable").otherwise("retryable")
