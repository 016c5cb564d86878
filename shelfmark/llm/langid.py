"""Language identification of mixed-language text.

Scripts narrow the candidates: a word is scored only for languages whose
training text uses the word's script.  Each word is scored per language by
hashed character trigrams (naive Bayes, smoothed), then Viterbi over the words,
with a penalty for switching, labels spans.  The language that holds most
letters is the prediction; the score is its share of the letters.

Training counts every trigram of every training row (hash aggregates; the table
has at most ``BUCKETS`` rows per language).  Prediction looks at the text only.

Defined results: a null text or one without letters is ``und`` with score 0.0
and no spans (marks without a letter are no word).  Words of a script that no learned language uses join no span; if
no word has candidates, the most frequent language is given with score 0.0.
Without training rows every text is ``und``.  Ties go to the language first in
alphabetical order.  Texts are whole, of any length.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import batches_of, fold, free_name, table

BUCKETS = 1 << 16
#: Languages beyond this many are an error: the model would not be small.
MAX_LANGS = 500
#: Log-probability lost by a change of language between two words.
SWITCH = 6.0
SMOOTH = 0.5
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.01
PIECE = 1 << 20
#: Characters whose words are labelled together.
GROUP = 1 << 21

# First and last code point of the main blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "indic": [(0x980, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)],
}
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter or the mark (else 0), the number of its script (0: another), and whether it is a letter."""
    if not _TABLES:
        letter = np.zeros(sys.maxunicode + 1, np.uint32)
        alpha = np.zeros(sys.maxunicode + 1, bool)
        # No plane between the third and the fourteenth is assigned.
        for c in (*range(0x40000), *range(0xE0000, 0xF0000)):
            s = chr(c)
            alpha[c] = s.isalpha()
            if alpha[c] or unicodedata.category(s)[0] == "M":
                low = s.lower()
                letter[c] = ord(low) if len(low) == 1 else c
        script = np.zeros(sys.maxunicode + 1, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = k
        _TABLES[:] = [letter, script, alpha]
    return _TABLES[0], _TABLES[1], _TABLES[2]


@dataclass
class Words:
    """The words of several texts: where each begins and ends in its text, its number of letters, script and trigram buckets."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    size: np.ndarray
    script: np.ndarray
    grams: np.ndarray


def split_words(texts: list[str]) -> Words:
    """Runs of letters and marks that hold a letter, with their number of letters; trigrams run over the lower-case word with an edge mark on either side."""
    letter, script, alpha = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    code = letter[points] if len(points) else np.zeros(0, np.uint32)
    inside = code > 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    upto = np.concatenate([[0], np.cumsum(alpha[points])])
    size = upto[ends] - upto[starts]
    if (size == 0).any():
        for a, b in zip(starts[size == 0].tolist(), ends[size == 0].tolist(), strict=True):
            inside[a:b] = False
        starts, ends, size = starts[size > 0], ends[size > 0], size[size > 0]
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.searchsorted(offsets, starts, "right") - 1
    padded = np.concatenate([[0], code, [0]]).astype(np.uint32)
    at = np.flatnonzero(inside)
    # Code 0 before and after a word is its edge mark, as words never touch.
    gram = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    return Words(owner, starts - offsets[owner], ends - offsets[owner], size, script[points[starts]] if len(starts) else np.zeros(0, np.uint8), gram.astype(np.int64))


def pieces(text: str) -> list[str]:
    """The text cut between words into parts of about PIECE code points, so that arrays stay small."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end].isalpha() or unicodedata.category(text[end])[0] == "M"):
            end += 1
        out.append(text[at:end])
        at = end
    return out


def train(docs: DataFrame) -> dict:
    """Learn from (text, lang); null texts and null languages are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part in parts:
            for lang, group in part.groupby("lang"):
                rows[lang] = rows.get(lang, 0) + len(group)
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1, np.int64))
                flat = [p for t in group["text"] for p in pieces(t)]
                for chunk in _chunks(flat):
                    w = split_words(chunk)
                    total += np.bincount(w.grams, minlength=BUCKETS)
                    seen += np.bincount(w.script, weights=w.size, minlength=len(SCRIPTS) + 1).astype(np.int64)
        for lang, total in counts.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "kind": "gram", "k": some, "n": total[some]})
            yield pd.DataFrame({"lang": lang, "kind": "script", "k": np.arange(len(scripts[lang])), "n": scripts[lang]})
            yield pd.DataFrame({"lang": [lang], "kind": ["rows"], "k": [0], "n": [rows[lang]]})

    data = docs.select("text", "lang").where("text is not null and lang is not null")
    sums = data.mapInPandas(run, "lang string, kind string, k long, n long").groupBy("lang", "kind", "k").agg(F.sum("n").alias("n"))
    # Three rows of arrays for each language, of at most BUCKETS counts, however large the corpus.
    got = sums.groupBy("lang", "kind").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n")).limit(3 * MAX_LANGS + 1).toPandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    gram = np.full((len(langs), BUCKETS), SMOOTH)
    script, prior = np.zeros((len(langs), len(SCRIPTS) + 1)), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        for kind, out in (("gram", gram[i]), ("script", script[i])):
            for k, n in zip(own.loc[own["kind"] == kind, "k"], own.loc[own["kind"] == kind, "n"], strict=True):
                out[np.asarray(k)] += np.asarray(n)
        prior[i] = sum(x[0] for x in own.loc[own["kind"] == "rows", "n"])
    logp = np.log(gram / gram.sum(axis=1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
    allowed = script >= SCRIPT_SHARE * np.maximum(1, script.sum(axis=1, keepdims=True))
    return {"langs": langs, "logp": logp.T.copy(), "allowed": allowed.T.copy(), "default": int(prior.argmax()) if langs else -1}


def _chunks(texts: list[str], limit: int = PIECE) -> Iterator[list[str]]:
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > limit:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t) + 1
    if part:
        yield part


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: words of all texts one after another, ``counts`` words each.

    All texts step together, longest first, so a step is a few array operations.
    """
    n_langs = scores.shape[1]
    begin = np.cumsum(counts) - counts
    by_size = np.argsort(-counts, kind="stable")
    begin, counts = begin[by_size], counts[by_size]
    # How many texts have more than t words.
    active = np.searchsorted(-counts, -np.arange(counts.max(initial=0)), "left")
    stay = np.empty(scores.shape, bool)
    jump = np.empty(len(scores), np.uint8 if n_langs < 256 else np.uint16)
    value = np.zeros((len(counts), n_langs), np.float32)
    for t, m in enumerate(active.tolist()):
        rows = begin[:m] + t
        if t == 0:
            value[:m] = scores[rows]
            continue
        v = value[:m]
        best = v.argmax(axis=1)
        top = v[np.arange(m), best][:, None] - np.float32(switch)
        keep = v >= top
        stay[rows], jump[rows] = keep, best
        value[:m] = np.where(keep, v, top) + scores[rows]
    label = np.empty(len(scores), jump.dtype)
    state = value.argmax(axis=1) if len(counts) else np.zeros(0, np.int64)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = begin[:m] + t
        label[rows] = state[:m]
        if t:
            state[:m] = np.where(stay[rows, state[:m]], state[:m], jump[rows])
    return label


SPAN = "array<struct<begin: long, end: long, lang: string>>"


def label_texts(texts: list[str | None], model: dict, spans: bool = True) -> pd.DataFrame:
    """lang_pred, score and spans of each text; without spans, its number of letters and the share of them that has any label."""
    langs, logp, allowed = model["langs"], model["logp"], model["allowed"]
    flat, owner, shift = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for p in pieces(t or ""):
            flat.append(p)
            owner.append(i)
            shift.append(at)
            at += len(p)
    owner_of, shift_of = np.array(owner, np.int64), np.array(shift, np.int64)
    parts, done = [], 0
    letters = np.zeros(len(texts), np.int64)
    for chunk in _chunks(flat):
        w = split_words(chunk)
        text = owner_of[w.text + done] if len(w.text) else w.text
        begin = w.begin + shift_of[w.text + done] if len(w.text) else w.begin
        end = begin + w.end - w.begin
        letters += np.bincount(text, weights=w.size, minlength=len(texts)).astype(np.int64)
        if len(w.text) and langs:
            first = np.cumsum(w.end - w.begin) - (w.end - w.begin)
            s = np.stack([np.add.reduceat(logp[k][w.grams], first) for k in range(len(langs))], axis=1)
            may = allowed[w.script]
            some = may.any(axis=1)
            s = np.where(may, s, np.float32(-1e9))[some]
            parts.append((text[some], begin[some], end[some], w.size[some], s))
        done += len(chunk)
    n = len(texts)
    pred = np.where(letters > 0, langs[model["default"]] if langs else "und", "und").astype(object)
    share, labelled_share = np.zeros(n), np.zeros(n)
    out_spans: list[list] = [[] for _ in range(n)]
    if parts:
        text, begin, end, size, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        label = viterbi(s, np.bincount(text, minlength=n), SWITCH).astype(np.int64)
        mass = np.bincount(text * len(langs) + label, weights=size, minlength=n * len(langs)).reshape(n, len(langs))
        held = mass.sum(axis=1) > 0
        best = mass.argmax(axis=1)
        pred[held] = np.array(langs, object)[best[held]]
        share[held] = mass[held, best[held]] / letters[held]
        labelled_share[held] = mass[held].sum(axis=1) / letters[held]
        if spans:
            new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
            last = np.append(new[1:], len(text)) - 1
            for a, b in zip(new.tolist(), last.tolist(), strict=True):
                out_spans[text[a]].append((int(begin[a]), int(end[b]), langs[label[a]]))
    if spans:
        return pd.DataFrame({"lang_pred": pred, "score": share, "spans": [[{"begin": a, "end": b, "lang": c} for a, b, c in x] for x in out_spans]})
    return pd.DataFrame({"letters": letters, "labelled": labelled_share})


def labelled(docs: DataFrame, model: dict, spans: bool, name: str) -> DataFrame:
    """``docs`` with the struct ``name``; only the text goes to Python, a few million characters at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"lang_pred string, score double, spans {SPAN}" if spans else "letters long, labelled double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.tolist()
            out = [label_texts(texts[a:b], shared.value, spans) for a, b in batches_of([t or "" for t in texts], GROUP)]
            yield pd.concat(out, ignore_index=True) if out else label_texts([], shared.value, spans)

    return docs.withColumn(name, label(F.col("text")))


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and the spans (code points) of its text."""
    name = free_name(docs, "_found")
    return labelled(docs, model, True, name).select(*keep, f"{name}.*")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(3) != 1))
    found = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are rejected: no letters, or no letter in a script of any learned language.

    Spans of several languages, or of other scripts beside them, are no ground to reject.  Where no
    language could be learned, every text that has letters stays.
    """
    model = train(docs)
    name = free_name(docs, "_found")
    return labelled(docs, model, False, name).where(f"{name}.labelled > 0" if model["langs"] else f"{name}.letters > 0").drop(name)
