"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end mark per text.  The model's *items* are the
most frequent words (``HEAD`` at most), ``BUCKETS`` hash buckets of all other words, and
the end mark.  Items are put into classes of ``GROUP``, by frequency.  After items c1
(before it) and c2 (before that), with h = r[c1] M1 + r[c2] M2, an item w of class k has

    log P = log softmax(h q + bq)[k] + log softmax over the class (h r + b)[w]

so a token costs as many products as there are classes and items in one class, and the
probabilities of all items sum to one.  Inside a bucket a word has its share by
smoothed counts, and one share is left for words never seen.

1. Counts of all training words are summed on Spark (per batch, then by hash
   aggregate); words are identified by 64-bit hashes.  The least count of a head word is
   found by counting words above bounds, so only head words come to the driver.
2. Training texts are dealt by hash into shards of about ``SHARD_TOKENS`` tokens, so
   parameters don't depend on files or partitions.  Each shard runs one pass of
   noise-contrastive estimation (of classes, with noise classes shared by a step, and of
   words in their class, with noise words of that class), starting from the
   frequencies; parameters are averaged by tokens, in a tree.
3. Tokens are scored by batched matrix products.
4. Counts of the ``KNOWN`` most frequent words go to the tasks; other words
   (a small share of tokens) are joined with the count table.

Defined results: a null text is empty and has one token, the end.  Without
training texts both scores are 0.0.  Repeated rows, and rows that share or lack a
doc_id, are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import HashIndex, batches_of, cut, fold, free_name, table, word_hashes

DIM = 16
#: Words with a vector of their own, buckets of the others, and items of a class.
HEAD, BUCKETS, GROUP = 1 << 14, 1 << 12, 128
#: Noise classes of a step, noise words of a class, tokens of a step, and the step size of the adaptive gradient.
NOISE, NOISE_WORDS, STEP, RATE = 24, 3, 16384, 0.05
SHARD_TOKENS = 1 << 22
KNOWN = 1 << 18
#: Words whose counts a task holds before it passes them on.
MERGE = 1 << 20
SEED = 20240311


def _texts(part: pd.DataFrame, column: str = "text") -> list[bytes]:
    return [b"" if t is None else bytes(t) for t in part[column]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(text) -> (word, c): the 64-bit hash of each word, and its count over all texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in parts:
            texts = _texts(part)
            for begin, end in batches_of(texts, 1 << 21):
                held.append(np.unique(word_hashes(texts[begin:end])[0], return_counts=True))
                size += len(held[-1][0])
                if size > MERGE:
                    words, c = _merge(held)
                    if len(words) > MERGE // 2:
                        yield pd.DataFrame({"word": words.view(np.int64), "c": c})
                        held, size = [], 0
                    else:
                        held, size = [(words, c)], len(words)
        if held:
            words, c = _merge(held)
            yield pd.DataFrame({"word": words.view(np.int64), "c": c})

    rows = docs.select(F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least c such that at most ``most`` words occur c times or more: found in steps that halve, or better, an interval."""
    low, high = 0, (counts.agg(F.max("c")).first()[0] or 0) + 1
    # At ``low`` there are too many words (or it is 0), at ``high`` there are not.
    while high - low > 1:
        bounds = sorted({low + max(1, int((high - low) * 2.0 ** (i / 2 - 32))) for i in range(64)})
        above = counts.agg(*[F.count_if(F.col("c") >= b) for b in bounds]).first()
        fits = [b for b, n in zip(bounds, above, strict=True) if n <= most]
        high = min([high, *fits])
        low = max([low, *[b for b in bounds if b < high]])
    return high


class Vocabulary:
    """Totals of the training tokens, the counts of frequent words, and the items with their classes."""

    def __init__(self, counts: DataFrame, n_texts: int) -> None:
        totals = counts.agg(F.count("*"), F.sum("c")).first()
        self.texts = n_texts
        self.types = (totals[0] or 0) + (n_texts > 0)
        self.tokens = (totals[1] or 0) + n_texts
        known = counts.where(F.col("c") >= least_count(counts, KNOWN)).toPandas()
        words, c = known["word"].to_numpy(np.int64).view(np.uint64), known["c"].to_numpy(np.int64)
        order = np.argsort(words)
        self.words, self.counts = words[order], c[order]
        rare_below = least_count(counts, HEAD)
        head = np.flatnonzero(self.counts >= rare_below)
        head = head[np.lexsort((self.words[head], -self.counts[head]))]
        rest = counts.where(F.col("c") < rare_below).groupBy(F.pmod("word", F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
        in_bucket, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
        in_bucket[rest["b"]], types[rest["b"]] = rest["c"], rest["n"]
        #: Smoothed total of each bucket, with a share for words never seen.
        self.bucket_mass = in_bucket + 0.1 * (types + 1)
        raw = np.concatenate([self.counts[head], [n_texts], in_bucket])
        rank = np.empty(len(raw), np.int32)
        rank[np.argsort(-raw, kind="stable")] = np.arange(len(raw))
        #: The item of each known word, or -1 if it is in a bucket; of the end; and of each bucket.
        self.item = np.full(len(self.words), -1, np.int32)
        self.item[head] = rank[: len(head)]
        self.end, self.bucket_item = int(rank[len(head)]), rank[len(head) + 1 :]
        self.n_items = len(raw)
        freq = np.empty(len(raw))
        freq[rank] = raw
        freq += 0.1
        self.frequency = freq / freq.sum()
        self.index = HashIndex(self.words)

    @property
    def mass(self) -> float:
        return self.tokens + 0.1 * (self.types + 1)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return np.mod(hashes.view(np.int64), BUCKETS)


def items_of(vocab: Vocabulary, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of all tokens, ends included, and of the two tokens before each; the places of the words, and whether each is in a bucket."""
    at = vocab.index.find(hashes)
    own = np.where(at >= 0, vocab.item[at], -1) if len(vocab.item) else np.full(len(at), -1)
    rare = own < 0
    own[rare] = vocab.bucket_item[buckets_of(hashes[rare])]
    ends = np.cumsum(counts + 1) - 1
    total = len(hashes) + len(counts)
    w = np.full(total, vocab.end, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    w[inside] = own
    c1 = np.concatenate([[vocab.end], w[:-1]])[:total]
    c2 = np.concatenate([[vocab.end, vocab.end], w[:-2]])[:total]
    starts = ends - counts
    c2[starts] = vocab.end
    c2[starts[counts > 0] + 1] = vocab.end
    return w, c1, c2, at, rare


def start(vocab: Vocabulary) -> list[np.ndarray]:
    """r, M1, M2, b of the items; q and bq of the classes: the frequencies, but for small random vectors."""
    rng = np.random.default_rng(SEED)
    begins = np.arange(0, vocab.n_items, GROUP)
    of_class = np.add.reduceat(vocab.frequency, begins)
    inside = vocab.frequency / of_class[np.arange(vocab.n_items) // GROUP]
    r = rng.normal(0, 0.3, (vocab.n_items, DIM))
    c = [rng.normal(0, 0.1, (DIM, DIM)) for _ in range(2)]
    q = rng.normal(0, 0.3, (len(begins), DIM))
    return [x.astype(np.float32) for x in (r, *c, np.log(inside), q, np.log(of_class))]


def _sum_rows(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    flat = (ids[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, rows.ravel(), n * DIM).reshape(n, DIM).astype(np.float32)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Noise:
    """Classes by their frequency, and items of each class by theirs."""

    def __init__(self, vocab: Vocabulary) -> None:
        begins = np.arange(0, vocab.n_items, GROUP)
        self.classes = np.add.reduceat(vocab.frequency, begins)
        self.log_class = np.log(NOISE * self.classes).astype(np.float32)
        self.log_item = np.log(NOISE_WORDS * vocab.frequency / self.classes[np.arange(vocab.n_items) // GROUP]).astype(np.float32)
        self.upto = np.cumsum(vocab.frequency)
        self.class_end = np.cumsum(self.classes)

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """NOISE classes, and NOISE_WORDS items of every class."""
        k = len(self.classes)
        classes = np.minimum(np.searchsorted(self.class_end, rng.random(NOISE) * self.class_end[-1]), k - 1)
        u = (self.class_end - self.classes)[:, None] + rng.random((k, NOISE_WORDS)) * self.classes[:, None]
        items = np.searchsorted(self.upto, u)
        first = np.arange(k)[:, None] * GROUP
        return classes, np.clip(items, first, np.minimum(first + GROUP, len(self.upto)) - 1)


def nce_step(params: list[np.ndarray], state: list[np.ndarray], noise: Noise, rng: np.random.Generator, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
    """One gradient step over some tokens: of their classes, and of the words in them."""
    r, m1, m2, b, q, bq = params
    n_items, n_classes = len(r), len(q)
    order = np.argsort((w // GROUP).astype(np.int16), kind="stable")
    w, c1, c2 = w[order], c1[order], c2[order]
    k = w // GROUP
    # Tokens of one class are neighbours: ``some`` are the classes, ``at`` where they begin.
    at = np.flatnonzero(np.diff(k, prepend=-1))
    some = k[at]
    weight = np.float32(1 / len(w))
    nk, nw = noise.draw(rng)
    x1, x2, t, qk = r[c1], r[c2], r[w], q[k]
    h = x1 @ m1 + x2 @ m2
    up_k = (1 - _sigmoid((h * qk).sum(axis=1) + bq[k] - noise.log_class[k])) * weight
    down_k = -_sigmoid(h @ q[nk].T + bq[nk] - noise.log_class[nk]) * weight
    up_w = (1 - _sigmoid((h * t).sum(axis=1) + b[w] - noise.log_item[w])) * weight
    dh = up_k[:, None] * qk + down_k @ q[nk] + up_w[:, None] * t
    uses, gains, bias = [w, c1, c2], [up_w[:, None] * h], np.bincount(w, up_w, n_items)
    for own in nw.T:
        # One noise word of each class, met by all tokens of the class.
        rn = r[own][k]
        down = -_sigmoid((h * rn).sum(axis=1) + (b[own] - noise.log_item[own])[k]) * weight
        dh += down[:, None] * rn
        uses.append(own[some])
        gains.append(np.add.reduceat(down[:, None] * h, at))
        bias += np.bincount(own[some], np.add.reduceat(down, at), n_items)
    dr = _sum_rows(np.concatenate(uses), np.concatenate([gains[0], dh @ m1.T, dh @ m2.T, *gains[1:]]), n_items)
    db = bias.astype(np.float32)
    dq, dbq = np.zeros_like(q), np.zeros_like(bq)
    dq[some], dbq[some] = np.add.reduceat(up_k[:, None] * h, at), np.add.reduceat(up_k, at)
    np.add.at(dq, nk, down_k.T @ h)
    np.add.at(dbq, nk, down_k.sum(axis=0))
    for p, g, s in zip(params, (dr, x1.T @ dh, x2.T @ dh, db, dq, dbq), state, strict=True):
        s += g * g
        p += RATE * g / np.sqrt(s + 1e-8)


def train(docs: DataFrame, vocab: Vocabulary) -> list[np.ndarray]:
    """The parameters, from one pass over all texts of ``docs`` (doc_id, text); each shard's share counts by its tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    shapes = [p.shape for p in start(vocab)]
    n_shards = max(1, -(-vocab.tokens // SHARD_TOKENS))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        noise = Noise(vocab)
        shard, total = None, 0

        def done() -> pd.DataFrame:
            flat = np.concatenate([p.ravel() for p in params])
            return pd.DataFrame({"at": [shard], "tokens": [total], "params": [(flat * np.float32(total / vocab.tokens)).tobytes()]})

        for part in parts:
            ids = part["at"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if ids[a] != shard:
                    if total:
                        yield done()
                    shard, total = int(ids[a]), 0
                    params, rng = start(vocab), np.random.default_rng([SEED, shard])
                    state = [np.full(p.shape, 1e-6, np.float32) for p in params]
                texts = _texts(part.iloc[a:z])
                for begin, end in batches_of(texts):
                    w, c1, c2, _, _ = items_of(vocab, *word_hashes(texts[begin:end]))
                    total += len(w)
                    for i in range(0, len(w), STEP):
                        nce_step(params, state, noise, rng, w[i : i + STEP], c1[i : i + STEP], c2[i : i + STEP])
        if total:
            yield done()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        total = np.zeros(sum(int(np.prod(s)) for s in shapes), np.float32)
        for x in part["params"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"at": [int(part["at"].iloc[0])], "tokens": [int(part["tokens"].sum())], "params": [total.tobytes()]})

    # Where a text goes, and after which others it is read, follow from the text itself.
    place = F.xxhash64("text", "doc_id")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).select(F.pmod(place, F.lit(n_shards)).alias("at"), place.alias("place"), "text")
    rows = rows.repartition(n_shards, "at").sortWithinPartitions("at", "place").select("at", "text")
    kind = "at long, tokens long, params binary"
    got = rows.mapInPandas(run, kind)
    # Sums of neighbours, in a tree; one row comes to the driver.
    width = n_shards
    while True:
        got = got.withColumn("at", F.floor(F.col("at") / 16)).groupBy("at").applyInPandas(add, kind)
        width = -(-width // 16)
        if width <= 1:
            break
    rows = got.collect()
    if not rows:
        return start(vocab)
    flat = np.frombuffer(rows[0].params, np.float32)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s).copy() for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


class Scorer:
    """Normalised log-probabilities (base e) of items in their contexts."""

    def __init__(self, params: list[np.ndarray]) -> None:
        r, m1, m2, self.b, self.q, self.bq = params
        self.r, self.a1, self.a2 = r, r @ m1, r @ m2

    def __call__(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray, step: int = 8192) -> np.ndarray:
        order = np.argsort(w // GROUP, kind="stable")
        w, c1, c2 = w[order], c1[order], c2[order]
        out = np.empty(len(w), np.float32)
        for i in range(0, len(w), step):
            x, h = w[i : i + step], self.a1[c1[i : i + step]] + self.a2[c2[i : i + step]]
            k = x // GROUP
            s = h @ self.q.T + self.bq
            logp = s[np.arange(len(x)), k] - _log_sum(s)
            cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                first = int(k[a]) * GROUP
                s = h[a:z] @ self.r[first : first + GROUP].T + self.b[first : first + GROUP]
                logp[a:z] += s[np.arange(z - a), x[a:z] - first] - _log_sum(s)
            out[i : i + step] = logp
        back = np.empty_like(out)
        back[order] = out
        return back


def _log_sum(s: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the exponentials of each row."""
    if s.max(initial=0) < 60:
        total = np.exp(s) @ np.ones(s.shape[1], s.dtype)
        if total.min(initial=1) > 1e-20:
            return np.log(total)
    top = s.max(axis=1, keepdims=True)
    return np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]


def fit(training: DataFrame) -> tuple[DataFrame, Vocabulary, list[np.ndarray]]:
    """Counts of all words, the vocabulary and the parameters, from (doc_id, text)."""
    counts = cut(count_words(training))
    vocab = Vocabulary(counts, training.count())
    return counts, vocab, train(training, vocab)


def score(docs: DataFrame, model: tuple[DataFrame, Vocabulary, list[np.ndarray]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, n_known, train_tokens, base_score and score of its text.

    A column of ours whose name a kept one has takes the next free name (``score_``).
    """
    counts, vocab, params = model
    shared = docs.sparkSession.sparkContext.broadcast((vocab, params))
    # Kept columns go by number until the end.
    kept = docs.select(*keep)
    held = [f"_{i}" for i in range(len(keep))]
    fields = ", ".join(f"`{h}` {f.dataType.simpleString()}" for h, f in zip(held, kept.schema.fields, strict=True))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, scorer = shared.value[0], Scorer(shared.value[1])
        weight, share = np.log10(vocab.counts + 0.1), np.log10(vocab.bucket_mass)
        for part in parts:
            texts = _texts(part, "_text")
            for begin, end in batches_of(texts):
                hashes, n = word_hashes(texts[begin:end])
                w, c1, c2, at, rare = items_of(vocab, hashes, n)
                size, m = n + 1, len(n)
                logp = np.bincount(np.repeat(np.arange(m), size), scorer(w, c1, c2), m) / np.log(10)
                doc = np.repeat(np.arange(m), n)
                seen = at >= 0
                known = np.bincount(doc, seen, m).astype(np.int64) + (vocab.texts > 0)
                add = lambda where, values: np.bincount(doc[where], values, m) if where.any() else np.zeros(m)
                out = part[held].iloc[begin:end].reset_index(drop=True)
                out["n_tokens"], out["n_known"] = size, known
                out["base"] = add(seen, weight[at[seen]]) + np.log10(vocab.texts + 0.1) - size * np.log10(vocab.mass)
                # A word in a bucket takes its share of it; the counts of unknown words are joined below.
                out["model"] = logp + add(rare & seen, weight[at[rare & seen]]) - add(rare, share[buckets_of(hashes[rare])])
                out["tail"] = np.split(hashes[~seen].view(np.int64), np.cumsum(np.bincount(doc[~seen], minlength=m))[:-1]) if m else []
                yield out

    rows = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.col("text").cast("binary").alias("_text"))
    first = rows.mapInPandas(run, f"{fields}, n_tokens long, n_known long, base double, model double, tail array<long>")
    # The numbers of the rows hold once they are written.
    first = cut(first.withColumn("_row", F.monotonically_increasing_id()))
    tail = first.select("_row", F.explode("tail").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("k"))
    tail = tail.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("_add"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"))
    out = first.drop("tail").join(tail, "_row", "left")
    add = F.coalesce("_add", F.lit(0.0))
    trained = F.lit(vocab.tokens > 0)
    made = {
        "n_tokens": F.col("n_tokens"),
        "n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)),
        "train_tokens": F.lit(vocab.tokens).cast("long"),
        "base_score": F.when(trained, F.col("base") + add).otherwise(0.0),
        "score": F.when(trained, F.col("model") + add).otherwise(0.0),
    }
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, kept.columns, strict=True)], *[c.alias(free_name(kept, n)) for n, c in made.items()])


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs.where(fold(10) != 0)), ["doc_id"])
    return scored.withColumn("held_out", fold(10) == 0)
