"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is a chain of small lattices (a run of word marks and the word after it;
no piece crosses them).  Pieces are weighted by their rank in the vocabulary file,
``1 / (rank + 2.7)``, to the power ``sharpness``; a character without a piece goes
to its bytes.  A backward pass turns weights into the exact probability of each
edge at each node.

Samples come in the order of their perturbed log-probabilities: a best-first
search over regions of the lattice, each with the perturbed maximum of what it
holds.  A region is *same pieces up to a step, another edge there*; its mass is
known exactly, so its maximum is drawn without looking inside: with
T = exp(-perturbed value), T of a region is T of its parent plus an exponential
variate divided by its mass.  The region with the least T is opened by drawing one
segmentation from it, which splits the rest into one region per step.  So the k
segmentations are distinct, and in the law of sampling without replacement.  The
T of the (k+1)-th gives each its inclusion probability 1 - exp(-p T).

All draws are hashes of the row key, the sample's number and the place in the
text, so a task that runs again gives the same samples.

Times are kept as logarithms, so no region is too faint to be drawn from.  Regions behind
a log-probability of ``FAINT`` are timed only where none of the others comes before
``SURE``, which they never do.

Scale: rows are independent and nothing is shuffled; lattices of a batch are built
once per distinct chunk, by array operations, from about ``BATCH`` bytes of
text at a time (a longer text is a batch of its own).  The vocabulary is read by
the driver and sent to the workers.

Defined results: a null or empty text has one segmentation, without pieces.  A
text with fewer than k segmentations has as many rows as it has.  Rows with equal
keys draw equally.  A null key counts as 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import free_name, mix64, slices_of, table

MARK = "▁"
BATCH = 1 << 18
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_BASE = np.uint64(0x9FB21C651E98DF25)
_BASE_INV = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
SLOTS = 19
#: A waiting time is 2^-53 or more, so what lies behind FAINT has a log T above SURE.
FAINT, SURE = -60.0, 23.0
#: Nodes of frequent chunks that a worker keeps, about 110 bytes each.
KEPT_NODES = 1 << 20
#: A vocabulary file is sent whole to each executor; a larger one is refused.
MAX_MODEL_BYTES = 1 << 26


class Pieces:
    """The vocabulary: weights, strings, and a hash table from substring hashes to ids."""

    def __init__(self, model: bytes, sharpness: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.byte = np.zeros(256, np.int32)
        self.raw: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value] = i
                self.raw[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses words")
                self.raw[i] = piece.replace(MARK, " ").encode()
                plain.append((i, piece))
        self.longest = max(len(p) for _, p in plain)
        ranks = np.arange(n, dtype=np.float64)
        for place, (i, _) in enumerate(sorted(plain, key=lambda x: (-sp.get_score(x[0]), x[0]))):
            ranks[i] = place
        p = 1 / (ranks + 2.7)
        p /= sum(p[i] for i, _ in plain)
        self.weight = np.zeros(n + 1)
        for i, _ in plain:
            self.weight[i] = p[i] ** sharpness
        #: A character that goes to its bytes is rarer than any piece.
        self.weight[self.unk] = min(p[i] for i, _ in plain) ** sharpness / 256
        codes = np.frombuffer("".join(x for _, x in plain).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for _, x in plain])
        self.keys = np.zeros((1 << SLOTS) + 64, np.uint64)
        self.ids = np.full((1 << SLOTS) + 64, -1, np.int16 if n < 32768 else np.int32)
        self.reach = 0
        prefix, inverse = _prefix(codes)
        begins = ends - [len(x) for _, x in plain]
        for (i, x), h in zip(plain, _substring(prefix, inverse, begins, ends, ends - begins).tolist(), strict=True):
            slot = h >> (64 - SLOTS)
            d = 0
            while self.keys[slot + d]:
                d += 1
            self.keys[slot + d], self.ids[slot + d] = h, i
            self.reach = max(self.reach, d)

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id the number of bytes and where they begin, and all bytes."""
        size = np.array([len(x) for x in self.raw], np.int64)
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(self.raw), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == hashes, self.ids[slot], -1)
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        for d in range(1, self.reach + 1):
            if not len(open_):
                break
            found = self.keys[slot[open_] + d]
            hit = found == hashes[open_]
            out[open_[hit]] = self.ids[slot[open_[hit]] + d]
            open_ = open_[~hit & (found != 0)]
        return out


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse power at each place."""
    n = len(codes)
    power = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(n + 1, _BASE_INV, np.uint64), dtype=np.uint64)
    values = mix64(codes.astype(np.uint64) + np.uint64(0x1234567)) * power
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), inverse


def _substring(prefix: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mix64((prefix[end] - prefix[begin]) * inverse[begin] + np.uint64(1) * np.asarray(size, np.uint64))


def read_model(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_file} holds more than {MAX_MODEL_BYTES} bytes")
    return model


@lru_cache(maxsize=1)
def lattice_of(model: bytes, sharpness: float) -> "Lattice":
    return Lattice(load(model, sharpness))


@lru_cache(maxsize=2)
def load(model: bytes, sharpness: float) -> Pieces:
    return Pieces(model, sharpness)


class Lattice:
    """Lattices of distinct chunks: a node per character and one at the end, edges by length.

    ``behind`` is the logarithm of the mass of all paths from a node to the end of
    its chunk, so an edge's probability needs no table; ``near`` holds running sums
    of those probabilities, to draw from.  The chunks that a worker meets first
    stay, up to ``KEPT_NODES`` nodes (frequent ones come early); what a batch adds to them
    is forgotten after it.  Results do not depend on it.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.wide = pieces, 1
        with np.errstate(divide="ignore"):
            self.log_weight = np.log(pieces.weight)
        self.kept: dict[str, int] = {}
        self.base = self.end = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.uint32)
        self.behind = np.zeros(0)
        #: How many edges a node has.
        self.options = np.zeros(0, np.int8)
        self.edge = np.zeros((0, 1), pieces.ids.dtype)
        self.near = np.zeros((0, 1), np.float32)
        self._kept_nodes = 0

    def kinds_of(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk's lattice; new ones are built."""
        n_kept = len(self.kept)
        found = np.array(list(map(self.kept.get, chunks)), np.float64)
        lost = np.flatnonzero(np.isnan(found))
        new: dict[str, int] = {}
        found[lost] = [new.setdefault(chunks[i], n_kept + len(new)) for i in lost.tolist()]
        self._build(list(new), n_kept)
        for c, i in new.items():
            if self.end[i] >= KEPT_NODES:
                break
            self.kept[c] = i
            self._kept_nodes = int(self.end[i]) + 1
        return found.astype(np.int64)

    def _build(self, chunks: list[str], n_kept: int) -> None:
        p, longest = self.pieces, self.pieces.longest
        sizes = np.array([len(c) for c in chunks], np.int64)
        # A zero ends each chunk; no piece holds one.
        codes = np.frombuffer("".join([c + "\0" for c in chunks]).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        n, begin = len(codes), self._kept_nodes
        room = np.repeat(ends, sizes + 1) - np.arange(n)
        prefix, inverse = _prefix(codes)
        edge = np.full((n, longest), -1, p.ids.dtype)
        at, wide = np.arange(n), self.wide
        for size in range(1, longest + 1):
            at = at[room[at] >= size]
            got = p.find(_substring(prefix, inverse, at, at + size, size))
            edge[at, size - 1] = got
            if size > wide and (got >= 0).any():
                wide = size
        edge[edge[:, 0] < 0, 0] = p.unk
        if wide > self.wide:
            more = wide - self.wide
            self.edge = np.pad(self.edge, ((0, 0), (0, more)), constant_values=-1)
            self.near = np.pad(self.near, ((0, 0), (0, more)), constant_values=1)
            self.wide = wide
        # Behind the last node stand ``wide`` more, so that no edge leads out of the arrays.
        if begin + n + wide > len(self.codes):
            room_for = begin + n + n // 4 + wide - len(self.codes)
            self.codes, self.behind, self.options = (np.pad(x, (0, room_for)) for x in (self.codes, self.behind, self.options))
            self.edge, self.near = (np.pad(x, ((0, room_for), (0, 0))) for x in (self.edge, self.near))
        self.codes[begin : begin + n] = codes
        self.edge[begin : begin + n] = edge[:, :wide]
        self.options[begin : begin + n] = (p.weight[edge[:, :wide]] > 0).sum(axis=1)
        self.base = np.concatenate([self.base[:n_kept], begin + ends - sizes])
        self.end = np.concatenate([self.end[:n_kept], begin + ends])
        self.behind[begin + ends] = 0
        # Backward, all chunks in step from their last character; ahead[:, k] is the
        # mass of what follows k + 1 characters on, relative to that of the next node.
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = begin + ends[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), "right")
        ahead = np.zeros((len(chunks), wide))
        ahead[:, 0] = 1
        for back, m in enumerate(active.tolist(), 1):
            rows = ends[:m] - back
            w = p.weight[self.edge[rows]] * ahead[:m]
            mass = w.sum(axis=1, keepdims=True)
            w /= mass
            self.behind[rows] = self.behind[rows + 1] + np.log(mass[:, 0])
            upto = np.cumsum(w, axis=1)
            # The last edge that has mass takes what rounding leaves.
            upto[np.arange(m), wide - 1 - np.argmax(w[:, ::-1] > 0, axis=1)] = 1
            self.near[rows] = np.maximum.accumulate(upto, axis=1)
            ahead[:m, 1:] = ahead[:m, :-1] / mass
            ahead[:m, 0] = 1

    def log_chance(self, node: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The log-probability of edge ``k`` at each node."""
        return self.log_weight[self.edge[node, k]] + self.behind[node + k + 1] - self.behind[node]

    def chances(self, node: np.ndarray) -> np.ndarray:
        """The probabilities of all edges of each node."""
        logs = self.log_weight[self.edge[node]] - self.behind[node, None]
        return np.where(np.isfinite(logs), np.exp(logs + self.behind[node[:, None] + 1 + np.arange(self.wide)]), 0.0)

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that the number u in (0, 1) falls on."""
        rows = self.near[node]
        u = np.minimum(u.astype(np.float32), np.float32(0.99999994))
        out = (rows[:, 0] <= u).astype(np.int8)
        for k in range(1, self.wide):
            out += rows[:, k] <= u
        return out


def _uniform(key: np.ndarray, place: np.ndarray | int, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments alone."""
    x = mix64(key + np.asarray(place, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def split_chunks(text: str) -> list[str]:
    """The chunks of a text: a line feed, or marks and the word after them; a mark stands before the text."""
    if not text:
        return []
    if "  " in text or MARK in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    # Single separators only: the common case, without a regular expression.
    return (MARK + text.replace("\n", " \n ").replace(" ", " " + MARK).replace(MARK + "\n " + MARK, "\n ")).split(" ")


class _Drawn:
    """One segmentation of one text.

    It shares the steps before ``start`` with ``parent`` and holds its own from
    there on: nodes, edges (length - 1) and tokens, and for each step the T of the
    region that leaves the segmentation there (where it is timed), with what that follows from.
    """

    __slots__ = ("parent", "start", "node", "edge", "tok", "logs", "race", "barred", "log_prob", "before", "rest", "arrival", "number", "timed")

    def time_all(self, key: np.uint64) -> None:
        """Time the regions behind FAINT too."""
        far = np.flatnonzero((self.before <= FAINT) & (self.rest > 0))
        self.race[far] = _times(self.arrival, key, far, self.number, self.before[far], self.rest[far])
        self.timed = True


def _times(arrival: np.ndarray | float, key: np.ndarray | np.uint64, step: np.ndarray, number: int, before: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log T of regions: that of their parent plus an exponential variate divided by their mass."""
    spread = -np.log(_uniform(key, step, 8 * number + 5))
    return np.logaddexp(arrival, np.log(spread / rest) - before)


def sample(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> tuple[list[list[_Drawn]], np.ndarray]:
    """For each text its segmentations in order, and the logarithm of the T that the next one would have."""
    chunks: list[str] = []
    counts = []
    for t in texts:
        found = split_chunks(t)
        chunks += found
        counts.append(len(found))
    kind = lattice.kinds_of(chunks)
    n_tok = np.array(counts, np.int64)
    first = np.cumsum(n_tok) - n_tok
    owner = np.repeat(np.arange(len(texts)), n_tok)
    start_node, end_node = lattice.base[kind], lattice.end[kind]
    keys = mix64(keys.astype(np.int64).view(np.uint64))
    #: A key for each token: draws in it depend on this and on the place in the token.
    tok_key = mix64(keys[owner] + (np.arange(len(kind)) - first[owner]).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    drawn: list[list[_Drawn]] = [[] for _ in texts]
    arrival = np.log(-np.log(_uniform(keys, 0, 1)))
    after = np.full(len(texts), np.inf)
    #: Texts to draw from, and where: (sample, step) to leave, or None at first.
    todo: list[tuple[int, _Drawn | None, int]] = [(i, None, 0) for i in range(len(texts))]
    for number in range(k):
        if not todo:
            break
        docs = np.array([x[0] for x in todo], np.int64)
        again = [(i, d, s) for i, d, s in todo if d is not None]
        fresh_from, carry = first[docs], np.zeros(len(texts))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left_tok = left_node = np.zeros(0, np.int64)
        if again:
            tok = np.array([d.tok[s] for _, d, s in again], np.int64)
            node = np.array([d.node[s] for _, d, s in again], np.int64)
            fresh_from = tok + 1
            carry[docs] = [d.log_prob - d.logs[s:].sum() for _, d, s in again]
            w = lattice.chances(node)
            for r, (_, d, s) in enumerate(again):
                w[r, d.edge[s]] = 0
                if s == 0:
                    w[r, d.barred] = 0
            cdf = np.cumsum(w, axis=1)
            u = _uniform(tok_key[tok], node - start_node[tok], 8 * number + 2) * cdf[:, -1]
            edge = np.minimum((cdf <= u[:, None]).sum(axis=1), w.shape[1] - 1)
            steps.append((tok, node, edge))
            w[np.arange(len(again)), edge] = 0
            beside = w.sum(axis=1)
            go = node + edge + 1 < end_node[tok]
            left_tok, left_node = tok[go], (node + edge + 1)[go]
        left = np.maximum(first[docs] + n_tok[docs] - fresh_from, 0)
        act = np.repeat(fresh_from - (np.cumsum(left) - left), left) + np.arange(left.sum())
        act, cur = np.concatenate([left_tok, act]), np.concatenate([left_node, start_node[act]])
        while len(act):
            edge = lattice.pick(cur, _uniform(tok_key[act], cur - start_node[act], 8 * number + 2))
            steps.append((act, cur, edge))
            cur = cur + edge + 1
            go = cur < end_node[act]
            act, cur = act[go], cur[go]
        # In the order of the text: by token, then by place in it.
        per = np.zeros(len(kind), np.int64)
        for t, _, _ in steps:
            per[t] += 1
        at = np.cumsum(per) - per
        n = int(per.sum())
        tok, node, edge = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int8)
        for t, x, e in steps:
            to = at[t]
            tok[to], node[to], edge[to] = t, x, e
            at[t] += 1
        del steps
        doc = owner[tok]
        per_doc = np.bincount(doc, minlength=len(texts))
        stop = np.cumsum(per_doc)
        begin = stop - per_doc
        logs = np.minimum(lattice.log_chance(node, edge), 0.0)
        total = np.cumsum(logs)
        base = np.where(begin > 0, total[begin - 1] if n else 0.0, 0.0)
        rest = -np.expm1(logs)
        # What is left beside a nearly certain edge, and beside edges that are spent, is summed up: a difference would be rounding.
        several = lattice.options[node] > 1
        rest[~several] = 0
        thin = np.flatnonzero(several & (rest < 1e-8))
        if len(thin):
            w = lattice.chances(node[thin])
            w[np.arange(len(thin)), edge[thin]] = 0
            rest[thin] = w.sum(axis=1)
        if again:
            rest[begin[[i for i, _, _ in again]]] = beside
        before = (carry - base)[doc] + total - logs
        race = np.full(n, np.inf)
        some = np.flatnonzero((before > FAINT) & (rest > 0))
        own = doc[some]
        race[some] = _times(arrival[own], keys[own], some - begin[own], number, before[some], rest[some])
        following = []
        for i, d, s in todo:
            part = slice(begin[i], stop[i])
            new = _Drawn()
            new.parent = d
            new.start = s
            new.tok, new.node, new.edge, new.logs, new.race = tok[part], node[part], edge[part], logs[part], race[part]
            new.before, new.rest, new.arrival, new.number, new.timed = before[part], rest[part], arrival[i], number, False
            new.log_prob = carry[i] + float(new.logs.sum())
            new.barred = [] if d is None else [*(d.barred if s == 0 else []), int(d.edge[s])]
            drawn[i].append(new)
            best, where = _first(drawn[i])
            if best >= SURE:
                for x in drawn[i]:
                    if not x.timed:
                        x.time_all(keys[i])
                best, where = _first(drawn[i])
            after[i] = best
            if where is not None and number + 1 < k:
                following.append((i, *where))
                where[0].race[where[1]] = np.inf
                arrival[i] = best
        todo = following
    return drawn, after


def _first(drawn: list[_Drawn]) -> tuple[float, tuple[_Drawn, int] | None]:
    """The least log T of all regions, and where it is."""
    best, where = np.inf, None
    for x in drawn:
        if len(x.race):
            at_step = int(x.race.argmin())
            if x.race[at_step] < best:
                best, where = float(x.race[at_step]), (x, at_step)
    return best, where


def piece_ids(pieces: Pieces, lattice: Lattice, d: _Drawn) -> np.ndarray:
    """Vocabulary ids of a segmentation; characters without a piece become bytes."""
    node, edge = _steps(d)
    ids = lattice.edge[node, edge].astype(np.int32)
    lost = np.flatnonzero(ids == pieces.unk)
    if not len(lost):
        return ids
    codes = lattice.codes[node[lost]]
    if (codes < 128).all():
        ids[lost] = pieces.byte[codes]
        return ids
    out, begin = [], 0
    for at, c in zip(lost.tolist(), codes.tolist(), strict=True):
        out += [ids[begin:at], pieces.byte[list(chr(c).encode("utf-8", "replace"))]]
        begin = at + 1
    return np.concatenate([*out, ids[begin:]])


def _steps(d: _Drawn) -> tuple[np.ndarray, np.ndarray]:
    """All nodes and edges of a segmentation, those that it shares with its parents first."""
    if d.parent is None:
        return d.node, d.edge
    node, edge = _steps(d.parent)
    own = len(node) - len(d.parent.node) + d.start
    return np.concatenate([node[:own], d.node]), np.concatenate([edge[:own], d.edge])


SAMPLE_FIELDS = "rank int, ids array<int>, n_pieces int, log_prob double, log_inclusion double"


def encode(docs: DataFrame, key: str, keep: list[str], k: int = 2, sharpness: float = 1.0, model_file: str = DEFAULT_MODEL, check: bool = False) -> DataFrame:
    """One row per document and segmentation: the columns ``keep`` and ``SAMPLE_FIELDS``.

    ``key`` names the integer column that seeds a row; ``text`` is encoded whole.
    With ``check`` the column ``round_trip`` says whether the ids, decoded by the same
    worker, give the text again.  A column of ours whose name a kept one has takes the
    next free name (``rank_``).
    """
    kept = docs.select(*keep)
    ours = T._parse_datatype_string(SAMPLE_FIELDS + (", round_trip boolean" if check else "")).fields
    schema = T.StructType([*kept.schema.fields, *[T.StructField(free_name(kept, f.name), f.dataType) for f in ours]])
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_file))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model.value, sharpness)
        pieces = lattice.pieces
        for whole in parts:
            for part in slices_of(whole, len(keep) + 1, BATCH):
                texts = part.column("text").to_pylist()
                drawn, nexts = sample(lattice, texts, part.column("key").to_numpy(zero_copy_only=False), k)
                origin = np.repeat(np.arange(len(texts)), [len(d) for d in drawn])
                ids = [piece_ids(pieces, lattice, x) for d in drawn for x in d]
                sizes = np.array([len(x) for x in ids], np.int32)
                logp = np.array([x.log_prob for d in drawn for x in d])
                rate = nexts[origin] + logp
                with np.errstate(divide="ignore", over="ignore"):
                    inclusion = np.where(rate < -30, rate, np.log(-np.expm1(-np.exp(np.minimum(rate, 700)))))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                made = [
                    pa.array([r for d in drawn for r in range(1, len(d) + 1)], pa.int32()),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.array(sizes),
                    pa.array(logp),
                    pa.array(inclusion),
                ]
                if check:
                    made.append(pa.array([t == texts[i] for t, i in zip(decoded(pieces, flat, offsets), origin.tolist(), strict=True)], pa.bool_()))
                given = [part.column(i).take(pa.array(origin)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*given, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def decoded(pieces: Pieces, values: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
    """The texts of lists of ids, from their flat values and offsets."""
    size, begin, flat = pieces.spelling()
    step = max(1, (1 << 19) * (len(offsets) - 1) // max(1, len(values)))
    # So many rows at a time that their bytes stay few.
    for a in range(0, len(offsets) - 1, step):
        edges = offsets[a : a + step + 1]
        own = values[edges[0] : edges[-1]]
        n = size[own]
        ends = np.cumsum(n)
        data = flat[np.repeat(begin[own] - (ends - n), n) + np.arange(n.sum())].tobytes()
        stops = np.concatenate([[0], ends])[edges - edges[0]].tolist()
        for x, y in zip(stops, stops[1:], strict=False):
            t = data[x:y]
            yield (t[1:] if t[:1] == b" " else t).decode("utf-8", "replace")


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of the column ``ids``."""
    kept = encoded.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(free_name(kept, "decoded"), T.StringType())])
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_file))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model.value, 1.0)
        for part in parts:
            column = part.column(len(keep))
            texts = list(decoded(pieces, column.values.to_numpy(), column.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, F.col(ids)).mapInArrow(run, schema)


def op8_spm_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, "doc_id", ["doc_id"], check=True).withColumn("ids_hash", F.xxhash64("ids")).drop("ids")
