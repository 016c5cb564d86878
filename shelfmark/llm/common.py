"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: U+0020 and U+0009 to U+000D, as ``bytes.split`` has them.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; where it is unset, local masters, as in tests, get a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there: compressed, read by column, and of known size."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` (already cut, so cheap to count) has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def fold(n: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_POW = np.cumprod(np.full(64, 0xA24BAED4963EE407, dtype=np.uint64), dtype=np.uint64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(ASCII_SPACE)] = False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` and the number of words of each text.

    Words are runs of bytes outside ``ASCII_SPACE``; upper-case A-Z counts as
    lower case.  The hash is a sum of random byte values times powers of a
    random base, mixed at the end, so it needs no Python loop over words.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    inside = _IS_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends_of_text = np.cumsum(sizes)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(edge == -1)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
    longest = int(lengths.max())
    power = _POW if longest <= len(_POW) else np.cumprod(np.full(longest, _POW[0], dtype=np.uint64), dtype=np.uint64)
    values = _BYTE[raw[at]] * power[within]
    hashes = mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, ends_of_text), prepend=0)


class HashIndex:
    """Places of distinct 64-bit hashes, found by array operations: an open table at a quarter of its room."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = max(4, int(4 * len(hashes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.at, self.key = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
        self.reach, todo = 0, np.arange(len(hashes))
        while len(todo):
            slot = self._slot(hashes[todo], self.reach)
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            self.key[slot[free]] = hashes[self.at[slot[free]]]
            todo = todo[self.at[slot] != todo]
            self.reach += 1

    def _slot(self, hashes: np.ndarray, steps: int) -> np.ndarray:
        return ((hashes >> self.shift).astype(np.int64) + steps) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        for d in range(self.reach):
            mine = hashes[open_] if d else hashes
            slot = self._slot(mine, d)
            at, hit = self.at[slot], self.key[slot] == mine
            hit &= at >= 0
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (at >= 0)]
            if not len(open_):
                break
        return out


def batches_of(texts: list[bytes], limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Index ranges of consecutive texts that together hold about ``limit`` bytes (one text at least)."""
    out, begin, total = [], 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            out.append((begin, i))
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def slices_of(part: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``part`` whose ``column`` (strings or bytes) holds about ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < part.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        end = min(end, begin + 4096)
        yield part.slice(begin, end - begin)
        begin = end
