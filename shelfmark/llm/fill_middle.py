"""Fill-in-the-middle: cut a text at two unit boundaries and put the middle last.

The bytes of a text are counted in fixed blocks.  A Fenwick tree over the blocks
holds how many units end, and how many code points begin, in each span of blocks;
a descent by halving steps finds the block of a cut, and the cut is then looked
for inside that block alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.llm.common import slices_of, table

BLOCK = 4096
SLAB = BLOCK * 1024
#: Bytes of text that are cut at a time.
GROUP = 8 << 20


@dataclass(frozen=True)
class Shape:
    """What is drawn for a text: rates in percent; units are lines or single code points."""

    seed: int = 7
    unit: str = "line"
    fim_percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = [self.prefix, self.suffix, self.middle]
        if self.unit not in ("line", "char"):
            raise ValueError("unit is line or char")
        if not all(marks) or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("marks are not empty and hold none of the others")
        if any(m[:i] == n[-i:] for m in marks for n in marks for i in range(1, min(len(m), len(n)))):
            raise ValueError("no mark begins as one ends, so that texts beside them make no new mark")


class Blocks:
    """Fenwick tree over the blocks of one text: units that end and code points that begin."""

    def __init__(self, raw: np.ndarray, unit: str) -> None:
        self.raw, self.unit = raw, unit
        n = -(-len(raw) // BLOCK)
        counts = np.zeros((n + 1, 2), np.int64)
        for at in range(0, len(raw), SLAB):
            part = raw[at : at + SLAB]
            edges = np.arange(0, len(part), BLOCK)
            rows = slice(1 + at // BLOCK, 1 + at // BLOCK + len(edges))
            counts[rows, 1] = np.add.reduceat((part & 0xC0) != 0x80, edges, dtype=np.int64)
            counts[rows, 0] = counts[rows, 1] if unit == "char" else np.add.reduceat(part == 10, edges, dtype=np.int64)
        if unit == "line" and len(raw) and raw[-1] != 10:
            counts[n, 0] += 1  # the last line ends with the text
        before = np.cumsum(counts, axis=0)
        at = np.arange(n + 1)
        self.tree = before - before[at - (at & -at)]
        self.units, self.points = (int(x) for x in before[n])

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code point at which the first ``units`` units end."""
        if units <= 0:
            return 0, 0
        if units >= self.units:
            return len(self.raw), self.points
        block, points = 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            if block + step < len(self.tree) and self.tree[block + step, 0] < units:
                block += step
                units -= int(self.tree[block, 0])
                points += int(self.tree[block, 1])
            step >>= 1
        begin = block * BLOCK
        local = self.raw[begin : begin + BLOCK]
        if self.unit == "char":
            # The unit ends where the next code point begins, be it in the next block.
            heads = np.flatnonzero((self.raw[begin : begin + BLOCK + 4] & 0xC0) != 0x80)
            return begin + (int(heads[units]) if units < len(heads) else len(local)), points + units
        end = int(np.flatnonzero(local == 10)[units - 1]) + 1
        return begin + end, points + int(np.count_nonzero((local[:end] & 0xC0) != 0x80))


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of the seed and the row's key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: bytes, key: str, shape: Shape) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle) of one text."""
    blocks = Blocks(np.frombuffer(text, np.uint8), shape.unit)
    p, s, m = (x.encode() for x in (shape.prefix, shape.suffix, shape.middle))
    h1, h2, h3, h4 = draws(key, shape.seed)
    if not text or p in text or s in text or m in text or h3 % 100 >= shape.fim_percent:
        return text, "plain", blocks.units, None, None
    one, two = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
    (a, chars), (b, more) = blocks.cut(one), blocks.cut(two)
    if h4 % 100 < shape.spm_percent:
        return b"".join((s, text[b:], p, text[:a], m, text[a:b])), "spm", blocks.units, chars, more - chars
    return b"".join((p, text[:a], s, text[b:], m, text[a:b])), "psm", blocks.units, chars, more - chars


RESULT = pa.struct([("output", pa.string()), ("form", pa.string()), ("units", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def fill_in_middle(docs: DataFrame, key: str, text: str, shape: Shape = Shape(), name: str = "fim") -> DataFrame:
    """``docs`` with the struct ``name``: output, form (plain, psm or spm), units, prefix_chars, middle_chars.

    The draws depend on the seed and on ``key`` as text (null: the empty text), so equal
    rows give equal results.  A null text is the empty one.  Empty texts, texts that hold a
    mark, and those that the rate leaves out are plain: the output is the text.  A column of
    ``docs`` that is called ``name`` is replaced; other columns are kept as they are.
    """
    kept = [c for c in docs.columns if c != name]
    fields = pa.schema([("_key", pa.string()), ("_text", pa.binary())])
    sent = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias(fields[0].name),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(fields[1].name),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices_of(part, 2, GROUP):
                keys, texts = (some.column(i).to_pylist() for i in (1, 2))
                found = list(zip(*(transform(t, k, shape) for k, t in zip(keys, texts, strict=True)), strict=True))
                columns = [pa.array(c, pa.binary()).cast(f.type) if f.name == "output" else pa.array(c, f.type) for c, f in zip(found, RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.StructArray.from_arrays(columns, fields=list(RESULT))], names=["row", name])

    result = "struct<output: string, form: string, units: long, prefix_chars: long, middle_chars: long>"
    schema = sent.select("row").schema.add(name, DataType.fromDDL(result))
    return sent.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in kept], f"`{name}`")


def restore(output: Column, form: Column, shape: Shape = Shape()) -> Column:
    """The text from which ``fill_in_middle`` made ``output``: each mark stands in it once."""
    middle = F.substring_index(output, shape.middle, -1)
    head = F.substring_index(output, shape.middle, 1)

    def parted(first: str, second: str) -> tuple[Column, Column]:
        left = F.substring_index(head, second, 1)
        return F.substr(left, F.lit(len(first) + 1)), F.substring_index(head, second, -1)

    prefix, suffix = parted(shape.prefix, shape.suffix)
    suffix_, prefix_ = parted(shape.suffix, shape.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle, suffix_)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return docs.select(
        "doc_id",
        F.col("fim.units").alias("n"),
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim.output"), F.col("fim.form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n,
  cast('0x' || h[1:8] AS bigint) % (len(u) + 1) AS c1, cast('0x' || h[9:16] AS bigint) % (len(u) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR cast('0x' || h[17:24] AS bigint) % 100 >= 100 THEN 'plain'
    WHEN cast('0x' || h[25:32] AS bigint) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid, array_to_string(u[greatest(c1, c2) + 1:], '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
