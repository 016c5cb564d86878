"""TIFF media columns: write and read grey or multi-sample images.

``read_pages`` walks the chain of image directories of each file, decodes
strips or tiles (none, PackBits, LZW, deflate), undoes the horizontal predictor
and gives one row per page.  ``write_payload`` stores a byte string losslessly
as an image 64 samples wide.

Defined results: a null file gives no page; a file that cannot be read gives one
row with ``error`` set and null pixels; a page whose directory was already
visited ends the walk.  A null text is the empty text.  Payloads are whole,
whatever their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import batches_of, table

WIDTH = 64
#: Bytes of texts or files that a task turns at a time.
GROUP = 1 << 22
# Fixed values of the format: compression codes, and type sizes by type code.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END = 256, 257
#: How many codes after a clear have 9, 10 and 11 bits (early change); then 12.
WIDTH_ENDS = (254, 766, 1790)
#: The code after which the encoder's table is full.
LAST_CODE = 3836


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(begin: int, end: int) -> None:
        for i in range(begin, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(at, m.start())
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)[:size]


def _code_width(k: int) -> int:
    return 9 + sum(k >= e for e in WIDTH_ENDS)


def _pack(codes: list[int]) -> list[np.ndarray]:
    """Bits of the codes that follow one clear code; their width depends on their place alone."""
    c, parts, begin = np.array(codes, dtype=np.uint16), [], 0
    for width, end in zip((9, 10, 11, 12), (*WIDTH_ENDS, len(codes)), strict=True):
        part = c[begin : min(end, len(codes))]
        if len(part):
            parts.append(((part[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8).ravel())
        begin = max(begin, min(end, len(codes)))
    return parts


def lzw_encode(data: bytes) -> bytes:
    bits = [np.array([int(b) for b in f"{CLEAR:09b}"], dtype=np.uint8)]
    codes: list[int] = []
    seen: dict[int, int] = {}
    after = 258
    word = -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        code = seen.get(key)
        if code is not None:
            word = code
            continue
        codes.append(word)
        word = byte
        if len(codes) > LAST_CODE:
            bits += _pack([*codes, CLEAR])
            codes, seen, after = [], {}, 258
        else:
            seen[key] = after
            after += 1
    if word >= 0:
        codes.append(word)
    bits += _pack([*codes, END])
    return np.packbits(np.concatenate(bits)).tobytes()


def _lzw_codes(data: bytes) -> Iterator[list[int]]:
    """Runs of codes between clear codes."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    at, k, run = 0, 0, []
    while True:
        width = _code_width(k)
        end = (*WIDTH_ENDS, 1 << 30)[width - 9]
        n = min(end - k, (len(bits) - at) // width, 4096)
        if n <= 0:
            yield run
            return
        codes = bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1)).astype(np.int32)
        special = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(special[0]) if len(special) else n
        run += codes[:stop].tolist()
        if len(special) == 0:
            at, k = at + n * width, k + n
            continue
        yield run
        if codes[stop] == END:
            return
        at, k, run = at + (stop + 1) * width, 0, []


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    for run in _lzw_codes(data):
        entries, before = single.copy(), b""
        for code in run:
            if code < len(entries):
                word = entries[code]
            elif code == len(entries) and before:
                word = before + before[:1]
            else:
                raise ValueError("code out of range")
            if before:
                entries.append(before + word[:1])
            out.append(word)
            before = word
    return b"".join(out)[:size]


#: Each byte with its bits from last to first.
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).tobytes()


def _compress(data: bytes, how: int) -> bytes:
    return {NONE: lambda x: x, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[how](data)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how}")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, tiled: bool = False, predictor: int = 1, rows_per_strip: int = 256) -> bytes:
    """A little-endian file of 8-bit pages, each (rows, columns) or (rows, columns, samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = a.shape
        if tiled:
            side_w, side_h = -(-width // 16) * 16, min(-(-height // 16) * 16, rows_per_strip)
            full = np.zeros((-(-height // side_h) * side_h, side_w, samples), np.uint8)
            full[:height, :width] = a
            pieces = [full[i : i + side_h] for i in range(0, len(full), side_h)]
        else:
            pieces = [a[i : i + rows_per_strip] for i in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for p in pieces:
            if predictor == 2:
                p = np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1)
            body = _compress(p.tobytes(), compression)
            places.append(len(out))
            sizes.append(len(body))
            out += body
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples])]
        tags += [(322, 4, [side_w]), (323, 4, [side_h]), (324, 4, places), (325, 4, sizes)] if tiled else [(273, 4, places), (278, 4, [rows_per_strip]), (279, 4, sizes)]
        tags += [(317, 3, [predictor])] if predictor != 1 else []
        entries = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += raw
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The tags of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, visited = struct.unpack(f"{order}I", data[4:8])[0], set()
    while at and at not in visited:
        visited.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
            if kind in TYPE_CODE:
                size = TYPE_SIZE[kind] * count
                place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place))
        yield tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def decode_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """(rows, columns, samples) of one directory; 8 or 16 bits a sample, all samples alike and interleaved.

    Other layouts (a missing number of bits means 1) and predictors are errors.
    """
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(256), one(257), one(277, 1), one(258, 1)
    if bits not in (8, 16) or set(tags[258]) != {bits} or one(284, 1) != 1 or one(266, 1) not in (1, 2):
        raise ValueError("sample layout")
    predictor = one(317, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    kind = np.dtype(f"{'<' if data[:2] == b'II' else '>'}u{bits // 8}")
    if 324 in tags:
        tile_w, tile_h, places, sizes = one(322), one(323), tags[324], tags[325]
    else:
        tile_w, tile_h, places, sizes = width, min(one(278, height), height), tags[273], tags[279]
    if min(width, height, tile_w, tile_h, samples) < 1:
        raise ValueError("a size of 0")
    # No codec here makes more than MOST_EXPANDED bytes of one, so larger sizes are wrong, and are not allocated.
    held = sum(max(0, min(size, len(data) - place)) for place, size in zip(places, sizes, strict=True))
    across, down = -(-width // tile_w), -(-height // tile_h)
    if len(places) != across * down or max(width * height, across * down * tile_w * min(tile_h, height)) * samples * bits // 8 > MOST_EXPANDED * held:
        raise ValueError("sizes beyond what the strips or tiles hold")
    page = np.zeros((height, width, samples), kind)
    for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = i // across * tile_h, i % across * tile_w
        rows = tile_h if 324 in tags else min(tile_h, height - top)
        want = rows * tile_w * samples * bits // 8
        stored = data[place : place + size]
        if one(266, 1) == 2:
            stored = stored.translate(REVERSED)
        raw = _expand(stored, one(259, NONE), want)
        if len(raw) != want:
            raise ValueError("short strip or tile")
        a = np.frombuffer(raw, kind).reshape(rows, tile_w, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=kind)
        page[top : top + rows, left : left + tile_w] = a[: height - top, : width - left]
    return page


#: Bytes that one stored byte can become, rounded up: LZW words of 12 bits stand for 4,096 bytes at most.
MOST_EXPANDED = 4096

PAGE_FIELDS = "page_no int, width int, height int, samples int, compression int, tiled boolean, predictor int, pixels binary, error string"


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the other columns of ``files`` and ``PAGE_FIELDS``, which replace columns of their names."""
    made = T._parse_datatype_string(PAGE_FIELDS)
    files = files.drop(*[c for c in made.names if c != media])
    rest = [f for f in files.schema.fields if f.name != media]
    schema = T.StructType([*rest, *made.fields])
    names = [f.name for f in rest]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            sizes = [b"" if d is None else d for d in whole[media]]
            for begin, end in batches_of(sizes, GROUP):
                yield pages_of(whole.iloc[begin:end])

    def pages_of(part: pd.DataFrame) -> pd.DataFrame:
        origin, rows = [], []
        for i, data in enumerate(part[media]):
            if data is None:
                continue
            page_no = -1
            try:
                for page_no, tags in enumerate(directories(data)):
                    a = decode_page(data, tags)
                    rows.append((page_no, a.shape[1], a.shape[0], a.shape[2], tags.get(259, [NONE])[0], 324 in tags, tags.get(317, [1])[0], a.tobytes(), None))
                    origin.append(i)
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                rows.append((page_no + 1, None, None, None, None, None, None, None, str(e)[:200]))
                origin.append(i)
        made = pd.DataFrame(rows, columns=[f.name for f in schema.fields[len(rest) :]])
        kept = part[names].iloc[origin].reset_index(drop=True)
        for c in ("page_no", "width", "height", "samples", "compression", "predictor"):
            made[c] = made[c].astype("Int32")
        return pd.concat([kept, made], axis=1)

    return files.mapInPandas(run, schema)


def write_payload(payload: bytes) -> bytes:
    """``payload`` (its length a multiple of 64) as one page; the layout follows from its bytes."""
    choice = zlib.crc32(payload) % 6
    return write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)], (PACKBITS, LZW, DEFLATE)[choice % 3], choice >= 3, 2 if choice == 5 else 1)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by n_bytes and media, the stored TIFF file."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    raw = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text].tolist()
            for begin, end in batches_of(texts, GROUP):
                out = part[[f.name for f in rest]].iloc[begin:end].copy()
                out["n_bytes"] = [len(t) for t in texts[begin:end]]
                out["media"] = [write_payload(t + bytes(-len(t) % WIDTH if t else WIDTH)) for t in texts[begin:end]]
                yield out

    return raw.mapInPandas(run, schema)


def grid_feature(pixels: pd.Series) -> pd.Series:
    """16 hex digits: which cells of an 8 x 8 grid are brighter than the page."""

    def one(p: bytes) -> str:
        a = np.frombuffer(p, np.uint8).reshape(-1, 8, 8).sum(axis=2, dtype=np.int64)
        edges = np.linspace(0, len(a), 9).astype(int)
        total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(a, axis=0)])
        sums = total[edges[1:]] - total[edges[:-1]]
        area = np.diff(edges)[:, None] * 8
        return np.packbits((sums * a.size * 8 > a.sum() * area).ravel()).tobytes().hex()

    return pixels.map(one, na_action="ignore")


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_texts(docs).withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = read_pages(stored)
    feature = F.pandas_udf(grid_feature, "string")
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -WIDTH, WIDTH)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature("pixels").alias("feature"),
    )
