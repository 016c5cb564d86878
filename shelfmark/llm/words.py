"""Words of many texts as 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

from shelfmark.llm.common import ASCII_SPACE, mix64

#: Bytes of text that are hashed at a time; a longer word makes a longer piece.
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xA24BAED4963EE407
_BACK = pow(_BASE, -1, 1 << 64)


def byte_mask(separators: bytes) -> np.ndarray:
    """Which of the 256 bytes belong to words."""
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


#: Everything but U+0020 and U+0009 to U+000D.
NOT_SPACE = byte_mask(ASCII_SPACE)

#: Digits, a to z, and all beyond ASCII.
ALNUM = byte_mask(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(_BASE, PIECE + 1), powers(_BACK, PIECE + 1)


def _hash_piece(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece, which a separator ends."""
    edge = np.diff(is_word[raw].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    short = len(raw) < len(_UP)
    up = _UP[: len(raw)] if short else powers(_BASE, len(raw))
    down = _DOWN if short else powers(_BACK, len(raw))
    total = np.cumsum(_VALUE[raw] * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix64((total[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64)), starts


def hashed_words(texts: list[bytes], is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the number of words of each text; ``lower`` lower-cases A-Z."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < PIECE):
            size += len(texts[last]) + 1
            last += 1
        joined = b"\n".join(texts[first:last]) + b"\n"
        raw = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        bounds = np.cumsum([len(t) + 1 for t in texts[first:last]])
        begin = 0
        while begin < len(raw):
            end = min(begin + PIECE, len(raw))
            while end < len(raw):
                gaps = np.flatnonzero(~is_word[raw[begin:end]][::-1])
                if len(gaps):
                    end -= int(gaps[0])
                    break
                end = min(end + PIECE, len(raw))
            found, starts = _hash_piece(raw[begin:end], is_word)
            hashes.append(found)
            counts[first:last] += np.diff(np.searchsorted(starts, bounds - begin), prepend=0)
            begin = end
        first = last
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
