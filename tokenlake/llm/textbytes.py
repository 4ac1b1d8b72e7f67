"""Words and shingles of many texts at once, on their UTF-8 bytes in numpy.

Texts come from Arrow batches; a block is a run of whole texts of about
BLOCK bytes, so the arrays in memory are bounded by that or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1_000_000
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte, after A-Z became a-z.
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BYTE[65:91] = _BYTE[97:123]
_BASE, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
#: Bytes whose running sums are held at once.
STRETCH = 1 << 16

_every = np.arange(256)
#: [^\x20\x09-\x0D]
NOT_BLANK = ~((_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z became a-z
LETTERS = ((_every >= 0x30) & (_every <= 0x39)) | ((_every >= 0x61) & (_every <= 0x7A)) | ((_every >= 0x41) & (_every <= 0x5A)) | (_every >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = _BASE, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base to the powers 0 to n - 1, at least."""
    if len(_kept.get(base, ())) < n:
        p = np.full(max(n, 4096), base, U64)
        p[0] = 1
        _kept[base] = np.multiply.accumulate(p)
    return _kept[base]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word. No word spans two texts."""
    mask = is_word[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = mask[inner]
    mask[:-1] &= ~mask[1:] | begin[1:]
    return np.flatnonzero(begin), np.flatnonzero(mask) + 1


def hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each word by running sums over runs of words of about STRETCH bytes, or one longer word."""
    out, i = np.zeros(len(lo), U64), 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + STRETCH, "right")))
        part, begin, end = data[lo[i] : hi[j - 1]], lo[i:j] - lo[i], hi[i:j] - lo[i]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * powers(len(part))[: len(part)], out=total[1:])
        out[i:j] = (total[end] - total[begin]) * powers(len(part), _INVERSE)[begin]
        i = j
    return mix(out + (hi - lo).astype(U64))


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and the end). No word spans two texts."""
    lo, hi = spans(data, offs, is_word)
    return hashes(data, lo, hi), np.searchsorted(lo, offs)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; fewer words make one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U64)
    m = min(n, k)
    h = np.full(n - m + 1, m, U64)
    for j in range(m):
        h = mix(h * _BASE + hashes[j : n - m + 1 + j])
    return np.unique(h)
