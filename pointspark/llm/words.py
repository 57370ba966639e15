"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a run of letters, case ignored. Texts of plain ASCII go straight from the Arrow buffer to
numpy; only the others pass through Python's string functions, and come out as their words in lower case
joined by blanks, where every byte from 0x80 on belongs to a letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

_LETTERS = regex.compile(r"\p{L}+")
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.zeros(256, np.uint64)
for _c in range(26):
    _LOWER[97 + _c] = _LOWER[65 + _c] = 1 + _c
_LOWER[128:] = np.arange(128, 256)
#: Texts are handled together until they have so many bytes.
CHUNK_BYTES = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def lowered(text: str) -> bytes:
    """The words of any text in lower case, joined by blanks."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which word each text begins (one entry more than texts)."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    x = _LOWER[buf]
    letter = np.r_[False, x > 0, False]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _grown(len(buf) + 1)
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(x * power[: len(buf)], out=s[1:])
    h = mixed((s[end] - s[start]) * inverse[start])
    begins = np.cumsum(np.r_[0, np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))])
    return h, np.searchsorted(start, begins)


def chunks(column: pa.Array, slow, rewrite: Callable[[str], bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a string column in chunks: (number of the first row, texts as bytes); null is the empty text.

    ``slow(bytes)`` says whether a text must be rewritten by ``rewrite(str)``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    first, out, size = 0, [], 0
    for i in range(n):
        t = bytes(data[offsets[i] : offsets[i + 1]]) if valid[i] else b""
        if slow(t):
            t = rewrite(t.decode("utf-8", "replace"))
        out.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out
