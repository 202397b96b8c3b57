"""Hashes of words and word shingles, taken from the UTF-8 bytes of a text with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one pass over a text holds at once; a cut is made only at a separator.
PIECE = 1 << 20

#: Words of more bytes than this are hashed in two ways.
LONG = 500

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: the space and the bytes 09 to 0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_RATIO = 0xD1342543DE82EF95
_INVERSE = pow(_RATIO, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_RATIO, _INVERSE)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def _piece(b: np.ndarray, space: np.ndarray) -> np.ndarray:
    gap = np.empty(len(b) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = space[b]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turns[::2], turns[1::2]
    power, inverse = _tables(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    out = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    # Long words can be built that agree in any polynomial modulo 2^64; for these, sums with a random factor for each place count too.
    for k in np.flatnonzero(end - start > LONG):
        out[k] = mix(out[k : k + 1] + _by_place(b[start[k] : end[k]]))[0]
    return out


def _by_place(word: np.ndarray) -> np.ndarray:
    at = np.arange(1, len(word) + 1, dtype=np.uint64)
    return np.array([(mix(word.astype(np.uint64) * _STEP + at) * mix(at ^ np.uint64(0x2545F4914F6CDD1D))).sum(dtype=np.uint64)])


def word_hashes(data: np.ndarray, space: np.ndarray = SPACE) -> np.ndarray:
    """One 64-bit hash for each word of a text (bytes, A-Z lower-cased), in order; equal words, equal hashes."""
    b = LOWER[data]
    if len(b) <= PIECE:
        return _piece(b, space)
    parts, at = [], 0
    while at < len(b):
        to = min(at + PIECE, len(b))
        while to < len(b) and not space[b[to]]:
            cut = np.flatnonzero(space[b[to : to + PIECE]])
            to = to + int(cut[0]) if len(cut) else min(to + PIECE, len(b))
        parts.append(_piece(b[at:to], space))
        at = to
    return np.concatenate(parts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, ascending; one of fewer words is a single shingle; none gives none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        h = np.array([n], dtype=np.uint64)
        for k in range(n):
            h = mix(h * _STEP + words[k : k + 1])
        return h
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(_RATIO) + words[k : n - size + 1 + k]
    return np.unique(mix(total))


def byte_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text of an Arrow column, without decoding; None for a null."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        if not len(chunk):
            continue
        at = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(chunk)):
            yield raw[at[k] : at[k + 1]] if valid[k] else None
