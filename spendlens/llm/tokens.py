"""Word and shingle hashes of Arrow text columns, computed with numpy.

An Arrow string column is one byte buffer with offsets.  Words are maximal
runs of bytes other than six ASCII separators, so the byte view is exact for
UTF-8.  Hashes are taken over a bounded window of bytes at a time; memory is a
small multiple of ``CHUNK`` plus eight bytes per word.
"""
from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _give_back() -> None:
    """Returns freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(function):
    """For functions over batches: the worker, which lives on after the task, keeps none of the memory the task used."""
    @functools.wraps(function)
    def run(*args):
        try:
            yield from function(*args)
        finally:
            _give_back()
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    width = np.int64 if large else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chunk`` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of consecutive texts, and each
    text's range of words: ``first[i]:first[i + 1]``.  ``separator`` tells for each byte whether it ends a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = separator[data]
    word = ~space
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, chunk: int = CHUNK) -> np.ndarray:
    """64-bit hashes of the words, with A-Z lower-cased if ``fold``: a polynomial
    in an odd base modulo 2**64 over the bytes, scrambled with the length."""
    return hash_prefixes(data, starts, ends, (), fold, chunk)[0]


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts, fold: bool = True, chunk: int = CHUNK) -> list[np.ndarray]:
    """Hashes of the words, and for each of ``cuts`` of their first so many
    bytes (0 for words that are not longer)."""
    outs = [np.zeros(len(starts), dtype=np.uint64) for _ in range(1 + len(cuts))]
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + chunk, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        piece = data[a:b]
        if fold:
            piece = _FOLD[piece]
        if b - a > chunk:  # one very long word
            outs[0][i] = int.from_bytes(hashlib.blake2b(piece.tobytes(), digest_size=8).digest(), "little")
        else:
            up, down = _power(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            low, back = sums[s], down[s]
            outs[0][i:j] = mix((sums[e] - low) * back + mix((e - s).astype(np.uint64)))
            for out, cut in zip(outs[1:], cuts):
                long = np.flatnonzero(e - s > cut)
                out[i + long] = mix((sums[s[long] + cut] - low[long]) * back[long] + np.uint64(0xA5A5A5A5 + cut))
        i = j
    return outs


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows that start at each word; the last
    ``width - 1`` entries are missing."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n]
    for k in range(1, width):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + hashes[k:k + n])
    return h


def fold_sequence(hashes: np.ndarray) -> int:
    """Hash of one whole word sequence, apart from hashes of windows."""
    h = hashlib.blake2b(hashes.tobytes(), digest_size=8, person=b"sequence")
    return int.from_bytes(h.digest(), "little")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of consecutive texts (A-Z lower-cased): of
    the ``width``-word windows, or of the whole sequence if it has fewer words."""
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        piece = data[offsets[i]:offsets[j]]
        starts, ends, first = find_words(piece, offsets[i:j + 1] - offsets[i])
        hashes = hash_words(piece, starts, ends)
        grams = windows(hashes, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a:b - width + 1]))
            elif b > a:
                out.append(np.array([fold_sequence(hashes[a:b])], dtype=np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
