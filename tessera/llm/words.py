"""Vectorised word spans and word hashes over the UTF-8 buffers of Arrow columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. These are ASCII, so
working on UTF-8 bytes equals working on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes don't cancel."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Words are hashed within so many bytes at a time; a longer word is hashed by xxhash.
_SEGMENT = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse that one segment needs."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(_SEGMENT + 1, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Block:
    """The words of consecutive texts: byte spans, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~IS_SPACE[data]
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # text i has words bounds[i]:bounds[i+1]

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of ``data`` in their place, if given)."""
        data = self.data if data is None else data
        out = np.empty(len(self.starts), dtype=np.uint64)
        up, down = _powers()
        first = 0
        with np.errstate(over="ignore"):
            while first < len(out):
                base = self.starts[first]
                last = max(first + 1, int(np.searchsorted(self.ends, base + _SEGMENT, side="right")))
                part = data[base : self.ends[last - 1]]
                if len(part) > _SEGMENT:  # a single word
                    out[first] = xxh64_intdigest(part.tobytes())
                else:
                    starts, ends = self.starts[first:last] - base, self.ends[first:last] - base
                    total = np.zeros(len(part) + 1, dtype=np.uint64)
                    np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64, out=total[1:])
                    out[first:last] = mix((total[ends] - total[starts]) * down[starts])
                first = last
        return out

    def text(self, k: int) -> bytes:
        """The bytes of text k."""
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if off is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; one longer text makes a range of its own."""
    _, offsets = utf8(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(len(column), max(first + 1, last))
        yield first, last
        first = last


def blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, Block]]:
    """The column's rows ``first:last`` with their words, a bounded number of bytes at a time."""
    data, offsets = utf8(column)
    for first, last in pieces(column, most):
        yield first, last, Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def texts(column: pa.Array) -> list[bytes]:
    """Each value as UTF-8 bytes; null counts as empty."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; what a task has freed goes back to the system at its end, as workers live on."""

    @wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _trim()

    return out


def strings(column: pa.Array, errors: str = "replace") -> list[str | None]:
    """Each value as a string; bytes that aren't UTF-8 are treated as ``errors`` says."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        wide = pa.types.is_large_string(column.type)
        raw = column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()
        return [None if t is None else t.decode("utf-8", errors) for t in raw]


def as_strings(values: list[bytes]) -> pa.Array:
    """A string column of these bytes as they are, even where they aren't UTF-8."""
    return pa.array(values, pa.binary()).view(pa.string())


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes, one for each start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out *= np.uint64(0xD1342543DE82EF95)
            out += h[k : k + m]
    return mix(out)


def ngrams_at(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The same hashes as ``ngrams``, only for the starts ``at``."""
    with np.errstate(over="ignore"):
        out = h[at]
        for k in range(1, n):
            out *= np.uint64(0xD1342543DE82EF95)
            out += h[at + k]
    return mix(out)


def crc_fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``: 0 is held out."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))
