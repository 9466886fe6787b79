"""Measurements of whole texts, shared by the quality rules and the quality classifier.

All counts are exact over the whole text; a null text counts as empty. Words are runs of
``[^\\x20\\x09-\\x0D]``, lines are split at ``\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Block, blocks, mix, ngrams, texts

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_lower",
    "n_digits",
    "n_pipes",
    "n_exclaim",
    "n_symbol_words",
    "n_short_words",
    "n_long_words",
    "n_chars",
]


def _set(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL = _set(b"#*$%&|<>")
_UPPER = _set(bytes(range(65, 91)))
_LOWER = _set(bytes(range(97, 123)))
_DIGIT = _set(b"0123456789")
_START = ~_set(bytes(range(128, 192)))  # a byte that begins a code point


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def repeat_words(h: np.ndarray, text_of: np.ndarray, n: int = 3) -> np.ndarray:
    """For each word, whether a window of n words of its text that covers it is found there twice."""
    covered = np.zeros(len(h), dtype=bool)
    g = ngrams(h, n)
    if not len(g):
        return covered
    inside = text_of[: len(g)] == text_of[n - 1 :]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = mix(g[at] + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    found = at[order[same[1:] | same[:-1]]]
    for k in range(n):
        covered[found + k] = True
    return covered


def distinct_words(h: np.ndarray, text_of: np.ndarray, n_texts: int) -> np.ndarray:
    if not len(h):
        return np.zeros(n_texts, dtype=np.int64)
    with np.errstate(over="ignore"):
        key = mix(h + text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(text_of[order[first]], minlength=n_texts)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(block: Block, raw: list[bytes]) -> dict[str, np.ndarray]:
    """Every measurement of the texts of a block."""
    data, offsets, bounds, n = block.data, block.offsets, block.bounds, len(raw)
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    h = block.hashes()
    inner = np.flatnonzero(~_START[data])  # bytes that don't begin a code point
    points = lambda at: at - np.searchsorted(inner, at)
    symbols = np.flatnonzero(_SYMBOL[data])
    signs = np.searchsorted(symbols, block.ends) - np.searchsorted(symbols, block.starts)
    length = points(block.ends) - points(block.starts)
    by_text = lambda x: np.bincount(text_of, weights=x, minlength=n).astype(np.int64)
    lines = [duplicate_lines(t) for t in raw]
    return {
        "n_words": np.diff(bounds),
        "word_chars": by_text(length),
        "n_symbols": np.diff(np.searchsorted(symbols, offsets)),
        "n_dup_lines": np.array([d for _, d in lines], dtype=np.int64),
        "n_repeat_words": by_text(repeat_words(h, text_of)),
        "n_lines": np.array([m for m, _ in lines], dtype=np.int64),
        "n_distinct_words": distinct_words(h, text_of, n),
        "n_upper": _sums(_UPPER[data], offsets),
        "n_lower": _sums(_LOWER[data], offsets),
        "n_digits": _sums(_DIGIT[data], offsets),
        "n_pipes": _sums(data == ord("|"), offsets),
        "n_exclaim": _sums(data == ord("!"), offsets),
        "n_symbol_words": by_text(signs > 0),
        "n_short_words": by_text(length <= 3),
        "n_long_words": by_text(length >= 14),
        "n_chars": np.diff(points(offsets)),
    }


def measured(column: pa.Array) -> Iterator[tuple[int, int, Block, dict[str, np.ndarray]]]:
    """Rows ``first:last`` of a text column with their words and measurements, block by block."""
    for first, last, block in blocks(column):
        yield first, last, block, measure(block, texts(column[first:last]))
