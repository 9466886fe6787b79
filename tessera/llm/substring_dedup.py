"""Removal of repeated passages by seed and extend.

Seeds: every window of ``length`` words is represented by its winnowed anchor, the smallest hash
among its ``anchor``-word shingles; equal windows have equal anchors. Anchors are joined across
documents, and only those found in two documents seed anything.

Extension: around a seeding anchor the match is extended to both sides to every window that the
anchor represents (up to ``length - anchor`` words either way). Extended windows are joined by a
95-bit hash of their whole word sequence; one is repeated if it also starts in a document with a
smaller id. Overlapping repeated windows make up the maximal repeats of at least ``length``
words, and their words are removed. Matches aren't walked pair by pair: around a passage that
a third of the corpus shares that would be quadratic, and a single representative of an anchor
would miss what only two other documents share. Grouping the extended windows is exact.

Scale: nothing is paired; a worker's buffers hold ``hold`` records of at most 36 bytes. A task folds the anchors and the windows of a bounded chunk of documents
before they are shuffled, so a passage that a third of the corpus shares sends one record for
each chunk and is settled inside the chunk otherwise; the shuffled records are sorted and read
as a stream, never collected by key. What is collected by document is bounded by the document.
The texts are shuffled once, by id, and that exchange serves both joins.

Defined cases: a null or empty text has no words; texts shorter than ``length`` words keep all;
rows with equal ids are one document for what counts as smaller, so they don't remove from one
another; rows with a null id come after every id (ids are below 2^63 - 2^40), ordered by a hash
of their text, and those with equal texts are one document; bytes that aren't UTF-8 are kept as
they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .words import Block, as_strings, blocks, lean, mix, ngrams, ngrams_at

_LAST = (1 << 63) - 1
_SALT = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


class Windows:
    """The windows of ``length`` words inside the texts of a block, with their anchors."""

    def __init__(self, block: Block, length: int, anchor: int):
        self.h, self.length = block.hashes(), length
        self.text_of = np.repeat(np.arange(len(block.bounds) - 1), np.diff(block.bounds))
        low = sliding_min(ngrams(self.h, anchor), length - anchor + 1)
        self.at = np.flatnonzero(self.text_of[: len(low)] == self.text_of[length - 1 :][: len(low)]) if len(low) else np.zeros(0, np.int64)
        self.text, self.anchor = self.text_of[self.at], low[self.at]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor), runs of one anchor once."""
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        return self.text[new], self.anchor[new]

    def keys(self, at: np.ndarray) -> np.ndarray:
        return ngrams_at(self.h, self.length, at)

    def second_keys(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (ngrams_at(mix(self.h + _SALT), self.length, at) >> np.uint64(33)).astype(np.int32)


def tagged(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for (value, text number), to look pairs up at once."""
    with np.errstate(over="ignore"):
        return mix(value.astype(np.uint64) + text.astype(np.uint64) * _SALT)


class Tags:
    """Looks up (value, row) pairs of a list column, for one block of rows at a time."""

    def __init__(self, column: pa.Array):
        column = column.fill_null([]) if column.null_count else column
        self.offsets = np.asarray(column.offsets).astype(np.int64)
        self.values = np.asarray(column.values).view(np.uint64)

    def hits(self, first: int, last: int, value: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether row ``first + text`` has ``value`` in its list."""
        own = self.values[self.offsets[first] : self.offsets[last]]
        out = np.zeros(len(value), dtype=bool)
        if not len(own):
            return out
        row = np.repeat(np.arange(last - first), np.diff(self.offsets[first : last + 1]))
        known = np.sort(tagged(own, row))
        sieve = np.zeros(1 << 20, dtype=bool)
        low = np.uint64((1 << 20) - 1)
        sieve[known & low] = True
        asked = tagged(value, text)
        at = np.flatnonzero(sieve[asked & low])
        found = known[np.minimum(np.searchsorted(known, asked[at]), len(known) - 1)] == asked[at]
        out[at[found]] = True
        return out


def lists(d: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The documents, each once, and each one's values as a list."""
    order = np.argsort(d, kind="stable")
    d, values = d[order], values[order]
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
    return d[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(d)).astype(np.int32)), pa.array(values.view(np.int64)))


def spread(d: np.ndarray) -> np.ndarray:
    """Numbers by which rows that are settled already are dealt to all tasks."""
    return mix(d.astype(np.uint64) + _SALT).view(np.int64)


def _seeds(length: int, anchor: int, hold: int = 1_000_000):
    """Folds the anchors of a chunk: its smallest document for each anchor is to be checked with other
    chunks, every further document is sure to share it. Both come from one pass over one chunk, since
    another run of the plan may cut other chunks."""

    def fold(a: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        a, d = a[new], d[new]
        first = np.ones(len(a), dtype=bool)
        first[1:] = a[1:] != a[:-1]
        many = np.zeros(len(a), dtype=bool)
        many[:-1] = a[1:] == a[:-1]
        own, sure = lists(d[~first], a[~first])
        n, m = int(first.sum()), len(own)
        key = np.concatenate([a[first].view(np.int64), spread(own)])
        none = pa.nulls(n, sure.type)
        return pa.record_batch([pa.array(key), pa.array(np.concatenate([d[first], own])), pa.array(np.append(many[first], np.zeros(m, dtype=bool))), pa.concat_arrays([none, sure])], names=["anchor", "d", "many", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            d = np.asarray(batch.column(0))
            for first, last, block in blocks(batch.column(1)):
                text, a = Windows(block, length, anchor).seeds()
                found.append((a, d[first:last][text]))
                n += len(a)
                if n > hold:
                    yield fold(*map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
        if n:
            yield fold(*map(np.concatenate, zip(*found, strict=True)))

    return run


def _shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, d, many) sorted by anchor: those whose anchor another row has, or many documents of the chunk."""
    last: tuple[int, int, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, d, many = (np.asarray(c) if k < 2 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns))
        if last is not None:
            a, d, many = np.concatenate([[last[0]], a]), np.concatenate([[last[1]], d]), np.concatenate([[last[2]], many])
        keep = many.astype(bool)
        same = a[1:] == a[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        # The last row waits for the next batch; what is known of it stays in its mark.
        last = (a[-1], d[-1], bool(keep[-1]))
        keep = keep[:-1]
        yield pa.record_batch([pa.array(d[:-1][keep], pa.int64()), pa.array(a[:-1][keep], pa.int64())], names=["d", "anchor"])
    if last is not None and last[2]:
        yield pa.record_batch([pa.array([last[1]], pa.int64()), pa.array([last[0]], pa.int64())], names=["d", "anchor"])


def runs(starts: np.ndarray) -> np.ndarray:
    """Consecutive numbers as rows (first, how many)."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int32)
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = np.concatenate([[0], cut])
    return np.stack([starts[first], np.diff(np.concatenate([first, [len(starts)]]))], axis=1).astype(np.int32)


def _with_settled(stream):
    """Runs ``stream`` over the rows whose last column is null and hands (d, that column) of the others on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, kind = [], None

        def rest() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(batch.num_columns - 1)
                known = batch.column(batch.num_columns - 1)
                own = batch.filter(known.is_valid())
                settled.append(pa.record_batch([own.column("d"), pa.nulls(own.num_rows, pa.int64()), own.column(kind.name)], names=["d", "key", kind.name]))
                yield batch.filter(known.is_null()).select(batch.schema.names[:-1])

        for out in stream(rest()):
            yield from settled
            settled.clear()
            yield pa.record_batch([*out.columns, pa.nulls(out.num_rows, kind.type)], names=["d", "key", kind.name])
        yield from settled

    return run


def _extend(length: int, anchor: int, hold: int = 1_000_000):
    """Rows (d, text, id, seeding anchors) to the extended windows of a chunk: those of its smallest document are
    to be checked with other chunks, windows of further documents are repeats already. Both come from one pass."""

    def fold(key, key2, d, row, start, prints) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, key2, key))
        key, key2, d, row, start = key[order], key2[order], d[order], row[order], start[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
        smallest = d[np.flatnonzero(first)][np.cumsum(first) - 1]
        yield pa.record_batch([pa.array(key[first].view(np.int64)), pa.array(key2[first]), pa.array(d[first]), pa.nulls(int(first.sum()), pa.binary())], names=["key", "key2", "d", "known"])
        again = d > smallest
        order = np.lexsort((start[again], row[again]))
        row, start, d = row[again][order], start[again][order], d[again][order]
        cut = np.flatnonzero(np.diff(row)) + 1
        ids, known = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)], strict=True):
            if b > a:
                ids.append(int(d[a]))
                known.append(prints[row[a]] + runs(start[a:b]).tobytes())
        own = np.array(ids, dtype=np.int64)
        yield pa.record_batch([pa.array(spread(own)), pa.array(np.zeros(len(own), np.int32)), pa.array(own), pa.array(known, pa.binary())], names=["key", "key2", "d", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, prints, n = [], [], 0
        for batch in batches:
            d = np.asarray(batch.column(0))
            seeds = Tags(batch.column(3))
            for first, last, block in blocks(batch.column(1)):
                w = Windows(block, length, anchor)
                hit = seeds.hits(first, last, w.anchor, w.text)
                at, text = w.at[hit], w.text[hit]
                own, row = np.unique(text, return_inverse=True)
                parts.append((w.keys(at), w.second_keys(at), d[first:last][text], (row + len(prints)).astype(np.int32), (at - block.bounds[text]).astype(np.int32)))
                prints += [_print(block.text(k)) for k in own.tolist()]
                n += len(at)
                if n > hold:
                    yield from fold(*map(np.concatenate, zip(*parts, strict=True)), prints)
                    parts, prints, n = [], [], 0
        if n:
            yield from fold(*map(np.concatenate, zip(*parts, strict=True)), prints)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, key2, d) sorted: those with a smaller document among the rows of their keys."""
    key = key2 = smallest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, k2, d = (np.asarray(c) for c in batch.columns)
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        low = d[np.flatnonzero(first)][np.cumsum(first) - 1]
        if key is not None and k[0] == key and k2[0] == key2:
            low[: int(np.argmin(np.append(np.cumsum(first) == 1, False)))] = smallest
        key, key2, smallest = k[-1], k2[-1], low[-1]
        again = d > low
        yield pa.record_batch([pa.array(d[again]), pa.array(k[again])], names=["d", "key"])


def _print(text: bytes) -> bytes:
    """What tells the texts of rows with equal ids apart."""
    return xxh64_intdigest(text).to_bytes(8, "little")


def _removed(block: Block, first: int, last: int, repeated: Tags, known: list, length: int) -> np.ndarray:
    """Marks of the words of a block that repeats cover."""
    marks = np.zeros(len(block.starts) + 1, dtype=np.int32)
    if repeated.offsets[last] > repeated.offsets[first]:
        h = block.hashes()
        text_of = np.repeat(np.arange(last - first), np.diff(block.bounds))
        asked = np.diff(repeated.offsets[first : last + 1]) > 0  # only texts with any are looked at
        at = np.flatnonzero((text_of[: 1 - length] == text_of[length - 1 :]) & asked[text_of[: 1 - length]]) if len(h) >= length else np.zeros(0, np.int64)
        at = at[repeated.hits(first, last, ngrams_at(h, length, at), text_of[at])]
        marks += np.bincount(at, minlength=len(marks)).astype(np.int32)
        marks -= np.bincount(at + length, minlength=len(marks)).astype(np.int32)
    for k, own in enumerate(known):
        if own:
            mark = _print(block.text(k))
            for x in own:
                if x[:8] == mark:
                    for start, n in np.frombuffer(x, dtype=np.int32, offset=8).reshape(-1, 2).tolist():
                        marks[block.bounds[k] + start] += 1
                        marks[block.bounds[k] + start + n - 1 + length] -= 1
    return np.cumsum(marks[:-1]) > 0


def _result(length: int):
    spans_type = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans_type), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated = Tags(batch.column(3))
            for first, last, block in blocks(batch.column(1)):
                gone = _removed(block, first, last, repeated, batch.column(4)[first:last].to_pylist(), length)
                n_words, n_removed, spans, kept = np.diff(block.bounds), [], [], []
                for k in range(last - first):
                    own = gone[block.bounds[k] : block.bounds[k + 1]]
                    words = block.text(k).split()
                    if own.any():
                        words = compress(words, (~own).tolist())
                        found = runs(np.flatnonzero(own))
                        found[:, 1] += found[:, 0]
                        spans.append(found.tolist())
                    else:
                        spans.append([])
                    n_removed.append(int(own.sum()))
                    kept.append(b" ".join(words))
                yield pa.record_batch([batch.column(2)[first:last], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_type), as_strings(kept)], schema=schema)

    return run


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, anchor: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words, start and stop), kept_text: one row for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST) - F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1)))
    docs = df.select(d.alias("d"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    texts_of = docs.select("d", "text")

    found = texts_of.mapInArrow(lean(_seeds(length, anchor)), "anchor long, d long, many boolean, sure array<long>")
    found = found.repartition("anchor").sortWithinPartitions("anchor", "d").mapInArrow(lean(_with_settled(_shared_seeds)), "d long, key long, sure array<long>")
    seeds = found.groupBy("d").agg(F.concat(F.collect_list("key"), F.flatten(F.collect_list("sure"))).alias("anchors"))

    # The same columns in both joins, so that they share one exchange of the texts.
    seeded = docs.join(seeds, "d").select("d", "text", "doc_id", "anchors")
    windows = seeded.mapInArrow(lean(_extend(length, anchor)), "key long, key2 int, d long, known binary")
    repeats = windows.repartition("key").sortWithinPartitions("key", "key2", "d").mapInArrow(lean(_with_settled(_repeats)), "d long, key long, known binary")
    repeats = repeats.groupBy("d").agg(F.collect_list("key").alias("keys"), F.collect_list("known").alias("known"))

    out = docs.join(repeats, "d", "left").select("d", "text", "doc_id", "keys", "known")
    return out.mapInArrow(lean(_result(length)), "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string")
