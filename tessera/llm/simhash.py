"""Near-duplicate classes by SimHash and Golay-code fuzzy hashing.

A text's fingerprint has a bit where over half of the XXH64 hashes of its shingles have it.
Fingerprints at two or fewer differing bits are linked. Finding the links:

* A fingerprint has three segments of 22, 21 and 21 bits. Of two differing bits at least one
  segment has none, so some segment i is equal while the next segment j has at most two.
* The perfect binary Golay code (23, 12, 7) maps segment j to the indices of the codewords
  within four bits: one, or six where the nearest is three bits away. Two words at most two
  bits apart always share such a codeword.
* So each fingerprint has 3 to 18 keys (i, segment i, codeword index of segment j), and linked
  fingerprints share a key. Keys are joined and the candidates verified.

Only distinct fingerprints take part, so exact copies cost nothing. Keys with more than
``bucket`` fingerprints aren't paired: all their fingerprints emit the 65 words within one bit;
two fingerprints are linked exactly if they share such a word, and those that share one are all
linked, so a star to the smallest is enough. A group has at most 65 members. Both ways are
exact; no pair is lost and none is listed twice over.

``near_copies`` removes copies by the same codes at a similarity of 0.8.

Components of the links then give the classes; the class id is its smallest doc_id.

Defined cases: a null or empty text, or one of separators only, has fingerprint zero, linked
like any other; a null id is kept and gets its class's id, null if no row of the class has an
id; repeated rows are in the same class; an empty table gives an empty result; extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import checkpoint, components
from .words import lean, pieces, texts

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GENERATOR = 0b101011100011  # of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; zero without words."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), seed)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(parts) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the bits, and for each remainder the error patterns of up to four bits (-1: none), and their number."""
    remainders = np.zeros(23, dtype=np.int64)
    for bit in range(23):
        value = 1 << bit
        for k in range(22, 10, -1):
            if value >> k & 1:
                value ^= _GENERATOR << (k - 11)
        remainders[bit] = value
    patterns: list[list[int]] = [[] for _ in range(2048)]
    weights = [9] * 2048
    for n in range(5):
        for bits in combinations(range(23), n):
            at = int(np.bitwise_xor.reduce(remainders[list(bits)])) if bits else 0
            weights[at] = min(weights[at], n)
            if n == weights[at] or (n == 4 and weights[at] == 3):
                patterns[at].append(sum(1 << b for b in bits))
    table = np.full((2048, 6), -1, dtype=np.int64)
    for at, found in enumerate(patterns):
        table[at, : len(found)] = found
    return remainders, table, np.array([len(p) for p in patterns])


def codewords(segment: np.ndarray) -> np.ndarray:
    """For each word of up to 23 bits the indices (12 bits) of the codewords near it; -1 fills up to six."""
    remainders, table, _ = golay()
    syndrome = np.zeros(len(segment), dtype=np.int64)
    for bit in range(23):
        syndrome ^= np.where(segment >> bit & 1, remainders[bit], 0)
    errors = table[syndrome]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fp``) for every key of the fingerprints (uint64)."""
    parts = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in _SEGMENTS]
    found, rows = [], []
    for i in range(3):
        index = codewords(parts[(i + 1) % 3])
        key = (np.int64(i) << 34) | (parts[i][:, None] << 12) | np.maximum(index, 0)
        row, column = np.nonzero(index >= 0)
        found.append(key[row, column])
        rows.append(row)
    return np.concatenate(found), np.concatenate(rows)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in pieces(batch.column(1), 4 << 20):
            found = np.array([fingerprint(t) for t in texts(batch.column(1)[first:last])], dtype=np.uint64)
            yield pa.record_batch([batch.column(0)[first:last], pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        found, rows = keys(fp)
        yield pa.record_batch([pa.array(found), pa.array(fp[rows].view(np.int64))], names=["key", "fp"])


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of some links, as (node, root) rows."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    rows = [(x, root) for x in list(parent) if (root := find(x)) != x]
    return pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def _verify(bits: int, hold: int = 1 << 19):
    """Rows (key, fp) sorted by key, each key's rows together and bounded: links of a spanning forest."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b, step = [], [], 1
        wide = fp.view(np.uint64)
        while step < len(key) and (same := key[step:] == key[:-step]).any():
            at = np.flatnonzero(same)
            near = at[np.bitwise_count(wide[at] ^ wide[at + step]) <= bits]
            a.append(fp[near])
            b.append(fp[near + step])
            step += 1
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        return _forest(pairs[:, 0], pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, fp = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([fp, np.asarray(batch.column(1))])
            if len(key) > hold:
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield links(key[:cut], fp[:cut])
                    key, fp = key[cut:], fp[cut:]
        yield links(key, fp)

    return run


def _within_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        yield pa.record_batch([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, 65).view(np.int64))], names=["word", "fp"])


def links(fps: DataFrame, *, bits: int = 2, bucket: int = 64) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links to connect every class."""
    if bits != 2:
        raise ValueError("the keys and the stars are made for links of at most two differing bits")
    all_keys = fps.select("fp").mapInArrow(lean(_keys), "key long, fp long")
    shared = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = checkpoint(all_keys.join(shared, "key"))
    cold = rows.filter(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(_verify(bits)), "a long, b long")
    near = rows.filter(F.col("n") > bucket).select("fp").distinct().mapInArrow(lean(_within_one), "word long, fp long")
    stars = near.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    hot = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b").distinct()
    return cold.union(hot)


def classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, bucket: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row for each row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = checkpoint(rows.mapInArrow(lean(_fingerprints), "doc_id long, fp long"))
    first = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first, bits=bits, bucket=bucket))
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_linked = linked.join(smallest, "root").select(F.col("node").alias("fp"), "class_id")
    # Cut off here, so that both sides of the last join are plain exchanges and Spark may split a hot fingerprint's rows.
    ids = checkpoint(first.join(of_linked, "fp", "left").select("fp", F.coalesce("class_id", "first_id").alias("component_id")))
    return docs.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

