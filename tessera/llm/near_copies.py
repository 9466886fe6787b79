"""Near copies by SimHash and Golay-code fuzzy hashing, verified by the similarity of the shingles.

``simhash.classes`` links digests at two differing bits; this is the same method for texts whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more, whose digests differ in more:

* Texts with the same lower-cased words are one node. Its shingles give a SimHash of 424 bits:
  eight pairs of 23-bit segments, and 56 bits to check candidates with.
* Each segment is decoded to the indices of the Golay codewords within four bits of it (one or
  six). A pair of segments gives up to 36 keys, one for each pair of indices. Two segments at most
  two bits apart always share an index, so by the pigeonhole principle nodes whose eight
  pairs differ in up to 23 bits always share a key; at similarity 0.8 (about 56 bits) they do with
  probability 0.97, at 0.9 with 0.9996. Copies of copies are linked over one another, too.
* Nodes of a key whose check bits differ in at most 16 places and whose sizes allow the similarity are
  candidates. A key of two nodes gives its pair; a larger one links each node to the key's smallest
  only, its hub, and marks its nodes as open if they have a candidate there. An open node is
  verified with its 12 smallest hubs at first, which its group shares, and then with
  four nodes in the middle of each hub's class.
* Candidates are verified by the similarity itself, so no pair below it links. Then open nodes
  of different classes are paired exactly: two sets this similar share one of the rarest shingles of
  either (the prefix filter, with sizes and positions), and their parity maps differ in no more bits than the
  sets may differ in shingles (each shingle flips one bit of its set's map, so the differing bits are a lower
  bound). So large keys lose no link to their stars, and a group of n copies costs pairs in n, not in its square.

Components of the links are the classes; the row with the class's smallest id stays.

Scale: the keys are about 230 rows of 24 bytes a node, shuffled once and read as a sorted stream. Texts are
shuffled for candidates and for rows that may go only, chosen by a bit map of fixed size (1 MB). The
order of shingles by rarity uses 2^16 counters, a fixed size too; any order is exact.
Key space: 2^24 for each pair of segments, so among n distinct texts a key holds n / 600,000 by
chance, whose check bits are compared without leaving the stream; beyond some 10^8 distinct texts
keys of three segments would be better.

Defined cases: a null or empty text, or one of separators only, has one shingle, like any text of
fewer than five words; a null id is larger than every id, and a node of null ids only stays; rows with
equal ids stay together; equal 64-bit hashes of the words count as equal texts; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, components, delete, write
from .simhash import codewords
from .words import Block, lean, mix, ngrams, pieces, utf8

WORDS, SIMILARITY = 5, 0.8
SEGMENTS, WIDTH, CHECK = 16, 23, 56
#: Check bits in which candidates may differ: 16 leaves out one pair in 300 at similarity 0.8, 99.9 % of random pairs.
APART = 16
_N_HASHES = 7
#: Hubs that an open node is verified with at first; the prefix filter finds all its other links.
HUBS = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(805).integers(1, 2**63, size=_N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTE = np.uint64(255)
_COUNTERS = 1 << 16
_MAP_BITS = 1 << 23
#: Words of 64 bits in a set's parity map.
_PARITY = 4


def _texts(column: pa.Array) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """For each text a hash of its lower-cased words and the set of its shingles' hashes, sorted."""
    data, offsets = utf8(column)
    for first, last in pieces(column):
        block = Block(_LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
        h = block.hashes()
        every = ngrams(h, WORDS)
        with np.errstate(over="ignore"):
            for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
                node = mix(np.array([mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * _SALT).sum(dtype=np.uint64)], dtype=np.uint64))
                yield node[0], np.unique(every[a : b - WORDS + 1]) if b - a >= WORDS else node


def fingerprint(shingles: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """The segments of a set's SimHash, and its check bits above a byte for the logarithm of its size."""
    counts = np.zeros(64 * _N_HASHES, dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            h = mix(shingles[at : at + 4096, None] * _ODD)
            counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = 2 * counts > len(shingles)
    segments = bits[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH) @ (1 << np.arange(WIDTH))
    check = bits[SEGMENTS * WIDTH :][:CHECK] @ (1 << np.arange(CHECK, dtype=np.uint64))
    return segments, (np.uint64(check) << np.uint64(8)) | np.uint64(min(255, int(8 * np.log2(len(shingles)))))


def golay_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for rows of segments."""
    index = codewords(segments.ravel()).reshape(len(segments), SEGMENTS // 2, 2, 6)
    one, two = index[:, :, 0, :, None], index[:, :, 1, None, :]
    pair = np.arange(SEGMENTS // 2)[None, :, None, None]
    key = pair << 24 | np.maximum(one, 0) << 12 | np.maximum(two, 0)
    found = (one >= 0) & (two >= 0)
    return key[found], np.nonzero(found)[0]


def _may_match(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the check bits and the sizes of two rows allow the similarity."""
    near = np.bitwise_count((x ^ y) >> np.uint64(8)) <= APART
    m, n = (x & _LOW_BYTE).astype(np.int16), (y & _LOW_BYTE).astype(np.int16)
    return near & (np.abs(m - n) <= 3)  # log2(1 / 0.8) is 2.6 eighths


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in pieces(batch.column(1), 4 << 20):
            nodes, segments, checks = [], [], []
            for node, shingles in _texts(batch.column(1)[first:last]):
                own, check = fingerprint(shingles)
                nodes.append(node)
                segments.append(own.astype(np.int32).tobytes())
                checks.append(check)
            numbers = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, checks)]
            yield pa.record_batch([batch.column(0)[first:last], numbers[0], pa.array(segments, pa.binary()), numbers[1]], names=["doc_id", "node", "segments", "sum"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            segments = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int32).reshape(-1, SEGMENTS).astype(np.int64)
            key, row = golay_keys(segments)
            rows = pa.array(row)
            yield pa.record_batch([pa.array(key), part.column(0).take(rows), part.column(2).take(rows)], names=["key", "node", "sum"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in pieces(batch.column(0), 4 << 20):
            found = list(_texts(batch.column(0)[first:last]))
            nodes = np.array([node for node, _ in found], dtype=np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
            values = np.concatenate([s for _, s in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(nodes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "shingles"])


def _candidates(most: int = 2, hold: int = 1 << 19, before: int = 0, dense: int = 4096):
    """Rows (key, node, sum) sorted by key and node: candidate pairs (a, b, false), stars (hub, node, true), open nodes (a, null, true)."""

    def pairs(key: np.ndarray, node: np.ndarray, sums: np.ndarray, hub: tuple | None) -> pa.RecordBatch:
        new = np.append(True, key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        length = np.bincount(run)[run]
        a, b, hubs, rays, marked = [], [], [], [], np.zeros(len(key), dtype=bool)
        step = 1
        while step < len(key) and (step < most or hub):
            same = key[step:] == key[:-step]
            if not same.any() or (hub and step > before):
                break
            at = np.flatnonzero(same & ((length[step:] <= most) | (step <= before)))
            at = at[_may_match(sums[at], sums[at + step])]
            a.append(node[at])
            b.append(node[at + step])
            step += 1
        starts = np.flatnonzero(new)
        for first, n in zip(starts.tolist(), np.diff(np.append(starts, len(key))).tolist(), strict=True):
            if n <= most and not hub:
                continue
            own, sums_of = node[first : first + n], sums[first : first + n]
            low, low_sum = hub or (own[0], sums_of[0])
            near = _may_match(sums_of, low_sum) & (own != low)
            hubs.append(np.full(int(near.sum()), low))
            rays.append(own[near])
            if n > dense or hub:
                marked[first : first + n] = True
                continue
            for at in range(0, n, 256):
                matches = _may_match(sums_of[at : at + 256, None], sums_of[None, :]).sum(axis=1) > 1
                marked[first + at : first + at + len(matches)] = matches
        opened = np.unique(np.concatenate([node[marked], *hubs, *rays]))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        star = np.unique(np.stack([np.concatenate(hubs), np.concatenate(rays)], axis=1), axis=0) if hubs else np.zeros((0, 2), np.int64)
        left = np.concatenate([np.minimum(both[:, 0], both[:, 1]), star[:, 0], opened])
        right = np.concatenate([np.maximum(both[:, 0], both[:, 1]), star[:, 1], np.zeros(len(opened), np.int64)])
        of_star = np.arange(len(left)) >= len(both)
        return pa.record_batch([pa.array(left), pa.array(right, mask=np.arange(len(left)) >= len(both) + len(star)), pa.array(of_star)], names=["a", "b", "star"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, sums, hub = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key, node = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([node, np.asarray(batch.column(1))])
            sums = np.concatenate([sums, np.asarray(batch.column(2)).view(np.uint64)])
            if hub and len(key) and key[0] != key[-1]:  # a key that was begun ends here
                cut = int(np.searchsorted(key, key[0], side="right"))
                yield pairs(key[:cut], node[:cut], sums[:cut], hub)
                key, node, sums, hub = key[cut:], node[cut:], sums[cut:], None
            if len(key) > hold:
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if not cut:  # one key fills the buffer: its first rows go, its smallest node stays known
                    hub = hub or (node[0], sums[0])
                    yield pairs(key, node, sums, hub)
                    cut = len(key) - before
                else:
                    yield pairs(key[:cut], node[:cut], sums[:cut], None)
                key, node, sums = key[cut:], node[cut:], sums[cut:]
        if len(key):
            yield pairs(key, node, sums, hub)

    return run


def bit_map(ids: DataFrame) -> DataFrame:
    """(word, bits): the ids (column id) in a map of fixed size, to be broadcast; other ids may fall on its bits."""
    place = F.pmod(F.xxhash64("id"), F.lit(_MAP_BITS))
    words = ids.select((place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("place"))
    return words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))


def in_map(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with a column id) with a column in_map, false only if the id isn't in the map. No shuffle."""
    place = F.pmod(F.xxhash64("id"), F.lit(_MAP_BITS))
    joined = rows.withColumn("word", (place / 64).cast("int")).withColumn("place", (place % 64).cast("int")).join(F.broadcast(found), "word", "left")
    hit = F.coalesce(F.expr("getbit(bits, place)") == 1, F.lit(False))
    return joined.withColumn("in_map", hit).drop("word", "place", "bits")


def _sets_of(nodes: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) of ``nodes``: only their texts are read for it."""
    ids = checkpoint(first.join(nodes, "node").select(F.col("first_id").alias("id")).distinct())
    some = in_map(texts.select(F.col("doc_id").alias("id"), "text"), checkpoint(bit_map(ids))).filter("in_map")
    own = some.join(ids.withColumnRenamed("id", "wanted"), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(lean(_sets), "node long, shingles array<long>")
    # Cut off here, so that the joins have plain exchanges on both sides and Spark may split a node of many pairs.
    return checkpoint(own.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))


def _verified(pairs: DataFrame, sets: DataFrame, written: list[str]) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough; ``written`` gets the folder that holds them."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    m, n = F.size("s"), F.size("t")
    # A set of less than 0.8 of the other's size can't be similar enough.
    fit = (F.col("b") == F.col("other")) & (F.least(m, n) >= SIMILARITY * F.greatest(m, n) - 1e-9)
    sized = pairs.join(one, "a").join(two.withColumnRenamed("b", "other"), fit)
    both = sized.select("a", "b", m.alias("m"), n.alias("n"), F.size(F.array_intersect("s", "t")).alias("common"))
    near = both.filter(F.col("common") >= SIMILARITY * (F.col("m") + F.col("n") - F.col("common")) - 1e-9).select("a", "b")
    # Not a checkpoint: that would keep the partitioning of the joins, which doubles in each round of the components.
    written.append(write(near))
    return pairs.sparkSession.read.parquet(written[-1])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_COUNTERS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(np.asarray(batch.column(0).flatten()) & (_COUNTERS - 1), minlength=_COUNTERS)
    place = np.flatnonzero(total)
    yield pa.record_batch([pa.array(place), pa.array(total[place])], names=["place", "n"])


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity map of a set: bit k tells whether an odd number of its shingles fall on k."""
    with np.errstate(over="ignore"):
        place = (mix(shingles.view(np.uint64) * _ODD[0]) % np.uint64(64 * _PARITY)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * _PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _prefixes(frequency: np.ndarray):
    """The rarest shingles of a set, of which it must share one with any set similar enough, each with the set's size and map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column(2)
            values, offsets = np.asarray(shingles.values), np.asarray(shingles.offsets)
            token, at, row, size, maps = [], [], [], [], []
            for k in range(batch.num_rows):
                own = values[offsets[k] : offsets[k + 1]]
                own = own[np.lexsort((own, frequency[own & (_COUNTERS - 1)]))]
                n = len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1
                token.append(own[:n])
                at.append(np.arange(n))
                row.append(np.full(n, k))
                size.append(np.full(n, len(own)))
                maps.append(parity(own))
            if row:
                rows = pa.array(np.concatenate(row))
                of_rows = np.stack(maps)[np.concatenate(row)]
                columns = [pa.array(np.concatenate(token)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32))]
                yield pa.record_batch(columns + [pa.array(of_rows[:, k]) for k in range(_PARITY)], names=["token", "node", "root", "at", "n", *(f"map{k}" for k in range(_PARITY))])

    return run


def _exact_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of ``sets`` with different roots that may be similar enough; none that is gets lost."""
    counts = sets.select("shingles").mapInArrow(lean(_counters), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # at most 2^16 rows
    frequency = np.zeros(_COUNTERS, dtype=np.int64)
    for r in counts:
        frequency[r.place] = r.n
    labelled = sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles")
    # Cut off here, so that Spark may split a shingle that very many prefixes have.
    rows = checkpoint(labelled.mapInArrow(lean(_prefixes(frequency)), "token long, node long, root long, at int, n int, " + ", ".join(f"map{k} long" for k in range(_PARITY))))
    one = rows.select("token", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("at").alias("i"), F.col("n").alias("m"), *[F.col(f"map{k}").alias(f"one{k}") for k in range(_PARITY)])
    two = rows.select("token", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("at").alias("j"), "n", *[F.col(f"map{k}").alias(f"two{k}") for k in range(_PARITY)])
    needed = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("m") + F.col("n")) - 1e-9)
    reach = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"one{k}").bitwiseXOR(F.col(f"two{k}"))) for k in range(_PARITY)])
    fits = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (F.least("m", "n") >= SIMILARITY * F.greatest("m", "n") - 1e-9) & (reach >= needed) & (apart <= F.col("m") + F.col("n") - 2 * needed)
    return one.join(two, "token").filter(fits).select("a", "b").distinct()


def _best_hubs(stars: DataFrame, near: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): each node that isn't in the class of its hub, with the four nodes of that class that are linked to most of their hubs.

    All nodes of a group are tried with as many hubs, so these four lie in its middle.
    """
    tried = near.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    best = tried.join(roots, "node").groupBy("root", F.pmod("node", F.lit(4)).alias("part")).agg(F.max_by("node", F.struct("n", "node")).alias("best"))
    hubs = roots.join(best.groupBy("root").agg(F.collect_list("best").alias("best")), "root").select(F.col("node").alias("a"), F.col("root").alias("root_a"), "best")
    own = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    apart = stars.join(hubs, "a").join(own, "b", "left").filter("root_b IS NULL OR root_a <> root_b")
    return apart.select(F.explode("best").alias("best"), "b").select(F.least("best", "b").alias("a"), F.greatest("best", "b").alias("b")).distinct()


def links(first: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Verified pairs (a, b) that connect every class of the nodes in ``first`` (node, first_id, segments, sum), and the folders they lie in."""
    written: list[str] = []
    rows = first.select("node", "segments", "sum").mapInArrow(lean(_keys), "key long, node long, sum long")
    found = checkpoint(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(_candidates()), "a long, b long, star boolean").distinct())
    opened = found.filter("b IS NULL").select(F.col("a").alias("node"))
    # Of its hubs a node is verified with the smallest only, which most of its group share; it is open for the rest.
    stars = found.filter("star AND b IS NOT NULL").groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, HUBS).alias("hubs")).select(F.explode("hubs").alias("a"), "b")
    stars = checkpoint(stars)
    pairs = checkpoint(found.filter("NOT star").select("a", "b").union(stars).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(opened).distinct()
    sets = _sets_of(nodes, first, texts)
    near = _verified(pairs, sets, written)
    if opened.isEmpty():
        return near, written
    more = checkpoint(_best_hubs(stars, near, components(near)).join(pairs, ["a", "b"], "left_anti"))
    near, pairs = near.union(_verified(more, sets, written)), pairs.union(more)
    others = checkpoint(_exact_pairs(sets.join(opened, "node", "left_semi"), components(near)).join(pairs, ["a", "b"], "left_anti"))
    return near if others.isEmpty() else near.union(_verified(others, sets, written)), written


def near_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their class, with all their columns."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = checkpoint(texts.mapInArrow(lean(_nodes), "doc_id long, node long, segments binary, sum long"))
    first = checkpoint(docs.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("segments").alias("segments"), F.first("sum").alias("sum")))
    near, written = links(first, texts)
    roots = components(near)
    ids = first.select("node", "first_id")
    linked = checkpoint(ids.join(roots, "node").select("node", "root", "first_id"))
    for path in written:  # the classes are known
        delete(df.sparkSession, path)
    # A node of null ids only has no id of its own; it is kept unless it is linked to one that has.
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    lost = linked.join(smallest, "root").filter(~F.col("first_id").eqNullSafe(F.col("class_id"))).select("node")
    kept = ids.join(lost, "node", "left_anti").select(F.col("first_id").alias("kept"))
    ids_gone = checkpoint(docs.select(F.col("doc_id").alias("id")).distinct().join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_anti"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = in_map(df.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id")), checkpoint(bit_map(ids_gone)))
    some = rows.filter("in_map").join(ids_gone.withColumnRenamed("id", "lost"), F.col("id").eqNullSafe(F.col("lost")), "left_anti")
    out = rows.filter("NOT in_map").select("row").union(some.select("row"))
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns])
