"""Fill-in-the-middle: texts cut at two places between units, and put together in another order.

A unit is a word with the white space before it, or the white space at the end. The cuts are ranks of
units drawn from a hash of the document's id, so they need the number of units first. One automaton over
UTF-8 bytes counts ends of words and finds the marks ``<P>``, ``<S>``, ``<M>``:

1. every chunk of a text gives its function (state reached and events seen, from each state);
2. the functions of a text compose in order: units, marks, and the state and events before each chunk;
3. the chunk that holds a cut is chosen by the events before it, and the cut is found in that chunk only.

A text of one chunk does all three in its own row. The chunks of a longer one are dealt out over the
cluster as rows, their functions meet by the text's digest, and the cuts are joined back; nothing but
functions and cuts is gathered for a text, and the same code scans both kinds.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark, is plain; a null id
draws from the empty string; repeated rows give the same result each; an empty table gives an empty
result; extra columns are left out, whatever their names; bytes that aren't UTF-8 stay as they are and count
as characters the way Spark counts them. Equal digests (SHA-256 of id and text) count as equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Scan
from .shared import checkpoint
from .words import IS_SPACE, lean, pieces, utf8

# The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
_UNIT, _MARK = 0, 1
_SPACE, _WORD, _OPEN, _NAMED = range(4)  # in white space; in a word; after "<"; after "<P", "<S" or "<M"


def units_and_marks() -> Automaton:
    """Event 0 ends a word (at the white space after it), event 1 completes a mark."""
    to = np.full((4, 256), _WORD)
    to[:, ord("<")] = _OPEN
    to[_OPEN, [ord(x) for x in "PSM"]] = _NAMED
    to[:, IS_SPACE] = _SPACE
    emits = np.zeros((2, 4, 256), dtype=bool)
    emits[_UNIT, _WORD:] = IS_SPACE
    emits[_MARK, _NAMED, ord(">")] = True
    return Automaton(to, emits)


_MACHINE = units_and_marks()
_CUTS = "struct<n:bigint,marked:boolean,a:bigint,b:bigint>"
_FUNCTION = "struct<to:array<int>,units:array<bigint>,marks:array<bigint>>"


def _scans(column: pa.Array):
    """The column's texts a bounded number of bytes at a time: first row, end row, their scan."""
    data, offsets = utf8(column)
    for first, last in pieces(column):
        yield first, last, Scan(_MACHINE, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _position(scan: Scan, text: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return scan.nth_event(_UNIT, text, state, rank)


def _cuts(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Units, marks and both cuts, in bytes, of whole texts."""
    n, marked, cut = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.zeros((2, len(texts)), np.int64)
    for first, last, scan in _scans(texts):
        sizes = np.diff(scan.offsets)
        _, counts = scan.functions()
        here = slice(first, last)
        n[here], marked[here] = counts[_UNIT, _SPACE] + (sizes > 0), counts[_MARK, _SPACE] > 0
        drawn = np.sort(np.stack([np.asarray(x)[here] % (n[here] + 1) for x in (low, high)]), axis=0)
        for k, rank in enumerate(drawn):
            inner = np.flatnonzero((rank > 0) & (rank < n[here]))
            at = np.where(rank >= n[here], sizes, 0)
            at[inner] = _position(scan, inner, np.zeros(len(inner), np.int64), rank[inner])
            cut[k, here] = at
    return pa.StructArray.from_arrays([pa.array(n), pa.array(marked), pa.array(cut[0]), pa.array(cut[1])], names=["n", "marked", "a", "b"])


def _functions(chunks: pa.Array) -> pa.Array:
    """The function of each chunk."""
    to, counts = [], [[], []]
    for _, _, scan in _scans(chunks):
        lead, seen = scan.functions()
        to.append(lead.T.astype(np.int32))
        for kind in (_UNIT, _MARK):
            counts[kind].append(seen[kind].T)
    wide = lambda parts, kind: pa.FixedSizeListArray.from_arrays(pa.array((np.concatenate(parts) if parts else np.zeros((0, 4))).ravel(), kind), 4).cast(pa.list_(kind))
    return pa.StructArray.from_arrays([wide(to, pa.int32()), wide(counts[0], pa.int64()), wide(counts[1], pa.int64())], names=["to", "units", "marks"])


def _select(chunks: pa.Array, state: pa.Array, rank: pa.Array) -> pa.Array:
    """Where in its chunk the unit of number ``rank`` ends; 0 for rank 0."""
    out, states, ranks = np.zeros(len(chunks), np.int64), np.asarray(state), np.asarray(rank)
    for first, last, scan in _scans(chunks):
        some = np.flatnonzero(ranks[first:last] > 0)
        out[first + some] = _position(scan, some, states[first + some], ranks[first + some])
    return pa.array(out)


def _udf(function, kind: str):
    """An Arrow UDF of batches; built where it is used, as it needs a session."""

    def run(batches):
        for args in batches:
            yield function(*args)

    def single(batches):
        for arg in batches:
            yield function(arg)

    from collections.abc import Iterator

    one = function.__code__.co_argcount == 1
    chosen = single if one else run
    chosen.__annotations__ = {"batches": Iterator[pa.Array] if one else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(lean(chosen), kind)


def draw(doc_id: Column, seed: int, group: int) -> Column:
    """The unsigned integer of an 8-digit group (from 0) of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _long_cuts(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (key, bytes, h1, h2, ...) of long texts with their cuts, found by chunks that are dealt out as rows."""
    count = ((F.octet_length("bytes") - 1) / chunk).cast("long")
    cut_up = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: F.struct(k.alias("no"), F.substring(F.col("bytes"), (k * chunk + 1).cast("int"), F.lit(chunk)).alias("piece")))
    dealt = rows.select("key", F.explode(cut_up).alias("c")).select("key", "c.no", "c.piece").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = dealt.select("key", F.struct("no", _udf(_functions, _FUNCTION)("piece").alias("f")).alias("part"))
    composed = scanned.groupBy("key").agg(F.array_sort(F.collect_set("part")).alias("parts"))  # repeated rows fold into one

    zero = F.lit(0).cast("long")
    begin = F.struct(F.lit(_SPACE).alias("state"), zero.alias("units"), zero.alias("marks"))
    walked = lambda s, f: (F.element_at(f["to"], s["state"] + 1).alias("state"), (s["units"] + F.element_at(f["units"], s["state"] + 1)).alias("units"), (s["marks"] + F.element_at(f["marks"], s["state"] + 1)).alias("marks"))
    total = F.aggregate("parts", begin, lambda s, p: F.struct(*walked(s, p["f"])))

    def holder(rank: Column) -> Column:
        """The first chunk with that many units before its end, the state it is entered in, and the rank inside it."""
        none = F.struct(F.lit(-1).cast("long").alias("no"), F.lit(0).alias("state"), zero.alias("rank"))
        start = F.struct(F.lit(_SPACE).alias("state"), zero.alias("units"), zero.alias("marks"), none.alias("found"))

        def step(s: Column, p: Column) -> Column:
            after = s["units"] + F.element_at(p["f"]["units"], s["state"] + 1)
            here = F.struct(p["no"].alias("no"), s["state"].alias("state"), (rank - s["units"]).alias("rank"))
            return F.struct(*walked(s, p["f"]), F.when((s["found"]["no"] < 0) & (after >= rank), here).otherwise(s["found"]).alias("found"))

        return F.aggregate("parts", start, step, lambda s: s["found"])

    drawn = rows.select("key", "h1", "h2").distinct()
    known = composed.join(drawn, "key").withColumn("total", total).withColumn("n", F.col("total.units") + 1)
    ranks = [F.least(F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)), F.greatest(F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1))]
    known = known.select("key", "n", (F.col("total.marks") > 0).alias("marked"), ranks[0].alias("rank_a"), ranks[1].alias("rank_b"), "parts")
    known = checkpoint(known.select("key", "n", "marked", "rank_a", "rank_b", holder(F.col("rank_a")).alias("in_a"), holder(F.col("rank_b")).alias("in_b")))

    select = _udf(_select, "bigint")
    both = rows.join(known, "key")

    def cut(name: str) -> Column:
        inside, rank, size = F.col(f"in_{name}"), F.col(f"rank_{name}"), F.octet_length("bytes").cast("long")
        inner = (rank > 0) & (rank < F.col("n"))
        place = F.greatest(inside["no"], zero) * chunk
        found = select(F.substring(F.col("bytes"), (place + 1).cast("int"), F.when(inner, F.lit(chunk)).otherwise(0)), inside["state"], F.when(inner, inside["rank"]).otherwise(0).cast("long"))
        return F.when(rank == 0, zero).when(rank >= F.col("n"), size).otherwise(place + found).alias(name)

    return both.select(*rows.columns, F.struct("n", "marked", cut("a"), cut("b")).alias("cuts"))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: ``rate`` of a hundred texts are cut up,
    ``suffix_first`` of a hundred of these with the suffix first (spm), the others prefix first (psm)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    own = own.select("doc_id", "bytes", *[draw(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)])
    short, long = own.filter(F.octet_length("bytes") <= chunk), own.filter(F.octet_length("bytes") > chunk)
    rows = short.withColumn("cuts", _udf(_cuts, _CUTS)("bytes", "h1", "h2"))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), "bytes"), 256)
    rows = rows.unionByName(_long_cuts(long.withColumn("key", key), chunk).drop("key"))

    a, b, size = F.col("cuts.a").cast("int"), F.col("cuts.b").cast("int"), F.octet_length("bytes")
    part = lambda start, length: F.substring(F.col("bytes"), start, length)
    prefix, middle, suffix = part(F.lit(1), a), part(a + 1, b - a), part(b + 1, size - b)
    mark = lambda x: F.lit(bytearray(x.encode()))
    form = F.when((size == 0) | F.col("cuts.marked") | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", F.col("bytes"))
        .when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
        .otherwise(F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle))
    )
    chars = lambda x: F.when(F.col("form") != "plain", F.length(x.cast("string")).cast("long"))
    return rows.select("doc_id", F.col("cuts.n").alias("n"), "form", chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Each mark stands in a cut-up text once, so what lies between two is a part."""
    between = lambda after, before: F.substring_index(F.substring_index(output, before, 1) if before else output, after, -1)
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
