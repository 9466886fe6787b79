"""Exact deduplication by Grace hashing.

Map side: each task folds equal contents together in bounded chunks, so a group of copies
that holds a third of the corpus sends one record for each chunk, not one for each row.
Shuffle: records are dealt by digest, the first level of the partitioning. Reduce side: a
task builds an open-addressing table that compares complete contents; if the table would
outgrow its budget, the task partitions its records into anonymous scratch files by the
next byte of the digest and treats each file in the same way, recursively. Scratch files
belong to one task attempt and vanish with it; a lost executor only means a retried task.

Defined cases: a null text counts as empty, and empty texts are equal to one another; a
null id sorts after every id, so it stays only if no copy has an id; of several rows with
the smallest id exactly one stays; an empty table gives an empty result; extra columns
don't matter to ``exact_groups`` and are carried by ``exact_dedup``; bytes that aren't UTF-8
stay as they are, in texts and in further string columns. The tables tell contents with one
SHA-256 digest apart, but ``exact_groups`` leads rows to their groups by that digest: there it decides.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .words import SPACES, lean, texts

NO_ID = (1 << 63) - 1  # stands for a null id: after every other


def normalise(text: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; runs at either end stay as one."""
    words = text.split()  # on exactly these six bytes
    out = b" ".join(words)
    if not words:
        return b" " if text else b""
    if text[0] in SPACES:
        out = b" " + out
    return out + b" " if text[-1] in SPACES else out


class Table:
    """Open addressing with linear probing; an entry is found by comparing whole contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.payloads: list[bytes | None] = []
        self.size = 0

    def add(self, digest: bytes, content: bytes, row_id: int, count: int, payload: bytes | None = None) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                self.counts[entry] += count
                if row_id < self.ids[entry]:
                    self.size += len(payload or b"") - len(self.payloads[entry] or b"")
                    self.ids[entry], self.payloads[entry] = row_id, payload
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.ids)
        self._append(digest, content, row_id, count, payload)
        if 3 * len(self.ids) > 2 * len(self.slots):
            self._grow()

    def _append(self, digest: bytes, content: bytes, row_id: int, count: int, payload: bytes | None) -> None:
        self.digests.append(digest)
        self.contents.append(content)
        self.ids.append(row_id)
        self.counts.append(count)
        self.payloads.append(payload)
        self.size += len(content) + len(payload or b"") + 200

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self) -> Iterator[tuple[bytes, bytes, int, int, bytes | None]]:
        return zip(self.digests, self.contents, self.ids, self.counts, self.payloads, strict=True)


_HEAD = struct.Struct("<32sqqqq")


def _write(to: BinaryIO, row: tuple) -> None:
    digest, content, row_id, count, payload = row
    to.write(_HEAD.pack(digest, row_id, count, len(content), -1 if payload is None else len(payload)))
    to.write(content)
    if payload:
        to.write(payload)


def _read(spill: BinaryIO) -> Iterator[tuple]:
    spill.seek(0)
    while head := spill.read(_HEAD.size):
        digest, row_id, count, n, m = _HEAD.unpack(head)
        content = spill.read(n)
        yield digest, content, row_id, count, None if m < 0 else spill.read(m)


def grace(rows: Iterable[tuple], budget: int, level: int = 0, fan: int = 16) -> Iterator[Table]:
    """Tables of at most about ``budget`` bytes that together hold the groups of all rows."""
    table, spills = Table(), []
    for row in rows:
        if spills:
            _write(spills[(row[0][level] ^ level) % fan], row)
            continue
        table.add(*row)
        if table.size > budget and len(table) > 1 and level < 30:
            spills = [tempfile.TemporaryFile() for _ in range(fan)]
            for old in table.rows():
                _write(spills[(old[0][level] ^ level) % fan], old)
            table = Table()
    if not spills:
        yield table
        return
    for k in range(fan):
        with spills[k] as spill:
            yield from grace(_read(spill), budget, level + 1, fan)


def _id(value: int | None) -> int:
    return NO_ID if value is None else value


def _raw(column: pa.Array) -> pa.Array:
    """A string column as bytes, any other as it is."""
    if pa.types.is_string(column.type):
        return column.view(pa.binary())
    return column.view(pa.large_binary()) if pa.types.is_large_string(column.type) else column


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """The reverse: strings are made of bytes, which need not be UTF-8."""
    if pa.types.is_string(kind):
        return pa.array(values, pa.binary()).view(kind)
    return pa.array(values, pa.large_binary()).view(kind) if pa.types.is_large_string(kind) else pa.array(values, kind)


def _local(chunk_bytes: int, carry: bool):
    """Rows of (id, text, other columns) to one record for each distinct content of a chunk.

    With ``carry`` the record holds the row itself: its text as it is, its other columns pickled.
    """
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("row_id", pa.int64()), ("n", pa.int64())] + [("payload", pa.binary())] * carry)

    def flush(table: Table) -> pa.RecordBatch:
        contents, payloads = table.contents, []
        if carry:
            own = [pickle.loads(p) for p in table.payloads]
            contents = [c if raw is None else raw for c, (_, raw) in zip(contents, own, strict=True)]
            payloads = [[others for others, _ in own]]
        columns = [table.digests, contents, table.ids, table.counts, *payloads]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            others = list(zip(*(_raw(c).to_pylist() for c in batch.columns[2:]), strict=True)) if carry else None
            nulls = batch.column(1).is_null().to_pylist() if carry else None
            for k, (row_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)):
                content = normalise(text)
                payload = pickle.dumps((pickle.dumps((others[k], nulls[k])), None if text == content else text)) if carry else None
                table.add(hashlib.sha256(content).digest(), content, _id(row_id), 1, payload)
                if table.size > chunk_bytes:
                    yield flush(table)
                    table = Table()
        if len(table):
            yield flush(table)

    return run


def _records(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[tuple]:
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        if not carry:
            yield from zip(*lists, [None] * batch.num_rows, strict=True)
            continue
        for digest, raw, row_id, n, others in zip(*lists, strict=True):
            content = normalise(raw)
            yield digest, content, row_id, n, pickle.dumps((others, None if raw == content else raw))


def _merge(budget: int):
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grace(_records(batches, False), budget):
            columns = [table.digests, [None if x == NO_ID else x for x in table.ids], table.counts]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _survivors(budget: int, schema: pa.Schema, id_col: str, text_col: str, rows: int = 2000):
    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([_column([x[f.name] for x in found], f.type) for f in schema], schema=schema)

    names = [f.name for f in schema if f.name not in (id_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for table in grace(_records(batches, True), budget):
            for _, content, row_id, _, payload in table.rows():
                packed, raw = pickle.loads(payload)
                others, null = pickle.loads(packed)
                text = None if null else (content if raw is None else raw)
                found.append(dict(zip(names, others, strict=True)) | {text_col: text, id_col: None if row_id == NO_ID else row_id})
                if len(found) >= rows:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    return run


#: Parts that rows with one id (null, say) are dealt out in.
_PARTS = 64


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's digest, and a part by its place in the task's input, which a retry reads in the same order."""
    at = 0
    for batch in batches:
        found = pa.array([hashlib.sha256(normalise(t)).digest() for t in texts(batch.column(1))], pa.binary())
        parts = pa.array([(at + k) % _PARTS for k in range(batch.num_rows)], pa.int32())
        at += batch.num_rows
        yield pa.record_batch([batch.column(0), found, parts], names=["doc_id", "digest", "part"])


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 32 << 20, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = (
        rows.mapInArrow(lean(_local(chunk_bytes, False)), "digest binary, content binary, row_id long, n long")
        .repartition("digest")
        .mapInArrow(lean(_merge(budget)), "digest binary, keep_id long, group_size long")
    )
    # Dealt by id after the join, so that Spark may split a hot digest's rows among join tasks. Of rows with one id
    # and text the first of each part is found, and then the first of these, so no id's rows meet in one task.
    out = rows.mapInArrow(lean(_digests), "doc_id long, digest binary, part int").join(groups, "digest").repartition("doc_id", "part")
    out = out.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "digest", "part").orderBy("keep_id")) == 1)
    again = Window.partitionBy("doc_id", "digest", F.when(F.col("first"), -1).otherwise(F.col("part"))).orderBy("part")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first") & (F.row_number().over(again) == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 32 << 20, chunk_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; a text crosses the network once.

    Rows beyond the first of a group in a chunk are dropped before the shuffle.
    """
    schema = to_arrow_schema(df.schema)
    others = [F.col(f"`{c}`").alias(f"other{k}") for k, c in enumerate(c for c in df.columns if c not in (id_col, text_col))]
    return (
        df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("content"), *others)
        .mapInArrow(lean(_local(chunk_bytes, True)), "digest binary, content binary, row_id long, n long, payload binary")
        .repartition("digest")
        .mapInArrow(lean(_survivors(budget, schema, id_col, text_col)), df.schema)
    )
