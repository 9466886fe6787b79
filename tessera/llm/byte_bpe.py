"""Byte-level BPE on sentencepiece: a model serialised straight from a rank file.

Each vocabulary entry, a byte string, becomes a piece whose characters stand for its bytes
(byte b is U+0100 + b, so no character is white space to sentencepiece); its score is the
negative rank, so the merges happen in rank order, leftmost first. The normaliser is the
identity. Texts are cut into pre-tokens by the public pattern and each is encoded by itself.
A pre-token that is a vocabulary entry as a whole is that entry. Decoding maps ids back to
their bytes.

Defined cases: a null or empty text has no ids; any text round-trips byte by byte,
even one that isn't UTF-8; an empty
table gives an empty result; extra columns are ignored. The model is built once for each
Python worker from the file that comes with the public tokenizers on every node.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import lean, pieces, strings

_CACHED = 200_000  # pre-tokens that a worker remembers, of 64 characters at most
_AT_ONCE = 1 << 20  # characters of a text whose pre-tokens are listed at once; of a longer one they are streamed
_SHIFT = 0x100


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def mapped(token: bytes) -> str:
    return "".join(chr(_SHIFT + b) for b in token)


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[bytes]]:
    """A sentencepiece BPE model, and the bytes of each of its piece ids (a piece's id is its rank's place)."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    parts = []
    for token in ordered:
        piece = _field(1, mapped(token).encode()) + _field(2, float(-ranks[token]))
        parts.append(_field(1, piece))
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    parts.append(_field(1, unknown))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(40, len(ordered)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normaliser), ordered


class Codec:
    """Encodes and decodes texts by a rank file and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        model, self.tokens = serialise(ranks)
        self.ranks, found = ranks, regex.compile(pattern)
        self.find, self.list = found.finditer, None if found.groups else found.findall
        self.ids_of = [ranks[t] for t in self.tokens]
        self.bytes_of = {ranks[t]: t for t in self.tokens}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cache: dict[str, bytes] = {}

    def pretokens(self, texts: list[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens, those that aren't vocabulary entries by one call of the library."""
        raw = [t.encode("utf-8", "surrogateescape") for t in texts]
        whole = [self.ranks.get(x) for x in raw]
        split = iter(self.model.encode([mapped(x) for x, w in zip(raw, whole, strict=True) if w is None], num_threads=1))
        ids_of = self.ids_of
        found = {t: array("i", (w,) if w is not None else [ids_of[i] for i in next(split)]).tobytes() for t, w in zip(texts, whole, strict=True)}
        short = {t: ids for t, ids in found.items() if len(t) <= 64}
        if len(self.cache) + len(short) > _CACHED:
            self.cache.clear()
        self.cache.update(short)
        return found

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if self.list and len(text) <= _AT_ONCE:
            return self._joined(self.list(text))
        out, rest = bytearray(), (m[0] for m in self.find(text))
        while some := list(islice(rest, 1 << 16)):
            out += self._joined(some)
        return bytes(out)

    def _joined(self, tokens: list[str]) -> bytes:
        parts = list(map(self.cache.get, tokens))
        if None in parts:
            new = self.pretokens(list(dict.fromkeys(t for t, ids in zip(tokens, parts, strict=True) if ids is None)))
            parts = [new[t] if ids is None else ids for t, ids in zip(tokens, parts, strict=True)]
        return b"".join(parts)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str | None = None) -> Codec:
    """``vocabulary``: a path, or the name of a file of the public tokenizers."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return Codec(read_ranks(path), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, *, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (binary): one row for each row of ``df``; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            column = batch.column(1)
            for first, last in pieces(column, 1 << 19):
                ids = [own.packed(t or "") for t in strings(column[first:last], "surrogateescape")]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                decoded = pa.array([own.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in ids], pa.binary())
                yield pa.record_batch([batch.column(0)[first:last], pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>, decoded binary")
