"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are its lower-cased words hashed to 2^16 places (weight 1/sqrt of the
number of distinct places), its structure statistics cut into bins, and its length. Pairs
interact through vectors of rank ``rank``; the score uses the sum-of-squares identity
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, linear in the number of features.

Fitting takes at most ``most`` labelled rows (a documented bound, 12,000 by default, those
below a threshold of a hash of the id) of at most ``MOST_PLACES`` features, held-out rows left out; the model has a fixed size
(2^16 + bins places, rank + 1 floats each), which is what is broadcast. Scoring covers every
row and whole texts. Labels, lang, source and doc_id are never inputs.

Defined cases: a null or empty text is scored by its structure alone; with no labels at all
every score is 0.5; an id with two labels has the larger; of rows with equal ids one is learned
from; with one class every score is near that class; a null id is never held
out; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, checkpoint
from .text_stats import MEASURES, measured
from .words import Block, crc_fold, lean

PLACES = 1 << 16
#: Features of the sample that come to the driver (about 160 MB); beyond it a quarter of so many, by a hash.
MOST_PLACES = 20_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: name, numerator, denominator, bin edges
RATIOS = [
    ("symbols", "n_symbols", "n_words", (0.01, 0.05, 0.1, 0.2, 0.5, 1.0)),
    ("symbol_words", "n_symbol_words", "n_words", (0.01, 0.05, 0.1, 0.2, 0.5)),
    ("capitals", "n_upper", "n_letters", (0.005, 0.02, 0.05, 0.1, 0.3, 0.6)),
    ("repeats", "n_repeat_words", "n_words", (0.02, 0.1, 0.25, 0.5, 0.75)),
    ("duplicate_lines", "n_dup_lines", "n_lines", (0.05, 0.15, 0.3, 0.5, 0.7)),
    ("word_length", "word_chars", "n_words", (3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0)),
    ("distinct", "n_distinct_words", "n_words", (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)),
    ("exclamations", "n_exclaim", "n_words", (0.01, 0.05, 0.2, 0.5)),
    ("separators", "n_pipes", "n_words", (0.01, 0.05, 0.1, 0.25)),
    ("digits", "n_digits", "n_chars", (0.005, 0.02, 0.1, 0.25)),
    ("short_words", "n_short_words", "n_words", (0.2, 0.3, 0.4, 0.5, 0.7)),
    ("long_words", "n_long_words", "n_words", (0.02, 0.1, 0.2, 0.4)),
    ("line_length", "n_words", "n_lines", (2.0, 5.0, 10.0, 20.0, 50.0, 200.0)),
    ("length", "n_words", None, (1.0, 10.0, 25.0, 50.0, 100.0, 300.0, 1000.0, 3000.0)),
]
BASES = np.cumsum([0] + [len(r[3]) + 1 for r in RATIOS])
SIZE = PLACES + int(BASES[-1])


def features(block: Block, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature place, value), sorted by text."""
    n = len(block.bounds) - 1
    text_of = np.repeat(np.arange(n), np.diff(block.bounds))
    place = (block.hashes(_LOWER[block.data]) & np.uint64(PLACES - 1)).astype(np.int64)
    pairs = np.unique(text_of * PLACES + place)
    rows, places = pairs // PLACES, pairs % PLACES
    values = (1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n))))[rows]
    own = found | {"n_letters": found["n_upper"] + found["n_lower"]}
    bins = []
    for k, (_, top, bottom, edges) in enumerate(RATIOS):
        x = own[top] / np.maximum(1, own[bottom]) if bottom else own[top]
        bins.append(PLACES + BASES[k] + np.searchsorted(np.array(edges), x, side="right"))
    rows = np.concatenate([rows, np.repeat(np.arange(n), len(RATIOS))])
    places = np.concatenate([places, np.stack(bins, axis=1).ravel()])
    values = np.concatenate([values, np.full(n * len(RATIOS), 0.5)])
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order], values[order].astype(np.float32)


@dataclass
class Machine:
    """y = bias + <w, x> + sum over pairs <v_i, v_j> x_i x_j, through a logistic link."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, weights=self.w[places] * values, minlength=n)
        for f in range(self.v.shape[1]):
            vx = self.v[places, f] * values
            out += 0.5 * (np.bincount(rows, weights=vx, minlength=n) ** 2 - np.bincount(rows, weights=vx * vx, minlength=n))
        return out

    def score(self, *args) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*args), -30, 30)))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], *, rank: int = 4, epochs: int = 6, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, one mini-batch of rows at a time. ``examples``: label, places, values."""
    rng = np.random.default_rng(seed)
    if not examples:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, rank), np.float32))
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32))
    share = (sum(y for y, *_ in examples) + 0.5) / (len(examples) + 1)
    machine.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, rank), 1e-3, np.float32), 1e-3
    for _ in range(max(epochs, 25_000 // len(examples))):  # small samples are gone through more often
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 64):
            part = [examples[k] for k in order[at : at + 64]]
            rows = np.repeat(np.arange(len(part)), [len(p) for _, p, _ in part])
            places = np.concatenate([p for _, p, _ in part])
            x = np.concatenate([v for *_, v in part])
            error = machine.score(rows, places, x, len(part)) - np.array([y for y, *_ in part])
            vx = machine.v[places] * x[:, None]
            sums = np.stack([np.bincount(rows, weights=vx[:, f], minlength=len(part)) for f in range(rank)], axis=1)
            own, back = np.unique(places, return_inverse=True)
            e = error[rows] * x
            dw = np.bincount(back, weights=e, minlength=len(own)) / len(part) + ridge * machine.w[own]
            dv = np.stack([np.bincount(back, weights=e * (sums[rows, f] - vx[:, f]), minlength=len(own)) for f in range(rank)], axis=1) / len(part) + ridge * machine.v[own]
            gw[own] += dw**2
            gv[own] += dv**2
            machine.w[own] -= rate * dw / np.sqrt(gw[own])
            machine.v[own] -= rate * dv / np.sqrt(gv[own])
            gb += float(error.mean()) ** 2
            machine.bias -= rate * float(error.mean()) / gb**0.5
    return machine


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, text of at most ``most`` labelled rows that aren't held out.

    The bounded list of ids is what is broadcast; only the texts of the sample are shuffled.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = bounded_sample(usable, most, "doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "label", "text")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, block, found in measured(batch.column(2)):
            rows, places, values = features(block, found)
            cuts = np.searchsorted(rows, np.arange(last - first + 1))
            yield pa.record_batch(
                [batch.column(0)[first:last], batch.column(1)[first:last], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int32())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.float32()))],
                names=["doc_id", "label", "places", "x"],
            )


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = 12_000, rank: int = 4) -> Machine:
    found = checkpoint(labelled(docs, labels, label, most).mapInArrow(lean(_examples), "doc_id long, label int, places array<int>, x array<float>"))
    size = found.agg(F.sum(F.size("places"))).first()[0] or 0
    if size > MOST_PLACES:  # very long texts: fewer of them
        place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 11).cast("double") / float(1 << 53)
        found = found.filter(place < MOST_PLACES / 4 / size)
    found = found.toArrow().sort_by("doc_id")
    columns = found.column("label").to_pylist(), found.column("places"), found.column("x")
    examples = [(y, np.asarray(p.values), np.asarray(x.values)) for y, p, x in zip(columns[0], columns[1], columns[2], strict=True)]
    return fit(examples, rank=rank)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``. No shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            scores = [own.score(*features(block, found), last - first) for first, last, block, found in measured(batch.column(1))]
            if scores:
                yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
