"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps every code point to a letter or a space: case and diacritics go, homoglyphs and
full-width forms become their Latin letter, digits and signs used as letters become that letter
(signs only inside a word), zero-width characters are removed, i, l, 1, ! and | fall
together, and letters of other scripts stay as they are. An entry is a whole word (space on both
sides) or the beginning of a word (space before it); its weight is a smoothed log-odds. Longer
exception phrases switch off the entries inside them.

The lexicon, its exceptions and the calibration are learned from at most ``most`` labelled
rows of each class (documented bounds, as are ``entries`` and ``CANDIDATES``: the model is chosen
from the strongest candidates and has a fixed size, which is what is broadcast); they are the rows
with the smallest hashes of the id, held-out rows left out, and their whole texts are read.
Scoring covers every row and whole texts in time linear in the text. Labels, lang, source and
doc_id are never inputs.

Score: a logistic function of the summed weights and of their rate by length.

Defined cases: null and empty texts are scored like a text without matches; without labels
the score is the same for every text; an id with two labels counts as toxic; of rows with equal ids
one is learned from; repeated rows get equal scores; bytes that aren't UTF-8 count as spaces; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, checkpoint
from .words import crc_fold, lean, pieces, strings

_SPACE, _GONE = 32, 0
#: Candidate entries that the lexicon is chosen from.
CANDIDATES = 20_000
#: Letters of other scripts that look like a Latin one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ԛ": "q", "ѡ": "w", "ɡ": "g",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x", "β": "b", "η": "n", "ω": "w", "γ": "y", "ı": "i", "ß": "s", "æ": "a", "ø": "o", "đ": "d", "ł": "l",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "(": "c"}
_LEADING = [ord("@"), ord("$")]  # these stand for the first letter of a word, too
SAME = {"l": "i"}  # letters that fall together with another
_INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What each code point folds to, and what it folds to between letters only (0: nothing)."""
    fold = np.full(0x110000, _SPACE, dtype=np.uint32)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000 or (0x3400 <= point < 0xF900):
            continue
        character = chr(point)
        if not character.isalnum() and unicodedata.category(character) != "Mn":
            continue
        base = unicodedata.normalize("NFKD", character)[:1].lower()[:1]
        base = HOMOGLYPHS.get(base, HOMOGLYPHS.get(character.lower()[:1], base))
        base = DIGITS.get(base, base)
        fold[point] = ord(SAME.get(base, base))
        if unicodedata.category(character) == "Mn":
            fold[point] = _GONE
    fold[0x3400:0xD800] = np.arange(0x3400, 0xD800)
    fold[_INVISIBLE] = _GONE
    inside = np.zeros(0x110000, dtype=np.uint32)
    for sign, letter in SIGNS.items():
        inside[ord(sign)] = ord(letter)
    return fold, inside


def fold(text: str) -> str:
    """Letters and spaces; starts and ends with a space."""
    table, inside = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = table[points]
    signs = inside[points]
    at = np.flatnonzero(signs)
    if len(at):
        at = at[at < len(out) - 1]
        before = np.where(at > 0, out[at - 1], _SPACE)
        at = at[(out[at + 1] > _SPACE) & ((before > _SPACE) | np.isin(points[at], _LEADING))]
        out[at] = signs[at]
    if not out.all():
        out = out[out != _GONE]
    return " " + out.tobytes().decode("utf-32-le") + " "


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the calibration of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -2.0
    total_slope: float = 0.0
    rate_slope: float = 0.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for k, (entry, weight) in enumerate(self.weights.items()):
            found.add_word(entry, (len(entry), weight, k))
        for phrase in self.exceptions:
            found.add_word(f" {phrase.strip()} ", (len(phrase.strip()) + 2, None, -1))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries found, those inside an exception left out; one entry for each word, the heaviest."""
        if not len(automaton):
            return []
        hits, off = [], []
        for end, (n, weight, _) in automaton.iter(folded):
            (off if weight is None else hits).append((end + 1 - n, end + 1, weight))
        if off:
            off.sort()
            begins, reach = [a for a, _, _ in off], list(accumulate((b for _, b, _ in off), max))
            hits = [h for h in hits if not (k := bisect_right(begins, h[0])) or reach[k - 1] < h[1]]
        best: dict[int, tuple[int, int, float]] = {}
        for hit in hits:
            if hit[0] not in best or abs(hit[2]) > abs(best[hit[0]][2]):
                best[hit[0]] = hit
        return list(best.values())

    def strength(self, automaton, text: str) -> tuple[float, float]:
        """log of the summed weights, and log of that sum for 1,000 words."""
        folded = fold(text)
        total = max(0.0, sum(w for *_, w in self.matches(automaton, folded)))
        if not total:
            return 0.0, 0.0
        return float(np.log1p(total)), float(np.log1p(1000 * total / (20 + folded.count(" "))))

    def score(self, strengths: np.ndarray) -> np.ndarray:
        y = self.bias + strengths @ np.array([self.total_slope, self.rate_slope])
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _candidates(folded: str) -> set[str]:
    """The whole words of a text, and the beginnings of its words of 4 to 8 letters."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            for n in range(4, min(8, len(word)) + 1):
                out.add(f" {word[:n]}")
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    """(label, text) of each row, a bounded number of bytes at a time."""
    for first, last in pieces(batch.column(2), 2 << 20):
        yield from zip(batch.column(1)[first:last].to_pylist(), strings(batch.column(2)[first:last]), strict=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a partition with each candidate, by label; summed before the shuffle, a bounded number at a time."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

    for batch in batches:
        for label, text in _rows(batch):
            counts[label].update(_candidates(fold(text or "")))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
                counts[0].clear(), counts[1].clear()
    if counts[0] or counts[1]:
        yield flush()


def _gain(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """The log-likelihood ratio of an entry; only for entries commoner in toxic texts."""
    share = (pos + neg) / (n_pos + n_neg)
    if pos / n_pos <= neg / n_neg:
        return 0.0

    def part(k: int, n: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    return 2 * (part(pos, n_pos, pos / n_pos) + part(neg, n_neg, neg / n_neg) - part(pos, n_pos, share) - part(neg, n_neg, share))


def choose(found: list[tuple[str, int, int]], n_pos: int, n_neg: int, entries: int, least_gain: float) -> dict[str, float]:
    """The strongest candidates; of a word and its beginnings only one, the longest if they are level."""
    ranked = sorted(((_gain(p, n, n_pos, n_neg), len(e), e, p, n) for e, p, n in found), key=lambda x: (-round(x[0], 6), -x[1], x[2]))
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for gain, _, entry, pos, neg in ranked:
        if gain < least_gain or len(chosen) >= entries:
            break
        if neg / n_neg > 0.12 * pos / n_pos:
            continue
        if entry in begun or any(entry[:n] in chosen for n in range(4, len(entry))):
            continue
        chosen[entry] = float(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))
        begun.update(entry[:n] for n in range(4, len(entry)))
    return chosen


def _phrases(lexicon: Lexicon):
    """Two-word phrases around matches in the sample, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = lexicon.automaton(), (Counter(), Counter())
        for batch in batches:
            for label, text in _rows(batch):
                folded, seen = fold(text or ""), set()
                for start, end, _ in lexicon.matches(own, folded):
                    stop = folded.find(" ", max(start + 1, end - 1))
                    word = folded[start + 1 : stop]
                    before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
                    after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
                    seen.update([f"{before} {word}"] if before else [])
                    seen.update([f"{word} {after}"] if after else [])
                counts[label].update(seen)
        keys = list(counts[0])  # only phrases of clean texts can be exceptions
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

    return run


def _strengths(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.automaton()
        for batch in batches:
            found = np.array([lexicon.strength(own, t or "") for _, t in _rows(batch)]).reshape(-1, 2)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "label", "total", "rate"])

    return run


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method: bias and slopes."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = ridge * np.eye(design.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = 6_000, entries: int = 2_000, least_gain: float = 28.0, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most ``most`` rows of each class; a bounded list of ids is broadcast, other texts aren't shuffled."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold() != 0))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = checkpoint(reduce(DataFrame.unionByName, (bounded_sample(usable.filter(F.col("label") == k), most, "doc_id") for k in (0, 1))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = checkpoint(found.select("doc_id", "label", "text"))

    summed = "entry string, pos long, neg long"
    counts = sample.mapInArrow(lean(_count), summed).groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    learned = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = max(1, learned.get(1, 0)), max(1, learned.get(0, 0))
    lead = F.col("pos") / n_pos - F.col("neg") / n_neg
    strongest = counts.filter((F.col("pos") >= 3) & (F.col("pos") * n_neg > 8 * F.col("neg") * n_pos)).orderBy(F.desc(lead), "entry").limit(CANDIDATES).collect()
    lexicon = Lexicon(choose([(r.entry, r.pos, r.neg) for r in strongest], n_pos, n_neg, entries, least_gain))

    own = [fold(p).strip() for p in exceptions]
    if lexicon.weights:
        counts = sample.mapInArrow(lean(_phrases(lexicon)), summed).groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        own += [r.entry for r in counts.filter("neg >= 3 AND 4 * pos < neg").orderBy(F.desc("neg"), "entry").limit(entries).collect()]
    lexicon.exceptions = tuple(dict.fromkeys(own))

    held = sample.mapInArrow(lean(_strengths(lexicon)), "doc_id long, label int, total double, rate double").toPandas().sort_values(["doc_id", "total", "rate"])
    if len(held):
        weight = np.where(held.label == 1, totals.get(1, 0) / max(1, (held.label == 1).sum()), totals.get(0, 0) / max(1, (held.label == 0).sum()))
        lexicon.bias, lexicon.total_slope, lexicon.rate_slope = map(float, calibrate(held[["total", "rate"]].to_numpy(), held.label.to_numpy(), weight))
    return lexicon


def score_of(text: Column, lexicon: Lexicon) -> Column:
    """The scores of a text column. No shuffle."""

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for part in texts:
            found = [lexicon.strength(automaton, t or "") for first, last in pieces(part, 2 << 20) for t in strings(part[first:last])]
            yield pa.array(lexicon.score(np.array(found).reshape(-1, 2)), pa.float64())

    return F.arrow_udf(lean(scored), "double")(text.cast("string"))


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(F.col(f"`{text_col}`"), lexicon).alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
