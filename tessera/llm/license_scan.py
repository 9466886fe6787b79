"""Licences in texts by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a text's words is hashed; the hashes are joined with those at each place of the
templates. A hit votes for the diagonal on which text and template lie against each other (place in the text less
place in the template). Votes are summed by diagonal, neighbouring diagonals (words left out or put in) are merged
into one span, and a span is verified by the share of the template's k-grams that it holds and by its length. The
join compares the words themselves beside the hash, so a hash alone never decides.

The templates are a fixed list, so their side of the join is broadcast. Their first and second words and then their hashes
also thin out a text's k-grams in its own row, before these become rows; what is shuffled is one row for each text and
each hit, once, by row.

Defined cases: a null or empty text has no words and no findings; each row gives one row, repeated rows and
null ids too; an empty table gives an empty result; extra columns are left out, whatever their names; bytes that aren't
UTF-8 count as the replacement character, which is part of a word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import license_texts

#: A word: letters and digits of ASCII, and anything beyond ASCII; A-Z are lower-cased first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
SHARE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 63  # places of a template that one long keeps the votes of


def templates(phrases: Sequence[tuple[str, str]] = tuple(license_texts.PHRASES), texts: Sequence[tuple[str, str]] = tuple(license_texts.TEXTS)) -> list[tuple[int, str, bool, int, int, list[str]]]:
    """(template, label, base, k, gap, words): a phrase is one k-gram of its own length and bears no gap."""
    made = [(said, label, True) for said, label in phrases] + [(said, label, False) for said, label in texts]
    out = []
    for number, (said, label, base) in enumerate(made):
        words = re.findall(WORD, said.translate(str.maketrans(_UPPER, _LOWER)))
        k = len(words) if base else min(K, len(words))
        out.append((number, label, base, k, 0 if base else min(8, len(words) // 4), words))
    return out


def _seeds(spark: SparkSession, of: list) -> DataFrame:
    """(template, label, base, gap, places, k, pos, gram, h): the k-grams of the templates by place."""
    rows = [(number, label, base, gap, len(words) - k + 1, k, pos, words[pos : pos + k]) for number, label, base, k, gap, words in of for pos in range(len(words) - k + 1)]
    found = spark.createDataFrame(rows, "template int, label string, base boolean, gap int, places int, k int, pos int, words array<string>")
    hashed = reduce(lambda other, k: F.when(F.col("k") == k, _hash(F.col("words"), F.lit(0), k)).otherwise(other), sorted({r[5] for r in rows}), F.lit(None).cast("long"))
    return found.select("template", "label", "base", "gap", "places", "k", "pos", F.array_join("words", " ").alias("gram"), hashed.alias("h"))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", of: list | None = None) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, first, last, share) of every span, verified or not.

    ``first`` and ``last`` are the places of its first and last word. A text without any hit has one row, with nulls.
    """
    of = of or templates()
    seeds = _seeds(docs.sparkSession, of)
    known: dict[int, list[int]] = {}
    for r in seeds.select("k", "h").distinct().collect():  # as many as the templates have k-grams
        known.setdefault(r.k, []).append(r.h)

    words = F.col("words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    first, second = ([*{r[5][pos + j] for r in of for pos in range(len(r[5]) - r[3] + 1) if r[3] > j}] for j in range(2))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(first) & (F.get(words, i + 1).isin(second) if all(k > 1 for k in known) else F.lit(True)))
    places = F.when(F.size(words) > 0, starts).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.struct(i.alias("at"), *[_hash(words, i, k).alias(f"h{k}") for k in known]))
    likely = F.filter(grams, lambda g: reduce(Column.__or__, [g[f"h{k}"].isin(hs) for k, hs in known.items()]))
    each = F.flatten(F.transform(likely, lambda g: F.array(*[F.struct(g["at"].alias("at"), g[f"h{k}"].alias("h"), F.array_join(F.slice(words, g["at"] + 1, k), " ").alias("gram")) for k in known])))
    found = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), each.alias("each"))
    found = found.select("row", "doc_id", "n_words", F.explode_outer("each").alias("g")).select("row", "doc_id", "n_words", "g.*")
    hits = found.join(F.broadcast(seeds), ["h", "gram"], "left").repartition("row")

    same = ["row", "doc_id", "n_words", "template", "label", "base", "k", "gap", "places"]
    blocks = range(-(-max(r[3] and len(r[5]) - r[3] + 1 for r in of) // _BLOCK))
    voted = [F.bit_or(F.when(F.floor(F.col("pos") / _BLOCK) == b, F.expr(f"shiftleft(1L, pos % {_BLOCK})")).otherwise(F.lit(0).cast("long"))).alias(f"votes{b}") for b in blocks]
    diagonals = hits.groupBy(*same, (F.col("at") - F.col("pos")).alias("diagonal")).agg(*voted, F.min("at").alias("low"), F.max("at").alias("high"))

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap")).cast("int"), F.lit(1))
    merged = diagonals.withColumn("begins", begins).withColumn("span", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    sums = merged.groupBy(*same, "span").agg(*[F.bit_or(f"votes{b}").alias(f"votes{b}") for b in blocks], F.min("low").alias("first"), (F.max("high") + F.col("k") - 1).alias("last"))
    votes = reduce(Column.__add__, [F.bit_count(f"votes{b}") for b in blocks])
    return sums.select("row", "doc_id", "n_words", "template", "label", "base", "k", "gap", "places", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), (votes / F.col("places")).alias("share"))


def verified(share: float = SHARE) -> Column:
    """Whether a span holds enough of its template within not much more than the template's length."""
    length = F.col("places") + F.col("k") - 1
    return (F.col("share") >= share) & (F.col("last") - F.col("first") + 1 <= length * 1.25 + F.col("gap"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, of: list | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    ``score`` is the largest share of any template that one span of the text holds.
    """
    good = F.coalesce(verified(share), F.lit(False))
    base = good & F.col("base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = spans(docs, id_col=id_col, text_col=text_col, of=of).groupBy("row", "doc_id", "n_words")
    return found.agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(good).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")
