"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once for each document and stores one bit for each failed
rule beside the measurements. Policies are versioned masks over those bits, so changing a
policy never reads the texts again; ``ablations`` counts, by bitwise aggregation, what each
rule of a policy removes alone and what removing it from the policy would bring back.

All rules compare integers, so SQL says the same. Defined cases: a null or empty text has
all measurements zero and fails ``few_words``; repeated rows are measured separately; a null
id is kept as null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import MEASURES, measured
from .words import lean

#: Rules in the order of their bits; each is a SQL condition on measurements that says "fails".
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_words", "10 * n_symbol_words > n_words"),
    ("capitals", "n_words >= 10 AND 10 * n_upper > 3 * (n_upper + n_lower)"),
    ("exclamations", "2 * n_exclaim > n_words"),
    ("separators", "4 * n_pipes > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines"),
    ("short_words_mean", "word_chars < 2 * n_words"),
    ("long_words_mean", "word_chars > 14 * n_words"),
    ("digits", "4 * n_digits > n_chars AND n_chars > 0"),
    ("few_distinct_words", "n_words >= 50 AND 20 * n_distinct_words < n_words"),
    ("no_lines", "n_lines = 0"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A named version of what counts: a document fails if it fails any rule of the mask."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_windows")),
        Policy("web-1", ("few_words", "repeated_windows", "symbol_words", "capitals", "exclamations", "separators", "long_words_mean", "digits", "no_lines")),
        Policy("web-2-strict", tuple(BIT)),
    )
}


def ledger(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failures``: a long with a bit for each failed rule. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64())] + [(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[dict[str, np.ndarray]] = [found for *_, found in measured(batch.column(1))]
            if parts:
                columns = [pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES]
                yield pa.record_batch([batch.column(0), *columns], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(lean(run), ", ".join(f"{f.name} long" for f in schema))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return found.withColumn("failures", total)


def passes(policy: Policy, failures: str | Column = "failures") -> Column:
    column = F.col(failures) if isinstance(failures, str) else failures
    return column.bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` by one policy."""
    return rows.withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy.version))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    One aggregation over at most 2^rules masked values, each of which then gets a row for each rule of the policy.
    """
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    total = F.sum("n")
    return (
        masks.select("bits", "n", F.explode(rules).alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            total.alias("n_docs"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
