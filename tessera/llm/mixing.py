"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target number of words, which is a constraint; and the mix is to keep the share of
words that each of eight bands of document sizes has in the corpus, which is a soft one, as the cap can
make both at once impossible. Among all document rates, the closest to 1 in relative entropy, measured
over words, are exponential tilts

    rate = min(cap, exp(lambda_source + mu_band)).

The multipliers minimise the convex dual, which couples all sources through the bands. For given
``mu`` each source's ``lambda`` has a closed form but for the bands that reach the cap, found in at most
eight steps inside one expression; damped Newton iterations then find ``mu``: each is one aggregation
over the table of words by source and band, whose gradient and curvature (the Schur complement, 8 x 8)
come to the driver. It ends at a gradient of 1e-7 of all words, or with an error.

Rates are rounded to copies: floor(rate) for all, and one more for the documents whose hash
minus the rate's fraction is lowest, up to the cut at which the source's words meet its target.
The cut comes from two histograms of 4,096 bins (no sort, no window over documents); then at
most ``fills`` single documents close what is left. Everything is a function of ids and sizes, so
reruns agree.

Targets: sources above their cap are cut to it and the excess is shared out again by weight, one
aggregation a round. Weights go by the source's rank, which range partitions count apart.

Defined cases: null text has size 0; a null source is a source, the last one; a null id hashes
like any other value; repeated rows get the same number of copies; an empty table gives an empty
result; a table of empty texts has targets and takes of 0; extra columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint

BANDS = 8
FAR = 1e9  # the multiplier of a source whose documents are all at the cap
_BINS = 4096
_WORD = r"[^\x20\x09-\x0D]+"
#: At most so many sources are broadcast to the documents; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def band(size: Column) -> Column:
    """The band of a document's size, from 0: each is four times as wide as the one before."""
    return F.least(F.lit(BANDS - 1), F.floor(F.log2(F.greatest(size, F.lit(1))) / 2)).cast("int")


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column rank, from 0 in the order of ``column`` (unique): partitions count apart, then add what lies before."""
    parts = checkpoint(rows.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(parts.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    own = Window.partitionBy("part").orderBy(column)
    joined = parts.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, before long")), "part")
    return joined.withColumn("rank", F.row_number().over(own) - 1 + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, cap: float) -> DataFrame:
    """(key, source_size, ...) with target: all words shared by weights 1, 2, 3 repeating in key order, at most ``cap`` times the source's own."""
    weighed = checkpoint(ranked(sizes, "key").withColumn("weight", (F.pmod("rank", F.lit(3)) + 1).cast("double")).drop("rank"))
    ceiling, level = cap * F.col("source_size"), 0.0
    while True:
        free = ceiling > level * F.col("weight")
        r = weighed.agg(F.sum("source_size").alias("total"), F.sum(F.when(~free, ceiling)).alias("cut"), F.sum(F.when(free, F.col("weight"))).alias("weights")).first()
        new = ((r.total or 0) - (r.cut or 0.0)) / r.weights if r.weights else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.withColumn("target", F.least(ceiling, F.lit(level) * F.col("weight")).cast("double")).drop("weight")


def _sum(*terms: Column) -> Column:
    return reduce(lambda x, y: x + y, terms)


def _lambda(masses: Column, target: Column, mu: list[float], cap: float) -> Column:
    """The multiplier of a source with these words by band: at each step the bands at the cap are set apart."""
    tilts = F.array(*[F.lit(x) for x in mu])
    rows = F.zip_with(masses, tilts, lambda m, x: F.struct(m.alias("m"), x.alias("x")))

    def step(now: Column, _: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("full"), F.lit(0.0).alias("rest"))
        full = lambda r: now + r["x"] >= math.log(cap) - 1e-12
        sums = F.aggregate(rows, zero, lambda s, r: F.struct((s["full"] + F.when(full(r), r["m"]).otherwise(0.0)).alias("full"), (s["rest"] + F.when(full(r), 0.0).otherwise(r["m"] * F.exp(r["x"]))).alias("rest")))
        return F.aggregate(F.array(sums), F.lit(0.0), lambda _, s: F.when((s["rest"] > 0) & (target - cap * s["full"] > 0), F.log((target - cap * s["full"]) / s["rest"])).when(s["rest"] > 0, F.lit(now)).otherwise(FAR))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BANDS + 1)), F.lit(-FAR), step)
    return F.when(target >= cap * F.aggregate(masses, F.lit(0.0), lambda s, m: s + m) * (1 - 1e-12), F.lit(FAR)).otherwise(found)


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination of a small positive definite system."""
    n, rows = len(b), [[*r, x] for r, x in zip(a, b, strict=True)]
    for k in range(n):
        for j in range(k + 1, n):
            factor = rows[j][k] / rows[k][k]
            rows[j] = [y - factor * x for x, y in zip(rows[k], rows[j], strict=True)]
    out = [0.0] * n
    for k in reversed(range(n)):
        out[k] = (rows[k][n] - sum(rows[k][j] * out[j] for j in range(k + 1, n))) / rows[k][k]
    return out


def _dual(sources: DataFrame, mu: list[float], cap: float, ridge: float) -> tuple[float, list[float], list[list[float]], list[float]]:
    """Value, gradient and curvature of the dual at ``mu`` with the best lambda of every source, and the words of each band."""
    wide = sources.withColumn("lambda", _lambda(F.col("masses"), F.col("target"), mu, cap))
    m = [F.get("masses", F.lit(k)) for k in range(BANDS)]
    at = [F.col("lambda") + mu[k] for k in range(BANDS)]
    below = [x < math.log(cap) for x in at]
    rate = [F.least(F.lit(cap), F.exp(x)) for x in at]
    wide = wide.select("target", "lambda", *[m[k].alias(f"m{k}") for k in range(BANDS)], *[(m[k] * rate[k]).alias(f"v{k}") for k in range(BANDS)], *[F.when(below[k], m[k] * rate[k]).otherwise(0.0).alias(f"c{k}") for k in range(BANDS)], *[(m[k] * F.when(below[k], rate[k]).otherwise(cap * (1 + at[k] - math.log(cap)))).alias(f"d{k}") for k in range(BANDS)])
    every = _sum(*[F.col(f"c{k}") for k in range(BANDS)])
    value = _sum(*[F.col(f"d{k}") for k in range(BANDS)]) - F.col("target") * F.col("lambda")
    open_sources = F.col("lambda") < FAR
    sums = [F.sum(F.when(open_sources, value)).alias("value")]
    sums += [F.sum(f"{x}{k}").alias(f"{x}{k}") for x in "mvc" for k in range(BANDS)]
    sums += [F.sum(F.when(every > 0, F.col(f"c{j}") * F.col(f"c{k}") / every)).alias(f"s{j}_{k}") for j in range(BANDS) for k in range(j, BANDS)]
    # A source whose every document is at the cap doesn't move; its words count as they are.
    r = {k: float(x or 0.0) for k, x in wide.agg(*sums).first().asDict().items()}
    mass = [max(1.0, r[f"m{k}"]) for k in range(BANDS)]
    gradient = [r[f"v{k}"] - r[f"m{k}"] + ridge * mass[k] * mu[k] for k in range(BANDS)]
    curvature = [[(r[f"c{j}"] + ridge * mass[j]) * (j == k) - r[f"s{min(j, k)}_{max(j, k)}"] for k in range(BANDS)] for j in range(BANDS)]
    total = r["value"] + sum(-r[f"m{k}"] * mu[k] + ridge * mass[k] * mu[k] ** 2 / 2 for k in range(BANDS))
    return total, gradient, curvature, mass


def balance(sources: DataFrame, cap: float, ridge: float = 0.1, most_iterations: int = 60, tolerance: float = 1e-7) -> tuple[list[float], DataFrame]:
    """The multipliers of the bands, and ``sources`` (key, target, masses) with lambda, by Newton's method on the dual."""
    mu = [0.0] * BANDS
    _, gradient, curvature, mass = _dual(sources, mu, cap, ridge)
    for _ in range(most_iterations):
        if max(map(abs, gradient)) <= tolerance * sum(mass):
            return mu, sources.withColumn("lambda", _lambda(F.col("masses"), F.col("target"), mu, cap))
        step = _solve(curvature, [-g for g in gradient])
        size = min(1.0, 1.0 / max(map(abs, step)))
        norm = sum(g * g / m for g, m in zip(gradient, mass, strict=True))
        while True:  # the gradient is to shrink; the dual is convex, so a short enough step does it
            new = [x + size * d for x, d in zip(mu, step, strict=True)]
            _, gradient, curvature, _ = _dual(sources, new, cap, ridge)
            if sum(g * g / m for g, m in zip(gradient, mass, strict=True)) < norm or size < 1e-3:
                break
            size /= 2
        mu = new
    raise RuntimeError("the balance did not converge")


def _rate(mu: list[float], cap: float) -> Column:
    tilt = F.element_at(F.array(*[F.lit(x) for x in mu]), band(F.col("size")) + 1)
    return F.least(F.lit(float(cap)), F.exp(F.col("lambda") + tilt))


def _rounded(docs: DataFrame, cap: int, mu: list[float]) -> DataFrame:
    """Adds what each document gets for sure and its place in the order of those that get one more."""
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    rate = _rate(mu, cap)
    found = docs.withColumn("sure", F.least(F.lit(cap), F.floor(rate + 1e-9))).withColumn("place", (u - F.greatest(F.lit(0.0), rate - F.col("sure")) + 1) / 2 * _BINS)
    return found.withColumn("bin1", F.floor("place")).withColumn("bin2", F.floor((F.col("place") - F.floor("place")) * _BINS))


def _cut(rows: DataFrame, state: DataFrame, column: str, left: str) -> DataFrame:
    """For each key the last bin that does not fit whole (null: all fit), and what is left before it."""
    sums = rows.groupBy("key", column).agg(F.sum("size").alias("bin_size"))
    below = F.sum("bin_size").over(Window.partitionBy("key").orderBy(column))
    crossed = sums.withColumn("up_to", below).join(state.select("key", left), "key").withColumn("fits", F.col("up_to") <= F.col(left))
    found = crossed.groupBy("key").agg(F.min(F.when(~F.col("fits"), F.col(column))).alias(f"{column}_cut"), F.coalesce(F.max(F.when(F.col("fits"), F.col("up_to"))), F.lit(0)).alias("used"))
    return state.join(found, "key", "left").withColumn(f"{column}_left", F.col(left) - F.coalesce("used", F.lit(0))).drop("used")


def _more(fills: int) -> Column:
    """Whether a document gets one copy more, given its source's cuts and single picks."""
    cut1, cut2 = F.col("bin1_cut"), F.col("bin2_cut")
    inside = cut1.isNull() | (F.col("bin1") < cut1) | ((F.col("bin1") == cut1) & (cut2.isNull() | (F.col("bin2") < cut2)))
    for k in range(fills):
        inside = inside | F.coalesce(F.col("doc_id") == F.col(f"pick{k}"), F.lit(False))
    return inside


@dataclass
class Plan:
    """One row for each source (target, lambda, the cuts of the rounding), and what holds for all."""

    sources: DataFrame
    mu: list[float]
    few: bool  # the sources are counted to be few enough to be broadcast
    cap: int
    fills: int

    def join(self, docs: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(self.sources) if self.few else self.sources, "key")

    def rounded(self, docs: DataFrame) -> DataFrame:
        return _rounded(self.join(docs), self.cap, self.mu)


def plan(docs: DataFrame, *, cap: int = 3, fills: int = 3) -> Plan:
    """The plan for documents (doc_id, key, size)."""
    words_of = docs.groupBy("key", band(F.col("size")).alias("band")).agg(F.sum("size").cast("double").alias("mass"))
    by_band = [F.coalesce(F.sum(F.when(F.col("band") == k, F.col("mass"))), F.lit(0.0)) for k in range(BANDS)]
    sizes = words_of.groupBy("key").agg(F.sum("mass").cast("long").alias("source_size"), F.array(*by_band).alias("masses"))
    wanted = checkpoint(targets(sizes, float(cap)))
    mu, state = balance(wanted, float(cap))
    own = Plan(checkpoint(state.drop("masses")), mu, wanted.count() <= BROADCAST_SOURCES, cap, fills)
    rows = own.rounded(docs)
    sure = rows.groupBy("key").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_size"))
    open_rows = checkpoint(rows.filter(F.col("sure") < cap).select("doc_id", "key", "size", "bin1", "bin2"))
    state = own.sources.join(sure, "key").withColumn("need", F.col("target") - F.col("sure_size")).drop("sure_size")
    own.sources = state = checkpoint(_cut(open_rows, state, "bin1", "need"))
    last = replace(own, sources=state.select("key", "bin1_cut")).join(open_rows).filter("bin1 = bin1_cut")
    own.sources = state = checkpoint(_cut(last, state, "bin2", "bin1_left"))
    left = "bin2_left"
    for k in range(fills):
        spare = own.join(open_rows).filter(~_more(k) & (F.col("size") > 0))
        off = F.abs(F.col("size") - F.col(left))
        best = spare.filter(off < F.col(left)).groupBy("key").agg(F.min_by(F.struct("doc_id", "size"), F.struct(off, F.col("doc_id"))).alias("best"))
        state = state.join(best, "key", "left").withColumn(f"pick{k}", F.col("best.doc_id")).withColumn(f"left{k}", F.col(left) - F.coalesce("best.size", F.lit(0))).drop("best")
        own.sources = state = checkpoint(state)
        left = f"left{k}"
    return own


def copies(docs: DataFrame, own: Plan) -> DataFrame:
    """``docs`` (with doc_id, key, size) with target, source_size and the number of copies."""
    number = F.col("sure") + F.when((F.col("sure") < own.cap) & _more(own.fills), 1).otherwise(0)
    return own.rounded(docs).withColumn("copies", number.cast("int"))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("key"), words(F.col(text_col).cast("string")).alias("size"))


def mix(docs: DataFrame, *, cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``."""
    rows = checkpoint(measured(docs))
    out = copies(rows, plan(rows, cap=cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_rows(docs: DataFrame, *, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the texts aren't shuffled."""
    own = plan(checkpoint(measured(docs, id_col=id_col, text_col=text_col, source_col=source_col)), cap=cap)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("key"), words(F.col(text_col).cast("string")).alias("size"))
    taken = copies(rows, own).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
