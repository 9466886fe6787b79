import math
import random
import re
from collections import defaultdict

import pytest
from tessera.llm import mixing as X


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_brute_force_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 30, 200, rng.randint(1, 900)])), rng.choice(["a", "a", "a", "a", "b", "c", "é", "z", "", None])) for i in range(700)]
    rows += [(900, None, "a"), (901, " \n", "c"), (None, "one two", "b"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(i, t, s, 5, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")
    out = X.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    expected, source_of = brute_targets(sizes), {i: s for i, _, s in rows}
    assert len(out) == len(rows)
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s], rel=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(3, 0.01 * expected[s]), (s, taken[s], expected[s])
    assert sorted((r.doc_id or 0, r.taken) for r in X.mix(df.repartition(7)).collect()) == sorted((r.doc_id or 0, r.taken) for r in out)
    want = sum(r.copies for r in out)
    mixed = X.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == want


def test_newton_finds_the_optimum_of_the_coupled_dual(spark):
    """At the optimum every source's words meet its target, and each band's words its own less the ridge."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        masses = [rng.choice([0.0, rng.uniform(0, 500) * (1 + (b == k % 8) * 9)]) for b in range(X.BANDS)]
        rows.append((f"a{k}", masses))
    rows += [("full", [10.0] * X.BANDS), ("none", [0.0] * X.BANDS)]
    total = sum(sum(m) for _, m in rows)
    shares = [rng.uniform(0.3, 2.0) for _ in rows]
    wanted = [3.0 * sum(m) if k == "full" else min(2.9 * sum(m), w * sum(m)) for (k, m), w in zip(rows, shares, strict=True)]
    assert total
    sources = spark.createDataFrame([(k, t, m) for (k, m), t in zip(rows, wanted, strict=True)], "key string, target double, masses array<double>")
    mu, state = X.balance(sources, 3.0)
    values = [0.0] * X.BANDS
    for r in state.collect():
        rates = [min(3.0, math.exp(min(50.0, r["lambda"] + x))) for x in mu]
        assert sum(m * x for m, x in zip(r.masses, rates, strict=True)) == pytest.approx(r.target, rel=1e-9, abs=1e-9)
        values = [v + m * x for v, m, x in zip(values, r.masses, rates, strict=True)]
    before = [sum(m[b] for _, m in rows) for b in range(X.BANDS)]
    assert all(abs(v - m + 0.1 * m * x) < 1e-6 * total for v, m, x in zip(values, before, mu, strict=True))
    assert max(mu) - min(mu) > 0.05  # rates differ within a source
    with pytest.raises(RuntimeError):
        X.balance(sources, 3.0, most_iterations=1)


def test_ranks_over_partitions(spark):
    rows = [(f"k{i:04d}",) for i in random.Random(2).sample(range(1000), 300)]
    found = X.ranked(spark.createDataFrame(rows, "key string").repartition(5), "key").collect()
    assert [r.key for r in sorted(found, key=lambda r: r["rank"])] == sorted(k for (k,) in rows) and sorted(r["rank"] for r in found) == list(range(300))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in X.mix(df).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    assert X.mix(df.limit(0)).count() == 0
