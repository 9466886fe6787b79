import random
import re
from functools import partial

import numpy as np
import pytest
from tessera.llm import substring_dedup as X
from xxhash import xxh64_intdigest


def brute(rows, length=13):
    last = float("inf")
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    signed = lambda t: (h := xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    ids = [(1 << 63) - 1 - signed(t) % (1 << 40) if i is None else i for i, t in rows]
    low = {}
    for d, w in zip(ids, words, strict=True):
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            low[key] = min(low.get(key, last), d)
    out = []
    for (i, _), d, w in zip(rows, ids, words, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if low[tuple(w[s : s + length])] < d:
                gone.update(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "a", "of", "é"]) if rng.random() < 0.3 else f"w{rng.randrange(60)}"
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 30, 60]))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [word() for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                part = rng.choice(shared)
                a = rng.randrange(len(part))
                words += part[a:] if rng.random() < 0.3 else part
        rows.append((i * 3 % n + 1000 * (i % 2), rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, (5, None), (6, ""), (7, " \n"), (None, rows[3][1]), (None, rows[3][1] + " x"), rows[0], (rows[1][0], rows[2][1]), (9999, "very long " * 30000), (2, "a b " * 500), (10001, "a b " * 500)]


def run(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in X.remove_repeats(df).collect()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, d int, anchor string").repartition(1 + 4 * seed)
    found = run(df)
    assert found == brute(rows)
    assert any(r[2] for r in found)
    for r in X.remove_repeats(df).collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= 13 for a, b in r.spans)


def test_bytes_that_are_not_utf8_stay(spark):
    part = " ".join(f"CAST(X'{b}' AS STRING)," for b in ["FF61"]) + " ' one two three four five six seven eight nine ten eleven twelve thirteen'"
    df = spark.sql(f"SELECT 1L AS doc_id, concat({part}) AS text UNION ALL SELECT 2L, concat({part}, ' x')")
    out = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in X.remove_repeats(df).selectExpr("doc_id", "n_removed", "cast(kept_text as binary) AS kept").collect()}
    assert out[1][0] == 0 and out[1][1].startswith(b"\xffa one") and out[2] == (14, b"x")


def test_no_rows(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 9, 16):
        assert X.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]


def test_streams_carry_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    k, d = np.sort(rng.integers(0, 40, 300)), rng.integers(0, 9, 300)
    k2 = k.astype(np.int32) % 2
    order = np.lexsort((d, k2, k))
    k, k2, d = k[order], k2[order], d[order]
    low = {x: min(d[k == x]) for x in k}
    for size in (1, 2, 7, 300):
        batches = [pa.record_batch([pa.array(k[a : a + size]), pa.array(k2[a : a + size]), pa.array(d[a : a + size])], names=["key", "key2", "d"]) for a in range(0, 300, size)]
        found = sorted((x, y) for b in X._repeats(iter(batches)) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        assert found == sorted((int(y), int(x)) for x, y in zip(k, d, strict=True) if y > low[x])
        batches = [pa.record_batch([pa.array(k[a : a + size]), pa.array(d[a : a + size]), pa.array(d[a : a + size] == 100)], names=["anchor", "d", "many"]) for a in range(0, 300, size)]
        found = sorted((x, y) for b in X._shared_seeds(iter(batches)) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        assert found == sorted((int(y), int(x)) for x, y in zip(k, d, strict=True) if (k == x).sum() > 1)


def test_chunks_that_differ_from_run_to_run(spark, monkeypatch):
    """Each run of the input gives another row order, so each chunk of few anchors holds other documents."""

    def reorder(batches):
        import pyarrow as pa

        table = pa.Table.from_batches(batches)
        yield from table.take(np.random.default_rng().permutation(table.num_rows)).to_batches()

    for name in ("_seeds", "_extend"):
        monkeypatch.setattr(X, name, partial(getattr(X, name), hold=200))
    rows = corpus(3)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(2).mapInArrow(reorder, "doc_id long, text string")
    assert run(df) == brute(rows)
