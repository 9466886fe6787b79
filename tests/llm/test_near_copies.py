import random
import re
from itertools import combinations

import corpus_pipeline as P
import numpy as np
from tessera.llm import near_copies as N


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[a if rows[a][0] > rows[b][0] else b] = min(a, b, key=lambda k: rows[k][0])
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def corpus(seed):
    """Chains of copies with more and more words changed, one large group, and loose texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for group in range(60):
        words = [word() for _ in range(rng.randint(30, 400))]
        for _ in range(80 if group == 0 else rng.randint(1, 6)):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = word()
    texts += [texts[5].upper(), "", " \n", "one two", "One\ttwo", "two one"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_stage_against_brute_force_jaccard_groups(spark):
    """Nothing goes that brute force keeps; of what it removes, all but the links that share no key by chance."""
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(5)
        out = P.drop_near_copies(spark, df, "")
        assert out.columns == df.columns
        kept, expected = {r.doc_id for r in out.collect()}, set(brute(rows))
        assert expected <= kept and len(rows) - len(kept) >= 0.97 * (len(rows) - len(expected))


def test_near_fingerprints_share_a_key():
    """Up to 23 differing bits of the eight pairs of segments: always."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        one = rng.integers(0, 1 << N.WIDTH, N.SEGMENTS)
        bits = rng.choice(N.SEGMENTS * N.WIDTH, rng.integers(0, 24), replace=False)
        two = one.copy()
        for b in bits.tolist():
            two[b // N.WIDTH] ^= 1 << b % N.WIDTH
        key, row = N.golay_keys(np.stack([one, two]))
        assert set(key[row == 0]) & set(key[row == 1])


def test_probability_of_a_shared_key_at_the_threshold():
    """Random sets of similarity 0.8 share a key and pass the check of their bits."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        every = rng.integers(0, 2**63, 300, dtype=np.uint64)
        one, two = every[:270], np.concatenate([every[:240], every[270:]])
        (x, s), (y, t) = N.fingerprint(np.unique(one)), N.fingerprint(np.unique(two))
        key, row = N.golay_keys(np.stack([x, y]))
        met += bool(set(key[row == 0]) & set(key[row == 1])) and bool(N._may_match(s, t))
    assert met >= 0.93 * 400


def linked(n, sets, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if N.SIMILARITY * len(sets[a] | sets[b]) <= len(sets[a] & sets[b]) + 1e-9:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_large_keys_lose_no_link(spark):
    """Keys above ``most`` give stars and open nodes; the exact pairs complete them."""
    rng = random.Random(3)
    base = [rng.randrange(10**6) for _ in range(150)]
    sets = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 40)):
            own[rng.randrange(len(own))] = rng.randrange(10**6)
        sets.append(set(own))
    every = linked(len(sets), sets, combinations(range(len(sets)), 2))
    rows = [(7, k, -256 | 58) for k in range(len(sets))]
    for most, hold in ((8, 1 << 19), (200, 1 << 19), (8, 30), (8, 1)):
        df = spark.createDataFrame(rows, "key long, node long, sum long").coalesce(1).sortWithinPartitions("key", "node").mapInArrow(lambda b: (x.slice(i, 7) for x in b for i in range(0, x.num_rows, 7)), "key long, node long, sum long")
        found = df.mapInArrow(N._candidates(most, hold), "a long, b long, star boolean").distinct().collect()
        pairs = {(r.a, r.b) for r in found if r.b is not None}
        opened = {r.a for r in found if r.b is None}
        assert all(a < b for a, b in pairs) and (len(pairs) < 1000 if most == 8 else len(pairs) == 120 * 119 // 2)
        roots = linked(len(sets), sets, pairs)
        if opened:
            assert opened == set(range(len(sets)))
            of = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "node long, shingles array<long>")
            others = {(r.a, r.b) for r in N._exact_pairs(of, spark.createDataFrame(list(enumerate(roots)), "node long, root long")).collect()}
            assert all(roots[a] != roots[b] for a, b in others) and len(others) < 120 * 119 // 8
            pairs |= others
        assert linked(len(sets), sets, pairs) == every


def test_recall_against_brute_force(spark):
    """Copies with so many words changed that most pairs are near the threshold."""
    rng = random.Random(8)
    rows, expected = [], 0
    for group in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        rows.append((2 * group, " ".join(words)))
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        rows.append((2 * group + 1, " ".join(words)))
    expected = len(rows) - len(brute(rows))
    found = len(rows) - N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert expected > 50 and 0.9 * expected <= found <= expected


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base + " x"), (None, base), (8, "a b"), (8, "a b"), (2, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.near_dedup(df).collect()) == [2, 3, 8, 8]
    assert N.near_dedup(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, base), (None, base + " x")], "doc_id long, text string")
    assert N.near_dedup(alone).count() == 2


def test_parity_maps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    for _ in range(300):
        every = rng.integers(-(2**63), 2**63, rng.integers(2, 400))
        one, two = (np.unique(rng.choice(every, rng.integers(1, len(every) + 1))) for _ in range(2))
        apart = int(np.bitwise_count((N.parity(one) ^ N.parity(two)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(one, two)) and (apart - len(np.setxor1d(one, two))) % 2 == 0


def test_folders_of_verified_pairs_are_gone_afterwards(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    written = lambda: {os.path.join(d, x) for d, names, _ in os.walk(folder) for x in names if x.startswith("written-")}
    before = written()
    base = " ".join(f"w{i}" for i in range(100))
    assert N.near_dedup(spark.createDataFrame([(1, base), (2, base + " x"), (3, "other words")], "doc_id long, text string")).count() == 2
    assert written() == before
