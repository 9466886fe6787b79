import random
import re

import numpy as np
import xxhash
from tessera.llm import shared
from tessera.llm import simhash as S


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["The", "a", "Été", "x\ty", "fox", "\n"]) for _ in range(n))
        assert S.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_neighbours_share_a_codeword():
    _, table, counts = S.golay()
    assert sorted(set(counts.tolist())) == [1, 6] and (counts == 6).sum() == 1771
    rng = random.Random(2)
    for _ in range(3000):
        u = rng.getrandbits(23)
        v = u
        for b in rng.sample(range(23), rng.randint(0, 2)):
            v ^= 1 << b
        x, y = S.codewords(np.array([u, v]))
        assert set(x[x >= 0]) & set(y[y >= 0])


def test_keys_of_linked_fingerprints_meet():
    rng = random.Random(3)
    for _ in range(2000):
        u = rng.getrandbits(64)
        v = u
        for b in rng.sample(range(64), rng.randint(0, 2)):
            v ^= 1 << b
        found, rows = S.keys(np.array([u, v], dtype=np.uint64))
        assert set(found[rows == 0]) & set(found[rows == 1])


def test_links_connect_the_same_classes_with_small_and_large_buckets(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps), key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    expected = {signed[i]: signed[r] for i, r in enumerate(brute_components(fps))}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (64, 2):
        found = {r.node: r.root for r in shared.components(S.links(df, bucket=bucket)).collect()}
        assert {x: found.get(x, x) for x in signed} == expected


def test_classes_with_nulls_copies_and_no_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.upper()), (4, None), (2, ""), (7, " \n"), (8, "other words entirely here"), (8, "other words entirely here"), (None, base), (11, "two words")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in S.classes(df).collect()}
    f = lambda t: f"{brute_fingerprint(t):016x}"
    assert out == {(5, f(base), 3), (3, f(base), 3), (9, f(base), 3), (None, f(base), 3), (4, "0" * 16, 2), (2, "0" * 16, 2), (7, "0" * 16, 2), (8, f("other words entirely here"), 8), (11, f("two words"), 11)}
    assert S.classes(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    n = 24
    order = list(range(n))
    random.Random(6).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r.root for r in shared.components(edges).collect()} == {0}
