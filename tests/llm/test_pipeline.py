import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from tessera.llm import byte_bpe
from tessera.llm.catalogue import VOCABULARY

from .test_mixing import brute_targets
from .test_near_copies import brute as brute_near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeiorstn") for _ in range(rng.randint(2, 9)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(40, 160))]
        if i % 8 == 0:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["vermin", "v3rmin", "Vermin!"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 8 == 0)))
    texts += [texts[k] for k in (1, 1, 2, 3, 3)] + [texts[5].replace(" ", "\n", 3), texts[6] + " x", None, "", "one two"]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c"]), len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def test_each_stage_by_brute_force(spark, tables):
    rows, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = []
    for _, stage in P.STAGES:
        out = stage(spark, docs, folder).collect()
        outputs.append(out)
        if len(outputs) < len(P.STAGES):
            assert set(out[0].asDict()) == {c.split()[0] for c in COLUMNS.split(", ")}
            docs = spark.createDataFrame(out, COLUMNS)
    kept = [r.doc_id for r in outputs[0]]
    assert sorted(kept) == [i for i, *_ in rows if i >= 400 or i % 8]
    text_of = {i: t for i, t, *_ in rows}

    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join((text_of[i] or "").split()), i)
    assert sorted(r.doc_id for r in outputs[1]) == sorted(first.values())

    ids = sorted(first.values())
    alone = brute_near_copies([(i, text_of[i]) for i in ids])
    assert sorted(r.doc_id for r in outputs[2]) == alone

    source_of, size = {i: s for i, _, _, s, _ in rows}, {i: len((text_of[i] or "").split()) for i in alone}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in alone:
        sizes[source_of[i]] += size[i]
    copies = Counter(r.doc_id for r in outputs[3])
    for i, n in copies.items():
        assert i in size and n <= 3
        taken[source_of[i]] += n * size[i]
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= max(60, 0.02 * target)

    own = byte_bpe.codec(VOCABULARY)
    assert Counter(r.doc_id for r in outputs[4]) == copies
    for r in outputs[4]:
        assert list(r.ids) == own.encode(text_of[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text_of[r.doc_id] or "").encode()).hexdigest()

    ran = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in ran) == Counter((r.doc_id, r.n_tokens) for r in outputs[4])



def test_stages_with_no_rows_and_with_nulls(spark, tables):
    _, folder = tables
    odd = [(None, None, None, None, None), (1, None, None, None, None), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (2, "x" * 200_000, None, "s", None), (3, " \n ", "en", "s", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, COLUMNS)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= 3 * len(rows), name
        wide = docs.selectExpr("*", "1 AS row", "'x' AS id", "2 AS score", "3 AS node", "4 AS copy", "5 AS `in_map`", "6 AS `key`")
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, wide, folder)
            assert out.columns == wide.columns and {(r.id, r.row) for r in out.collect()} <= {("x", 1)}, name
        assert P.STAGES[-1][1](spark, docs, folder).count() == len(rows)
