import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import quality_model as M
from tessera.llm import quality_rules as R
from tessera.llm.text_stats import measured

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_lines": sum(bool(WORD.search(x)) for x in text.split("\n")),
        "n_distinct_words": len(set(words)),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_chars": len(text),
        "n_symbol_words": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words),
    }


def check(texts):
    column = pa.array(texts, pa.string())
    for first, last, _, found in measured(column):
        for k in range(first, last):
            expected = brute(texts[k] or "")
            assert {m: int(found[m][k - first]) for m in expected} == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|\n\t ", max_size=40), max_size=5))
def test_measurements_equal_brute_force(texts):
    check(texts)


def test_long_and_empty_texts():
    check(["", None, " \n ", "a b c " * 3000, "é " * 700000 + "x", "a", "A\nA\nA"])


def test_ledger_policies_and_ablations(spark):
    rows = [(1, "clean words of some length " * 3 + " ".join("w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)), "x", 5), (2, "a b c " * 40, "y", 6), (3, None, None, 7), (4, " ".join("w" + "abcdefghij"[i % 10] * (1 + i // 10) + "$$" for i in range(80)), "z", 8), (4, "", "z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, failures string, n_words int")
    ledger = R.ledger(df)
    kept = {(r.doc_id, r.n_words): r.kept for r in R.apply_policy(ledger, R.POLICIES["web-1"]).collect()}
    assert kept == {(1, 75): True, (2, 120): False, (3, 0): False, (4, 80): False, (4, 0): False}
    found = {r.rule: r for r in R.ablations(ledger, R.POLICIES["web-1"]).collect()}
    assert found["symbol_words"].n_failed_alone == 1 and found["symbol_words"].n_kept_without == 2
    assert found["few_words"].n_docs == 5 and found["few_words"].n_failed == 2
    assert R.ledger(df.limit(0)).count() == 0


def test_square_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = M.Machine(0.3, rng.normal(size=M.SIZE).astype(np.float32), rng.normal(size=(M.SIZE, 3)).astype(np.float32))
    places, x = np.array([5, 9, 70000 % M.SIZE, 12]), np.array([0.5, 1.0, -0.7, 2.0], np.float32)
    expected = 0.3 + float(machine.w[places] @ x) + sum(float(machine.v[places[i]] @ machine.v[places[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert machine.raw(np.zeros(4, int), places, x, 1)[0] == pytest.approx(expected, rel=1e-4)


def test_held_out_accuracy(spark):
    import random

    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    rows = [(i, good() if i % 4 else re.sub(" ", "$$ ", good())) for i in range(600)]
    docs = spark.createDataFrame([*rows, (700, None), (701, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(9999, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = M.score(docs, M.train(docs, labels)).collect()
    held = [r for r in out if r.held_out and r.doc_id < 700]
    assert len(out) == 602 and held and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    blank = M.score(docs, M.train(docs, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}
    odd = spark.createDataFrame([(3, "a b " * 300_000, 1, "x"), (3, "a b", 2, "y"), (3, "a b", 2, "y"), (None, "a b", 3, None)], "doc_id long, text string, score int, label string")
    scored = M.score(odd, M.train(odd, spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, quality int")))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == 4
    assert len({r.score for r in scored.collect()}) == 2
    same = [M.score(docs, M.train(docs.repartition(n), labels)).collect() for n in (1, 5)]
    assert {r.doc_id: r.score for r in same[0]} == {r.doc_id: r.score for r in same[1]}
    assert M.score(docs.limit(0), M.fit([])).count() == 0
