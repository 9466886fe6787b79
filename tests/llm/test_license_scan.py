"""Licence findings against brute force over places of phrases, and spans of altered texts."""

import random
import re

import pytest
from tessera.llm import license_scan, license_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(license_scan._UPPER, license_scan._LOWER)


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(k, label) for said, label in license_texts.PHRASES for k in range(len(words)) if words[k : k + len(said.split())] == said.split()]
    starts = [k for k, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def scanned(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(df, **more).collect()}


def test_base_findings_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["MIT", "mit", "license", "Licence", "License,", "apache", "general", "public", "é", "4.0", "\n", " ", " ", " ", "-", "K", "İ"]
    texts = ["", None, "mit", "MIT-LICENSE", "mit license" * 3, "mit license " * 50, "general public license general public license", "the apache\nlicense", "mitlicense", "mit licensé", "mit licenſe", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(300)]]
    found = scanned(spark, texts)
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_every_template_is_found_whole_and_with_words_changed(spark):
    rng, texts, wanted = random.Random(2), [], []
    for said, label in license_texts.TEXTS:
        words = said.split()
        texts.append("some words before it\n" + said + "\nand some after")
        wanted.append(label)
        if len(words) > 40:
            out = rng.randrange(10, len(words) - 10)
            texts += [" ".join(words[:out] + words[out + 2 :]), " ".join([*words[:out], "new", "words", *words[out:]])]
            wanted += [label] * 2
    found = scanned(spark, texts)
    for k, label in enumerate(wanted):
        assert label in found[k].labels.split(","), texts[k]
    spread = "\n".join(" filler".join([x, *["."] * 30]) for x in license_texts.TEXTS[9][0].split())
    assert scanned(spark, [spread])[0].labels == ""


@pytest.mark.parametrize("gap, labels", [(0, ""), (8, "own")])
def test_neighbouring_diagonals_are_merged_within_the_gap_only(spark, gap, labels):
    words = [f"w{k}" for k in range(20)]
    of = [(0, "own", False, 3, gap, words)]
    shifted = " ".join([*words[:10], "x", "y", *words[10:]])
    found = scanned(spark, [shifted, " ".join(words)], of=of)
    assert found[0].labels == labels and found[1].labels == "own" and found[1].score == 1.0
    assert found[0].score == pytest.approx((16 if gap else 8) / 18)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, "MIT License", 1, "x", 0.0)] * 2 + [(3, None, 1, "x", 0.0), (4, "word " * 200_000 + "apache license " * 20_000, 1, "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, template string, score double")
    out = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in license_scan.scan(df).collect()), key=repr)
    assert out == sorted([(None, 2, 1, 0, 0, "mit"), (None, 2, 1, 0, 0, "mit"), (3, 0, 0, None, None, ""), (4, 240_000, 20_000, 200_000, 239_998, "apache")], key=repr)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
