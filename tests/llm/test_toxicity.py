import random
import time

from tessera.llm import toxicity as X
from tessera.llm.shared import bounded_sample


def test_folding():
    assert X.fold("IdiOt") == " idiot "
    assert X.fold("1d10t іdіоt ｉｄｉｏｔ ídïòt id​iot") == " idiot idiot idiot idiot idiot "
    assert X.fold("p@thetic $tupid s!lly a! $5") == " pathetic stupid siiiy a  ss "
    assert X.fold("") == "  " and X.fold("日本 Ώмή") == " 日本 wмn ".replace("м", X.fold("м").strip())


def test_exceptions_switch_matches_off_and_length_lowers_the_score():
    lexicon = X.Lexicon({" trash ": 5.0, " scum": 4.0}, ("trash can",), bias=-3, total_slope=1, rate_slope=1)
    own = lexicon.automaton()
    at = lambda t: [h[2] for h in lexicon.matches(own, X.fold(t))]
    assert at("you trash") == [5.0] and at("the trash can") == [] and at("trash can, TR4SH!") == [5.0]
    assert at("scumbag") == [4.0] and at("trashy") == [] and at("") == []
    short, long = lexicon.strength(own, "trash " + "a " * 10), lexicon.strength(own, "trash " + "a " * 5000)
    assert short[0] == long[0] and short[1] > long[1]


def make(spark, n=1200):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 8)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [word() for _ in range(60)]
        for k in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(["vermin", "verm1n", "zozzo", "zozzone", "zozzino"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = make(spark)
    lexicon = X.train(docs, labels)
    assert " vermin " in lexicon.weights and any(e.startswith(" zozz") for e in lexicon.weights)
    out = X.score(docs, lexicon).collect()
    held = [r for r in out if r.held_out and r.doc_id < 1200]
    assert len(out) == 1202 and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(r.score < 0.5 for r in out if r.doc_id >= 1200)
    blank = X.train(docs, labels.limit(0))
    assert len({r.score for r in X.score(docs, blank).collect()}) == 1
    assert X.score(docs.limit(0), lexicon).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as score", "'x' as held_out")
    assert X.score(clash, lexicon).columns == ["doc_id", "held_out", "score", "predicted"]


def test_phrases_are_learned_to_the_end_of_a_long_text():
    import pyarrow as pa

    text = "trash here " * 1500 + "trash can"
    batch = pa.record_batch([pa.array([1]), pa.array([0]), pa.array([text])], names=["doc_id", "label", "text"])
    (found,) = X._phrases(X.Lexicon({" trash ": 5.0}))(iter([batch]))
    assert "trash can" in found.column(0).to_pylist()


def naive(lexicon, folded):
    """The matcher by plain search."""
    off = [(a, a + len(p)) for p in (f" {x} " for x in lexicon.exceptions) for a in range(len(folded)) if folded.startswith(p, a)]
    best = {}
    for entry, weight in lexicon.weights.items():
        for a in range(len(folded)):
            if folded.startswith(entry, a) and not any(x <= a and a + len(entry) <= y for x, y in off):
                if a not in best or abs(weight) > abs(best[a][2]):
                    best[a] = (a, a + len(entry), weight)
    return best


def test_matches_equal_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        pool = ["ab", "abc", "bca", "cab", "aab", "b"]
        lexicon = X.Lexicon({f" {w} ": 1.0 + k for k, w in enumerate(rng.sample(pool, 3))} | {" abca": 9.0}, tuple({f"{rng.choice(pool)} {rng.choice(pool)}" for _ in range(3)}))
        folded = " " + " ".join(rng.choice([*pool, "abcab"]) for _ in range(40)) + " "
        found = {h[0]: h for h in lexicon.matches(lexicon.automaton(), folded)}
        assert found == naive(lexicon, folded)


def test_many_exceptions_take_linear_time():
    lexicon = X.Lexicon({" trash ": 5.0}, ("trash can",))
    own, folded = lexicon.automaton(), X.fold("trash can " * 8000)
    began = time.time()
    assert lexicon.matches(own, folded) == []
    assert time.time() - began < 0.1


def test_other_scripts_long_words_and_odd_rows(spark):
    rows = [(i, f"{'скамья' if i % 4 else 'жулик' * 6} word{i % 7} here") for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1]), (3, "x " * 400_000), (None, rows[4][1])], "doc_id long, text string")
    lexicon = X.train(docs, spark.createDataFrame([*labels, (5, 1), (5, 0)], "doc_id long, toxic int"))
    out = X.score(docs, lexicon).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out if r.doc_id is not None) and len(out) == 403
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'FF6162' AS STRING) AS text")
    assert X.score(broken, lexicon).count() == 1 and X.train(broken, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights == {}


def test_the_sample_is_bounded(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    some = bounded_sample(rows, 1000, "doc_id")
    assert 800 < some.count() <= 1000 and sorted(some.collect()) == sorted(bounded_sample(rows.repartition(7), 1000, "doc_id").collect())
    assert bounded_sample(rows, 5000, "doc_id").count() == 5000
