import hashlib
import re
from collections import defaultdict

from tessera.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "a  b"), (2, "a b"), (3, "a\n\tb"), (4, " a b"), (5, None), (6, ""), (7, "  "), (8, "é" * 40000), (9, "é" * 40000), (None, "a b"), (None, "only"), (10, "x"), (10, "x"), (11, "x y")]


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for options in ({}, {"budget": 500, "chunk_bytes": 300}):
        rows = X.exact_groups(df, **options).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=repr) == brute(ROWS)
        assert len([r for r in rows if r.kept]) == len({r.text_sha256 for r in rows})
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows if r.doc_id not in (10, None))


def test_recursion_reaches_small_tables():
    rows = [(hashlib.sha256(str(i % 700).encode()).digest(), str(i % 700).encode(), i, 1, None) for i in range(5000)]
    tables = list(X.grace(iter(rows), 4000))
    assert len(tables) > 10
    found = {row[1]: (row[2], row[3]) for t in tables for row in t.rows()}
    assert len(found) == 700 and all(found[str(k).encode()] == (k, 8 if k < 100 else 7) for k in range(700))


def test_equal_digests_with_other_contents_stay_apart():
    table = X.Table()
    table.add(b"d" * 32, b"one", 1, 1)
    table.add(b"d" * 32, b"two", 2, 1)
    table.add(b"d" * 32, b"one", 0, 1)
    assert sorted(table.rows()) == [(b"d" * 32, b"one", 0, 2, None), (b"d" * 32, b"two", 2, 1, None)]


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(i, t, (i or 0) * 1.5, "digest", [i or 0]) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, n double, content string, row_id array<int>").repartition(2)
    kept = X.exact_dedup(df, budget=2000, chunk_bytes=1000)
    assert kept.schema == df.schema
    assert sorted([(r.doc_id, r.text, r.n) for r in kept.collect()], key=repr)[:2] == sorted([(1, "a  b", 1.5), (10, "x", 15.0)], key=repr)
    assert kept.count() == 8
    assert X.exact_dedup(df.limit(0)).count() == 0 and X.exact_groups(df.limit(0)).count() == 0


def test_many_rows_without_an_id_are_spread_and_one_of_each_stays(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 100_000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("text"))
    df = df.union(spark.createDataFrame([(7, "t1"), (7, "t1"), (8, "t1")], "doc_id long, text string"))
    out = X.exact_groups(df)
    sums = out.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"), F.max("group_size").alias("size"), F.max("keep_id").alias("keep")).collect()
    assert len(sums) == len({"same", *(f"t{i % 1000}" for i in range(100_000) if i % 3)}) and all(r.kept == 1 and r.n == r.size for r in sums)
    assert {r.keep for r in sums} == {None, 7}
    assert out.count() == 100_003


def test_bytes_that_are_not_utf8_stay(spark):
    from pyspark.sql import functions as F

    raw = [b"\xff  a", b"\xff a", b"\xc3", b"\xef\xbf\xbd a"]
    df = spark.createDataFrame([(k, bytearray(t), bytearray(b"\xfe" + t)) for k, t in enumerate(raw)], "doc_id long, a binary, b binary").select("doc_id", F.col("a").cast("string").alias("text"), F.col("b").cast("string").alias("lang"))
    for options in ({}, {"budget": 10, "chunk_bytes": 5}):
        rows = X.exact_dedup(df, **options).select("doc_id", F.col("text").cast("binary").alias("a"), F.col("lang").cast("binary").alias("b")).collect()
        assert sorted((r.doc_id, bytes(r.a), bytes(r.b)) for r in rows) == [(k, raw[k], b"\xfe" + raw[k]) for k in (0, 2, 3)]
    found = {r.doc_id: (r.keep_id, r.text_sha256) for r in X.exact_groups(df).collect()}
    assert found[1] == found[0] == (0, hashlib.sha256(raw[1]).hexdigest()) and found[3][0] == 3
