"""The parallel scan against a plain one, and every case of the texts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import fill_middle
from tessera.llm.automaton import Automaton, Scan

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("width", [1, 2, 3, 64])
def test_scan_of_lanes_equals_one_byte_at_a_time(width):
    rng = np.random.default_rng(7)
    machine = Automaton(rng.integers(0, 5, (5, 256)), rng.random((2, 5, 256)) < 0.3)
    sizes = [0, 1, 2, 3, 64, 65, 200, 0, 7]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    scan = Scan(machine, data, offsets, width)
    to, counts = scan.functions()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for begin in range(5):
            state, seen, places = begin, [0, 0], []
            for k, byte in enumerate(data[a:b].tolist()):
                at = state * 257 + byte
                for kind in range(2):
                    seen[kind] += int(machine.emits[kind][at])
                if machine.emits[1][at]:
                    places.append(k)
                state = int(machine.to[at])
            assert (to[begin, i], *counts[:, begin, i]) == (state, *seen)
            n = len(places)
            assert scan.nth_event(1, np.full(n, i), np.full(n, begin), np.arange(1, n + 1)).tolist() == places


def texts():
    rng = random.Random(3)
    pieces = ["a", "<", "P", "S", "M", ">", " ", "\n", "é", "日", " ", "word", "\t\t", "<S", "<P>"]
    made = ["".join(rng.choice(pieces[: rng.choice([11, 13, 15])]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return ["", None, " ", "\n \t", "one", " one", "one ", "<P>", "<P >", "a <M> b", "x" * 500, " " * 500, "word " * 400, "é " * 300, "ab<" * 90 + "S>", *made]


def rows_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.fill_in_middle(df, **more)
    return out.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form")))


@pytest.mark.parametrize("chunk", [5, 64, fill_middle.CHUNK])
def test_equals_brute_force_whatever_the_chunk(spark, chunk):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in rows_of(spark, rows, chunk=chunk, rate=90).collect()}
    assert len(found) == len(rows)
    forms = set()
    for k, text in rows:
        r = found[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(k, text, 90), (k, text)
        assert r.restored == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "spm", "psm"}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d " * 20, 1, "x", "y")] * 3 + [(5, "q w e r t y " * 9, 2, "x", "y")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, output string, key string")
    out = fill_middle.fill_in_middle(df, chunk=8).collect()
    assert len(out) == 203 and out[0].__fields__ == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, rows[0][1] if r.doc_id is None else rows[3][1])
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_bytes_that_are_not_utf8_come_back(spark):
    raw = b"\xff<P \xc3 ab \x80 cd ef gh " * 20
    df = spark.createDataFrame([(k, bytearray(raw)) for k in range(12)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    for chunk in (16, 1 << 16):
        out = fill_middle.fill_in_middle(df, rate=100, chunk=chunk)
        back = out.select("form", "n", fill_middle.restore(F.col("output"), F.col("form")).cast("binary").alias("raw")).collect()
        assert {bytes(r.raw) for r in back} == {raw} and {r.n for r in back} == {len(re.findall(rb"[^ ]+", raw)) + 1} and len(back) == 12


def test_giant_text_in_many_chunks(spark):
    text = "lorem ipsum  dolor\n" * 150_000 + "end"
    r = rows_of(spark, [(1, text), (2, "<" * 2_000_000)], rate=100).collect()
    for x in r:
        want = expected(x.doc_id, text if x.doc_id == 1 else "<" * 2_000_000, 100)
        assert (x.n, x.form, x.prefix_chars, x.middle_chars) == want[:4] and x.output == want[4]
