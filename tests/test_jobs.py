"""Both jobs over growing copies of tables: what is new is taken, reruns change nothing, and the results equal a fresh build."""

import os
import subprocess
import sys

import duckdb
import pytest
from jobs import catalogue, common, note_vault, task_feed
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def add(spark, folder, rows, mode="append"):
    spark.createDataFrame([(*r, 0) for r in rows], DOCUMENTS).coalesce(1).write.mode(mode).parquet(folder)


def tasks(spark, out):
    return sorted(((r.doc_id, r.line_number, r.tag, r.text) for r in task_feed.open_tasks(task_feed.feed(spark, out)).collect()), key=repr)


def test_feed_takes_only_new_files_and_the_newest_text_counts(spark, tmp_path):
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    run = lambda: task_feed.run(spark, source, out, progress)
    add(spark, source, [(1, "x\n  # TODO one\nHACK", "en", "a"), (2, None, None, None), (3, "FIXME it", "", "b"), (None, "TODO a", "en", "c"), (None, "TODO b", "en", "c")])
    assert run() == {"batches": 1, "rows_read": 5, "rows_in_feed": 5, "tasks_in_feed": 5}
    assert run()["rows_read"] == 0
    first = [(1, 2, "TODO", "# TODO one"), (1, 3, "HACK", "HACK"), (3, 1, "FIXME", "FIXME it"), (None, 1, "TODO", "TODO a"), (None, 1, "TODO", "TODO b")]
    assert tasks(spark, out) == sorted(first, key=repr)
    add(spark, source, [(1, "all done", "en", "a"), (3, "FIXME it", "", "b"), (4, "TODO " * 3, "1", "d")])  # changed, delivered again, new
    assert run()["rows_read"] == 3
    after = [(3, 1, "FIXME", "FIXME it"), (4, 1, "TODO", "TODO TODO TODO"), (None, 1, "TODO", "TODO a"), (None, 1, "TODO", "TODO b")]
    assert tasks(spark, out) == sorted(after, key=repr) and run()["batches"] == 0 and tasks(spark, out) == sorted(after, key=repr)
    assert {r.language for r in task_feed.feed(spark, out).select("language").distinct().collect()} == {"en", "none", "1"}
    assert {r.lang for r in task_feed.open_tasks(task_feed.feed(spark, out)).select("lang").collect()} == {"", "1", "en"}


def test_feed_reads_an_empty_table_and_further_columns(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS + ", arrived string, tasks string").write.parquet(str(tmp_path / "in"))
    assert task_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "p"))["rows_in_feed"] == 0
    spark.createDataFrame([(1, "TODO", "en", "a", 1, "x", "y")], DOCUMENTS + ", arrived string, tasks string").write.mode("append").parquet(str(tmp_path / "in"))
    assert task_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "p"))["tasks_in_feed"] == 1


@needs_tables
def test_feed_of_a_table_that_arrives_in_parts_equals_one_run_over_all(spark, tmp_path):
    docs, parts = spark.read.parquet(f"{DATA}/documents.parquet"), str(tmp_path / "parts")
    for k in range(3):
        docs.filter(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(parts)
        task_feed.run(spark, parts, str(tmp_path / "a"), str(tmp_path / "pa"), markers=catalogue.MARKERS)
    task_feed.run(spark, parts, str(tmp_path / "b"), str(tmp_path / "pb"), markers=catalogue.MARKERS, files_per_batch=1)
    assert tasks(spark, str(tmp_path / "a")) == tasks(spark, str(tmp_path / "b")) != []


def vault(spark, path):
    return {r.path: (r.node_type, r.content) for r in note_vault.live(spark, path).collect()}


def files_below(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_vault_writes_only_the_buckets_that_differ(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "vault")
    rows = [(k, f"\n  text {k}  \nTODO {k}", "en", f"s{k % 3}") for k in range(60)]
    run = lambda: note_vault.run(spark, source, out, buckets=16)
    add(spark, source, rows)
    assert run() == {"added": 64, "modified": 0, "deleted": 0, "buckets": 16}
    chars = sum(len(r[1]) for r in rows if r[3] == "s0")
    assert vault(spark, out)["en/s0"] == ("directory", f"---\ntype: directory\npath: en/s0\n---\n\n20 files, {chars} characters, 20 open tasks\n")
    assert "text 7" in vault(spark, out)["en/s1/d7.md"][1]
    before = files_below(tmp_path / "vault")
    assert run() == {"added": 0, "modified": 0, "deleted": 0, "buckets": 0} and files_below(tmp_path / "vault") == before

    rows = [r for r in rows if r[0] not in (5, 6)] + [(100, "new", "fr", "z")]
    rows[0] = (0, "\n  text 0  \nTODO x", *rows[0][2:])
    add(spark, source, rows, "overwrite")
    counts = run()
    assert (counts["added"], counts["deleted"]) == (3, 2) and counts["modified"] == 3  # en, en/s0, en/s2 by their totals; note 0 says the same as before
    changed = {p for p, at in files_below(tmp_path / "vault").items() if before.get(p) != at}
    assert len({p.split("bucket=")[1].split("/")[0] for p in changed}) == counts["buckets"] < 16
    fresh = str(tmp_path / "fresh")
    note_vault.run(spark, source, fresh, buckets=16)
    assert vault(spark, out) == vault(spark, fresh)


def test_vault_heals_a_run_that_was_cut_off(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "vault")
    add(spark, source, [(k, f"text {k}", "en", "s") for k in range(40)])
    note_vault.run(spark, source, out, buckets=8)
    whole = vault(spark, out)
    old = spark.createDataFrame(common.stored(spark, out, note_vault.VAULT).filter("bucket < 3").collect(), note_vault.VAULT)
    old.withColumn("content", F.lit("stale")).withColumn("digest", F.lit("stale")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
    counts = note_vault.run(spark, source, out, buckets=8)
    assert counts["modified"] == old.count() and counts["buckets"] == 3 and vault(spark, out) == whole


def test_vault_of_nulls_repeats_and_no_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "vault")
    add(spark, source, [(None, None, None, None), (1, "a", "en", "s"), (1, "b", "en", "s"), (1, "b", "en", "s"), (2, "", "en", "s"), (3, "x" * 300_000, "en", "s")])
    note_vault.run(spark, source, out)
    found = vault(spark, out)
    assert set(found) == {"none", "none/none", "none/none/dnone.md", "en", "en/s", "en/s/d1.md", "en/s/d2.md", "en/s/d3.md"}
    assert "\nb\n" in found["en/s/d1.md"][1] and "placeholder" in found["en/s/d2.md"][1] and "3 files, 300001 characters" in found["en/s"][1]
    add(spark, source, [], "overwrite")
    assert note_vault.run(spark, source, out)["deleted"] == 8 and vault(spark, out) == {}
    assert note_vault.run(spark, source, out)["buckets"] == 0


def test_settings(tmp_path):
    (tmp_path / "x.toml").write_text("buckets = 3\n")
    assert common.settings(note_vault.DEFAULTS, str(tmp_path / "x.toml"))["buckets"] == 3
    assert common.settings(note_vault.DEFAULTS, os.path.join(os.path.dirname(note_vault.__file__), "note_vault.toml")) == note_vault.DEFAULTS
    assert common.settings(task_feed.DEFAULTS, os.path.join(os.path.dirname(note_vault.__file__), "task_feed.toml")) == task_feed.DEFAULTS
    with pytest.raises(ValueError, match="unknown settings: buckets"):
        common.settings(task_feed.DEFAULTS, str(tmp_path / "x.toml"))


@needs_tables
def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.note_vault", f"{DATA}/documents.parquet", str(tmp_path / "vault"), "--config", "jobs/note_vault.toml", "--checkpoints", str(tmp_path / "cp")], cwd=root, capture_output=True, text=True, timeout=180, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "added" in done.stderr and list((tmp_path / "vault").glob("bucket=*/part-*"))


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    found = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [df.columns.index(c) for c in found.columns]
    assert sorted(tuple(r[k] for k in at) for r in df.collect()) == sorted(found.fetchall())
