import json
"""Ingest, questions and upkeep end to end, with the built-in generator and embedder."""

import subprocess

import numpy as np
import pytest
from tessera.operators import generate, index, search
from tessera.plans import cli
from tessera.plans.engine import Engine
from tessera.scope import PACKAGE, Scope, ScopeError, guard

FILES = {
    "app/main.py": "# Starts the invoice server.\nfrom app.billing import charge\n\n\ndef serve():\n    # TODO: add shutdown\n    return charge(1)\n",
    "app/billing.py": "# Charges customers.\n\n\ndef charge(amount):\n    return amount\n",
    "app/__init__.py": "",
    "web/index.js": "// Renders the page.\nfunction render() {\n  return 1\n}\n",
    "utils.py": "def helper():\n    pass\n",
    "utils/x.py": "def x():\n    pass\n",
}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git(tmp_path, "init", "-q", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-qm", "first commit")
    return Engine(spark, Scope(str(tmp_path / "vault"), str(tmp_path / "index"), str(root)), today="2024-05-06"), root, tmp_path


def test_ingest_questions_and_upkeep(engine):
    own, root, tmp_path = engine
    assert own.dry_run() == {"files": 5, "directories": 3, "calls": 8}
    assert own.estimate_cost().startswith("6 files (.py 5, .js 1), 3 directories, ")
    counts = own.ingest(extra={"team": "core"})
    assert counts["notes"] == 9 and counts["warnings"] == 0 and counts["questions"] >= 5
    note = (tmp_path / "vault/app/main.md").read_text()
    assert "- [[app/billing]]" in note and "team: core" in note and "Starts the invoice server" in note
    assert "type: directory" not in (tmp_path / "vault/utils.md").read_text()  # the file's note is written last
    before = own.index().rows().count()
    own.ingest(reuse=True)
    assert own.index().rows().count() == before  # writing the same again changes nothing
    (tmp_path / "vault/app/billing.md").unlink()
    written = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "vault").rglob("*.md")}
    files = written()
    own.ingest(reuse=True)
    again = written()
    assert files.items() <= again.items() and set(again) - set(files) == {tmp_path / "vault/app/billing.md"}  # only what is missing

    hits = own.search("What does charge do and where is it used?").collect()
    assert hits[0].file_path == "app/billing.py" and hits[0].confidence == "high" and hits[0].distance < 1e-6
    assert "care" in own.search_code("charge", most=-1.0) and "care" not in own.search_code("charge")
    overview = own.explore_repo(2)
    assert overview.splitlines()[2].startswith("**INDEX**") and "  **app**" in overview
    assert "line 6 [TODO]" in own.find_todos("What does serve do and where is it used?") and "first commit" in own.find_todos("serve")
    assert "app/billing.md" in own.vault_append("What does charge do and where is it used?")
    assert own.read_note("app/main.md").startswith("---") and "no note" in own.read_note("none")
    assert own.active_scope().count("[OK]") == 3 and own.read_guidelines(str(tmp_path / "none")).startswith("No guidelines")

    (root / "app/billing.py").write_text("# Refunds customers.\n\n\ndef refund(amount):\n    return -amount\n")
    (root / "app/new.py").write_text("def fresh():\n    pass\n")
    (root / "web/index.js").unlink()
    git(root, "mv", "utils.py", "tools.py")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "second commit")
    assert own.sync() == "New: 2\n  - app/new.py\n  - tools.py\nModified: 1\n  - app/billing.py\nDeleted: 2\n  - utils.py\n  - web/index.js"
    assert own.sync(dry_run=False).startswith("1 modified (1 rewritten), 2 new, 2 deleted; now at ")
    note = (tmp_path / "vault/app/billing.md").read_text()
    assert "Refunds customers" in note and "## 🔄 Sync Log\n- 2024-05-06 — commit " in note
    assert "new file added" in (tmp_path / "vault/app/new.md").read_text() and not (tmp_path / "vault/web/index.md").exists()
    files = {r.file_path for r in own.index().rows().collect()}
    assert "web/index.js" not in files and "app/new.py" in files and "team: core" not in (tmp_path / "vault/app/new.md").read_text()
    assert own.sync() == "New: 0\nModified: 0\nDeleted: 0"
    assert own.rebuild()["questions"] == own.index().rows().count()


def test_index_of_another_model_is_refused(spark, tmp_path):
    questions = spark.createDataFrame([("a.py", 1, 10, "Where is it?")], "rel_path string, start_line int, end_line int, question string")
    first = index.VectorIndex(spark, str(tmp_path / "i"), index.HashingEmbedder(64))
    assert first.search("anything").collect() == []
    first.replace(index.embedded(questions, first.embedder))
    assert first.search("Where is it?").collect()[0].file_path == "a.py"
    with pytest.raises(index.IndexMismatch, match="not a scope problem"):
        index.VectorIndex(spark, str(tmp_path / "i"), index.HashingEmbedder(32)).search("x")


def test_generator_is_tried_three_times():
    class Failing:
        concurrency, calls = 1, 0

        def __init__(self, failures):
            self.failures = failures

        def available(self):
            return True

        def generate(self, prompts):
            self.calls += 1
            if self.calls <= self.failures:
                raise OSError("down")
            return [f" {p} " for p in prompts]

    pauses = []
    assert generate.call(Failing(1), ["a"], pauses.append) == ["a"] and pauses == [1.0]
    with pytest.raises(RuntimeError, match="3 times"):
        generate.call(Failing(9), ["a"], pauses.append)
    assert pauses == [1.0, 1.0, 2.0]


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    queries = df.filter("vec_id < 6").selectExpr("vec_id as query_id", "embedding")
    unit = vectors.astype(np.float32) / np.linalg.norm(vectors.astype(np.float32), axis=1, keepdims=True)
    for r in search.top_k(queries, df, 4).collect():
        d = 1 - unit @ unit[r.query_id]
        assert r.distance == pytest.approx(d[r.vec_id], abs=1e-5) and (d < r.distance - 1e-5).sum() < r.rank
    assert search.top_k(queries, df.limit(0), 4).count() == 0 and search.top_k(queries, df.limit(2), 4).count() == 12


def test_scope_and_command_line(tmp_path, monkeypatch, capsys):
    with pytest.raises(ScopeError):
        guard(str(PACKAGE / "plans"))
    assert guard(str(tmp_path)) == str(tmp_path)
    monkeypatch.delenv("VAULT_ROOT", raising=False)
    with pytest.raises(ScopeError, match="VAULT_ROOT"):
        Scope().get("vault_root")
    monkeypatch.setenv("VAULT_ROOT", str(tmp_path))
    assert Scope().get("vault_root") == str(tmp_path) and Scope(vault_root="/x").get("vault_root") == "/x"
    assert Scope(str(PACKAGE), None, "/r").status()[0][2] == "SELF-SCOPE" and Scope(index_path=None).status()[1][2] in ("MISSING", "OK")
    assert cli.pairs(["a=1", "b = x=y ", "bad"]) == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        cli.json_object("[1]")
    assert cli.main(["init"]) == 0 and "REPO_ROOT" in capsys.readouterr().out


def test_search_goes_on_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.random.default_rng(4).normal(size=(60, 8)))], "vec_id long, embedding array<float>").repartition(3)
    queries = df.filter("vec_id < 25").selectExpr("vec_id as query_id", "embedding")
    rows = lambda: sorted((r.query_id, r.rank, r.vec_id, round(r.distance, 9)) for r in search.top_k(queries, df, 4).collect())
    whole = rows()
    monkeypatch.setattr(search, "MOST_QUERIES", 10)
    assert len(whole) == 100 and rows() == whole


def test_process_generator():
    import sys

    echo = generate.Process([sys.executable, "-c", "import sys; print(' ' + sys.stdin.read().upper())"], 2)
    assert echo.available() and echo.generate(["a", "b"]) == ["A", "B"]
    failing = generate.Process([sys.executable, "-c", "import sys; sys.exit('no model')"])
    with pytest.raises(RuntimeError, match="3 times.*no model"):
        generate.call(failing, ["a"], lambda _: None)
    assert not generate.Process(["no-such-program-here"]).available()


def test_searches_without_queries_or_with_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [1.0, None])], "vec_id long, embedding array<float>")
    queries = df.selectExpr("vec_id as query_id", "embedding")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in search.top_k(queries, df, 2).collect())
    assert found == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (4, 1, 4), (5, 1, 1), (5, 2, 2)]
    assert search.top_k(queries.limit(0), df, 2).count() == 0 and search.top_k(queries.filter("query_id = 3"), df, 2).count() == 0


def test_ties_at_the_last_rank_go_by_place(spark, tmp_path):
    rows = [("b.py", 1), ("a.py", 9), ("a.py", 1), ("c.py", 1)]
    questions = spark.createDataFrame([(f, n, n, "Where is it?") for f, n in rows], "rel_path string, start_line int, end_line int, question string")
    own = index.VectorIndex(spark, str(tmp_path / "i"), index.HashingEmbedder(64))
    assert own.upsert(index.embedded(questions, own.embedder)) == 4 and own.upsert(index.embedded(questions.limit(1), own.embedder)) == 1
    assert [(r.file_path, r.start_line) for r in own.search("Where is it?", 2).collect()] == [("a.py", 1), ("a.py", 9)]
    assert own.search("?!", 9).count() == 4 and not (tmp_path / "i/index.json.new").exists()


def test_tool_server(spark, tmp_path):
    import io

    from tessera.plans import tools

    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_active_scope", "arguments": {"vault_root": str(tmp_path)}}}, {"id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 5, "method": "tools/call", "params": {"name": "estimate_cost", "arguments": {"repo_root": str(tmp_path / "none")}}}]
    out = io.StringIO()
    tools.Server(spark).serve(io.StringIO("\n".join(map(json.dumps, asked))), out)
    replies = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert len(replies) == 5 and len(replies[2]["result"]["tools"]) == 10
    assert "[OK]" in replies[3]["result"]["content"][0]["text"] and "error" in replies[4] and replies[5]["result"]["isError"]


def test_todos_keep_every_hit_in_order():
    from types import SimpleNamespace as R

    from tessera.plans import render

    text = render.todos(["b.py", "a.py"], [R(file_path="a.py", line_number=3, tag="TODO", text="x")], [])
    assert text.index("### b.py") < text.index("### a.py") and "- no markers" in text and "line 3 [TODO] x" in text


def test_a_prompt_is_asked_once(spark, tmp_path):
    """Over two runs, with repeated prompts, in rounds of few tasks, and from where a run was cut off."""
    from pyspark.sql import functions as F

    class Counting:
        concurrency, name = 2, "counting"

        def __init__(self, calls, broken=None):
            self.calls, self.broken = calls, broken

        def available(self):
            return True

        def generate(self, prompts):
            import uuid

            if self.broken and any(self.broken in p for p in prompts):
                raise OSError("down")
            (self.calls / uuid.uuid4().hex).write_text("\n".join(prompts))
            return [f"answer to {p}" for p in prompts]

    calls = tmp_path / "calls"
    calls.mkdir()
    asked = lambda: [p for f in calls.iterdir() for p in f.read_text().split("\n")]
    store = generate.AnswerStore(spark, str(tmp_path / "answers"), per_task=5)
    rows = spark.range(60).select("id", (F.col("id") % 30).cast("string").alias("p"))
    with pytest.raises(RuntimeError, match="of 30 new prompts are answered and kept.*3 times"):
        generate.answers(rows, F.concat(F.lit("q"), "p"), Counting(calls, "q7"), store=store)
    kept = store.known(Counting(calls)).count()
    assert kept == len(set(asked())) < 30
    before = len(asked())
    for _ in range(2):
        out = generate.answers(rows, F.concat(F.lit("q"), "p"), Counting(calls), store=store).collect()
        assert len(out) == 60 and all(r.reply == f"answer to q{r.p}" for r in out)
    assert set(asked()) == {f"q{k}" for k in range(30)} and len(asked()) <= 30 + before
    known = store.known(Counting(calls)).count()
    more = rows.union(spark.createDataFrame([(99, "new")], "id long, p string"))
    n = len(asked())
    assert generate.answers(more, F.concat(F.lit("q"), "p"), Counting(calls), store=store).count() == 61
    assert known == 30 and asked().count("qnew") == 1 and len(asked()) == n + 1
    assert generate.AnswerStore(spark, str(tmp_path / "answers"), version="2").known(Counting(calls)).count() == 0


def test_a_failure_at_the_third_file_leaves_two_done(spark, tmp_path):
    class Third:
        concurrency, name = 1, "third"

        def __init__(self, calls, broken):
            self.calls, self.broken = calls, broken

        def available(self):
            return True

        def generate(self, prompts):
            import uuid

            if self.broken and len(list(self.calls.iterdir())) + len(prompts) > 2:
                raise OSError("quota")
            for p in prompts:
                (self.calls / uuid.uuid4().hex).write_text(p)
            return [p.upper() for p in prompts]

    calls = tmp_path / "calls"
    calls.mkdir()
    files = spark.createDataFrame([(f"f{k}.py", f"text {k}") for k in range(5)], "rel_path string, text string")
    store = generate.AnswerStore(spark, str(tmp_path / "answers"))
    with pytest.raises(RuntimeError, match="^2 of 5 new prompts are answered and kept.*quota"):
        generate.file_summaries(files, Third(calls, True), store)
    assert store.known(Third(calls, True)).count() == len(list(calls.iterdir())) == 2
    made = generate.file_summaries(files, Third(calls, False), store)
    assert made.count() == 5 and len(list(calls.iterdir())) == 5 and made.filter("summary LIKE 'SUMMARISE%'").count() == 5
