"""Sources, imports, chunks, graph and notes on small repositories; expected values by hand."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import chunks, graph, imports, languages, notes, python_source, traverse
from tessera.sources import summaries
from tessera.sources.tree import lenient_text, source_files


def make(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "suffix", "parent", "bare"),
    [("a/b.py", ".py", "a", "a/b"), ("b.tar.gz", ".gz", ".", "b.tar"), (".hidden", "", ".", ".hidden"), ("a/.x", "", "a", "a/.x"), ("v1.2/m.py", ".py", "v1.2", "v1.2/m"), ("v1.2", ".2", ".", "v1")],
)
def test_paths(spark, path, suffix, parent, bare):
    p = F.col("p")
    assert one(spark, F.struct(P.suffix(p), P.parent(p), P.without_suffix(p)), p=path) == (suffix, parent, bare)


def test_normalise_and_snake(spark):
    for raw, expected in [("a/../b", "b"), ("./a//b/.", "a/b"), ("../a", None), ("a/../../b/..", None), ("/a", None), ("a/..", ".")]:
        assert one(spark, P.normalise(F.col("p")), p=raw) == expected
    assert one(spark, P.snake_case(F.col("p")), p="MyAppHTTP") == "my_app_h_t_t_p"
    assert one(spark, P.ancestors(F.col("p")), p="a/b/c.py") == ["a", "a/b"]


def test_scan_sees_hidden_and_empty_files_and_prunes(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x=1", "__init__.py": "", "pkg/__init__.py": "", ".dot.py": "y", "bad.py": b"\xff\xfeok", ".git/config": "n", "sub/node_modules/x.js": "n", "z.unknown": "?"})
    rows = {r.rel_path: r for r in source_files(spark, root).collect()}
    assert set(rows) == {"a.py", "__init__.py", "pkg/__init__.py", ".dot.py", "bad.py", "z.unknown"}
    assert rows["bad.py"].text is None and not rows["bad.py"].is_utf8 and rows["__init__.py"].text == ""
    assert {r.rel_path for r in languages.supported(source_files(spark, root)).collect()} == {"a.py", "__init__.py", "pkg/__init__.py", ".dot.py", "bad.py"}
    ordered = [r.rel_path for r in source_files(spark, make(tmp_path / "o", {"a/Z": "", "a/b": "", "a-b": "", "a.py": ""})).orderBy("parts").collect()]
    assert ordered == ["a/Z", "a/b", "a-b", "a.py"]
    assert source_files(spark, root).filter("rel_path = 'bad.py'").select(lenient_text("content").alias("t")).first().t == "ok"


CASES = [
    ("js", {"m/a.ts": "import x from './b'\nexport * from '../c.js';\nconst d = require('./dir')\nimport 'react'\nimport './gone'\nimport y from './foo.service'", "m/b.ts": "", "c.js": "", "m/dir/index.js": "", "m/foo.js": ""}, "m/a.ts", ["m/b.ts", "c.js", "m/dir", "m/foo.js"], ["./gone"]),
    ("go", {"cmd/main.go": 'package main\nimport "fmt"\nimport "ex.com/p/util"\nimport (\n "ex.com/p/lib/deep"\n "os"\n)', "util/u.go": "", "lib/deep/d.go": ""}, "cmd/main.go", ["util", "lib/deep"], []),
    ("java", {"A.java": "import com.x.B;\nimport static com.x.C.*;\nimport java.util.List;\nimport com.x.K;", "com/x/B.java": "", "com/x/C.java": "", "com/x/K.kt": ""}, "A.java", ["com/x/B.java", "com/x/C.java", "com/x/K.kt"], []),
    ("cs", {"A.cs": "using Foo.Bar;\nusing System;", "Foo/Bar.cs": ""}, "A.cs", ["Foo/Bar.cs"], []),
    ("dart", {"lib/a.dart": "import 'b.dart';\nimport 'dart:io';\nimport 'package:x/y.dart';\nimport 'gone.dart';", "lib/b.dart": ""}, "lib/a.dart", ["lib/b.dart"], ["gone.dart"]),
    ("hs", {"Main.hs": "import qualified Data.Foo as X\nimport Bar", "Data/Foo.hs": "", "Bar.lhs": ""}, "Main.hs", ["Data/Foo.hs", "Bar.lhs"], []),
    ("ex", {"a.ex": "alias MyApp.UserRepo\n  alias Not.This\nuse Phoenix", "lib/my_app/user_repo.ex": "", "not/this.ex": ""}, "a.ex", ["lib/my_app/user_repo.ex"], []),
    ("lua", {"m.lua": 'local u = require("utils.helper")\nrequire \'x\'\nrequire("gone")', "utils/helper.lua": ""}, "m.lua", ["utils/helper.lua"], ["gone"]),
    ("sh", {"bin/a.sh": "source ./b.sh\n. \"../c.sh\" # x\nsource gone.sh", "bin/b.sh": "", "c.sh": ""}, "bin/a.sh", ["bin/b.sh", "c.sh"], ["gone.sh"]),
    ("r", {"a.R": "source('b.r')\nsource(\"gone.R\")", "b.r": ""}, "a.R", ["b.r"], ["gone.R"]),
    ("rb", {"x/a.rb": "require 'util'\nrequire_relative 'b'\nrequire_relative 'gone'\nrequire 'json'", "x/b.rb": "", "lib/util.rb": ""}, "x/a.rb", ["x/b.rb", "lib/util.rb"], ["gone"]),
    ("rs", {"src/main.rs": "mod a;\npub(crate) mod b;\nmod inline { }\nmod gone;", "src/a.rs": "", "src/b/mod.rs": ""}, "src/main.rs", ["src/a.rs", "src/b/mod.rs"], []),
    ("php", {"w/a.php": "require_once('b.php');\ninclude 'c';\nuse App\\Models\\User;\ninclude 'gone.php';", "w/b.php": "", "c.php": "", "App/Models/User.php": ""}, "w/a.php", ["w/b.php", "c.php", "App/Models/User.php"], ["gone.php"]),
    ("c", {"src/a.c": '#include "b.h"\n# include "inc/x.inc"\n#include <stdio.h>\n#include "gone.h"', "src/b.h": "", "inc/x.inc": ""}, "src/a.c", ["src/b.h", "inc/x.inc"], ["gone.h"]),
    ("cpp", {"a.cpp": '#include "b.hpp"', "b.hpp": ""}, "a.cpp", ["b.hpp"], []),
    ("py", {"pkg/m.py": "import os, pkg.helper\nfrom pkg import thing\nfrom . import sibling\nfrom .helper import x\nfrom ..top import y\nimport near\ndef f():\n    import pkg.late", "pkg/__init__.py": "", "pkg/helper.py": "", "pkg/near.py": "", "pkg/late.py": "", "top.py": ""}, "pkg/m.py", ["pkg/helper.py", "pkg/__init__.py", "top.py", "pkg/near.py", "pkg/late.py"], ["."]),
]


def edges_of(spark, root):
    everything = source_files(spark, root)
    files = languages.supported(everything)
    wanted, listing = imports.wanted(files), imports.listing(everything)
    return imports.resolve(wanted, listing), imports.unresolved(wanted, listing, files)


def test_imports_of_every_language(spark, tmp_path):
    edges, warned = edges_of(spark, make(tmp_path, {k: v for _, tree, *_ in CASES for k, v in tree.items()}))
    found, said = edges.orderBy("src", "pos").collect(), warned.orderBy("rel_path", "pos").collect()
    for name, _, source, expected, missing in CASES:
        assert [r.dst for r in found if r.src == source] == expected, name
        assert [re.search("'(.*)'", r.message)[1] for r in said if r.rel_path == source] == missing, name


def test_broken_files_warn(spark, tmp_path):
    edges, warned = edges_of(spark, make(tmp_path, {"a.py": "def broken(:\n", "b.js": b"\xff import './a'"}))
    assert edges.count() == 0
    assert sorted(r.message.split(" in ")[0].split(":")[0] for r in warned.collect()) == ["SyntaxError", "UnicodeDecodeError"]


def test_python_definitions():
    source = "def f():\n    return 1\n\n\nclass C:\n    def m(self):\n        pass\n"
    assert [(a, b) for a, b, _ in python_source.definitions(source)] == [(1, 2), (5, 7), (6, 7)]
    assert python_source.definitions(source)[0][2] == "def f():\n    return 1"
    assert python_source.definitions("def (") == [] and python_source.definitions("x = 1") == []
    assert python_source.definitions("@d\ndef g():\n    pass\x0c\n")[0][:2] == (2, 3)


def test_brace_chunks():
    js = chunks.header("braces_js")
    source = "import x\nexport default async function a() {\n  if (x) {\n  }\n}\nconst b = (y) => {\n}\nlet z = 1\nclass C {\n  m() {}\n"
    assert [(a, b) for a, b, _ in chunks.braced(source, js)] == [(2, 5), (6, 7), (9, 11)]
    assert chunks.braced("let z = 1\nz++", js) == [(1, 2, "let z = 1\nz++")]
    go = chunks.header("braces_go")
    assert [(a, b) for a, b, _ in chunks.braced("func (s *T) Run(x int) {\n}\nfunc G[T any](a T) {\n}", go)] == [(1, 2), (3, 4)]


def test_chunks_by_kind(spark, tmp_path):
    root = make(tmp_path, {"a.py": "def f():\n    pass\n", "s.py": "x = 1\n", "b.go": "package b\nfunc F() {\n}\n", "c.rb": "def x\nend\n", "d.rb": "x = 1\nx\n", "bad.js": b"\xff"})
    rows = chunks.chunks(languages.supported(source_files(spark, root))).orderBy("rel_path", "chunk_no").collect()
    assert [(r.rel_path, r.start_line, r.end_line) for r in rows] == [("a.py", 1, 2), ("b.go", 2, 3), ("c.rb", 1, 2), ("d.rb", 1, 3)]


def graph_of(spark, root, by_file=None, by_dir=None):
    files = languages.supported(source_files(spark, root))
    known = summaries.table(spark, by_file or {}, by_dir or {})
    return graph.nodes(files, known.filter("kind = 'file'").select("path", "summary"), known.filter("kind = 'directory'").select("path", "summary"))


def test_nodes_in_walk_order_with_ancestor_summaries(spark, tmp_path):
    root = make(tmp_path, {"a/b/c.py": "", "a/x.py": "", "z.py": "", "v1.2/m.py": ""})
    rows = graph_of(spark, root, {"z.py": "last"}, {"a": "top", "a/b": "deep"}).orderBy("ord").collect()
    assert [r.path for r in rows] == ["a/b/c.py", "a/b", "a", "a/x.py", "v1.2/m.py", "v1.2", "z.py"]
    assert {r.path: r.summary for r in rows if r.summary} == {"z.py": "last", "a": "top", "a/b": "deep"}
    nodes = graph_of(spark, root)
    assert [(r.src, r.dst) for r in graph.child_edges(nodes).orderBy("src", "pos").collect()] == [("a", "a/x.py"), ("a", "a/b"), ("a/b", "a/b/c.py"), ("v1.2", "v1.2/m.py")]
    assert [r.path for r in graph.top_level(nodes).orderBy("pos").collect()] == ["a", "v1.2", "z.py"]


def test_notes_and_their_links(spark):
    files = spark.createDataFrame([("a/x.py", "does x"), ("b.py", "")], "path string, summary string")
    links = spark.createDataFrame([("a/x.py", "b.py", 2), ("a/x.py", "c/__init__.py", 1)], "src string, dst string, pos long")
    rows = {r.path: r for r in notes.file_notes(files, links, {"team": ["x", "y"], "draft": True, "type": "no"}).collect()}
    assert rows["a/x.py"].content == "---\ntype: file\npath: a/x.py\nlinks:\n  - c/__init__\n  - b\nteam:\n  - x\n  - y\ndraft: true\n---\n\n## x.py\n\ndoes x\n\n## Connections\n- [[c/__init__]]\n- [[b]]\n"
    assert rows["b.py"].content == "---\ntype: file\npath: b.py\nlinks:\n  []\nteam:\n  - x\n  - y\ndraft: true\n---\n\n## b.py\n\n<!-- summary placeholder -->\n\n## Connections\n_No internal imports found._\n"
    assert rows["a/x.py"].note_path == "a/x.md"
    found = notes.links_of(spark.createDataFrame([("a/x", rows["a/x.py"].content), ("b", rows["b.py"].content), ("INDEX", "---\ntype: index\n---\n- [[a]]\n- [[z]]"), ("d", "---\ntype: directory\nchildren:\n  - d/q.py\n  - d/sub\n---\n"), ("odd", "none")], "node_path string, content string"))
    assert [(r.src, r.dst) for r in found.orderBy("src", "pos").collect()] == [("INDEX", "a"), ("INDEX", "z"), ("a/x", "c/__init__"), ("a/x", "b"), ("d", "d/q"), ("d", "d/sub")]


def test_notes_over_empty_and_null_texts_equal_their_sql(spark, tmp_path):
    import duckdb
    from tessera.plans import catalogue

    texts = ["", None, " ", "\n", "whole\ntext", "---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = {r.path: r.note_md5 for r in catalogue.QUERIES["note_extra_fields"](spark, str(tmp_path)).collect()}
    assert found == dict(con.sql(catalogue.ORACLES["note_extra_fields"]).fetchall())
    assert len(found) == len(texts) and [p for p, md5 in found.items() if md5 is None] == ["p1.py"]
    no_links = spark.createDataFrame([], "src string, dst string, pos long")
    written = notes.file_notes(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("summary")), no_links)
    assert {r.path for r in written.collect() if notes.NO_SUMMARY in r.content} == {"0", "1"}  # a missing summary still has its sign


def test_traversal_order_with_cycle_dangling_link_and_shared_child(spark):
    links = [("INDEX", 0, "b"), ("INDEX", 1, "a"), ("b", 0, "c"), ("a", 0, "c"), ("a", 1, "gone"), ("c", 0, "INDEX"), ("c", 1, "d")]
    edges = spark.createDataFrame(links, "src string, pos long, dst string")
    nodes = spark.createDataFrame([(x,) for x in ("INDEX", "a", "b", "c", "d")], "node_path string")
    for depth, expected in [(0, [("INDEX", 0)]), (2, [("INDEX", 0), ("b", 1), ("a", 1), ("c", 2)]), (9, [("INDEX", 0), ("b", 1), ("a", 1), ("c", 2), ("d", 3)])]:
        assert [(r.node_path, r.depth) for r in traverse.bfs(edges, nodes, "INDEX", min(depth, 4)).orderBy("depth", "ord").collect()] == expected
    assert traverse.bfs(edges, nodes, "none", 2).count() == 0


def test_text_functions(spark):
    note = F.col("n")
    for reply, expected in [("CONFLICT: yes\nREASON: a\nb ", (True, "a\nb")), ("conflict:NO", (False, "")), ("?", (True, ""))]:
        assert one(spark, F.struct(T.conflict(note), T.reason(note)), n=reply) == expected
    log = lambda n: one(spark, T.append_sync_log(note, F.lit("2024-05-06"), F.lit("0123456789ab"), F.lit("ok")), n=n)
    entry = "- 2024-05-06 — commit 01234567: ok"
    assert log("body") == f"body\n\n## 🔄 Sync Log\n{entry}\n" and log("body\n") == f"body\n\n## 🔄 Sync Log\n{entry}\n"
    assert log("x\n## 🔄 Sync Log\n- old\n") == f"x\n## 🔄 Sync Log\n{entry}\n- old\n" and log("x\n## 🔄 Sync Log") == f"x\n## 🔄 Sync Log\n{entry}"
    assert log("see ## 🔄 Sync Log here").endswith(f"here\n\n## 🔄 Sync Log\n{entry}\n")
    fm = "---\nkind: a\nkind: b: c\nlist:\n  - x\n  - y\nempty:\n  []\n---\nbody"
    assert one(spark, F.struct(T.scalar_field(note, "kind"), T.list_field(note, "list"), T.list_field(note, "empty"), T.scalar_field(note, "none")), n=fm) == ("b: c", ["x", "y"], [], None)
    assert one(spark, T.scalar_field(note, "kind"), n="---\nkind: a\n") is None
    assert one(spark, T.questions(note), n=" What is it about?\nshort?\nNo question here") == ["What is it about?"]
    assert [one(spark, T.marker(note), n=x) for x in ("HACK then TODO", "FIXME", "todo", "")] == ["TODO", "FIXME", None, None]
    assert one(spark, T.snippet(note), n="1\n2\n3\n4\n5\n6\n7\n8") == "4 5 6 7"


def test_stored_summaries_in_every_shape(tmp_path):
    path = str(tmp_path / "s.json")
    summaries.write(path, "abc", {"a.py": "é"}, {"d": "x"})
    assert "é" in (tmp_path / "s.json").read_text() and summaries.read(path) == ("abc", {"a.py": "é"}, {"d": "x"})
    (tmp_path / "s.json").write_text('{"a.py": "x", "repo_head_sha": "q"}')
    assert summaries.read(path) == ("q", {"a.py": "x"}, {})
    (tmp_path / "s.json").write_text('[{"a.py": "x"}, {"d": "y"}]')
    assert summaries.read(path) == (None, {"a.py": "x"}, {"d": "y"})


def test_suffixes_are_tried_in_order(spark):
    files = spark.createDataFrame([("web/a.js", "import x from './x'\n")], "rel_path string, text string")
    listing = imports.listing(spark.createDataFrame([("web/a.js",), ("web/x.jsx",), ("web/x.ts",)], "rel_path string"))
    assert [r.dst for r in imports.resolve(imports.wanted(languages.supported(files)), listing).collect()] == ["web/x.ts"]


def test_every_importer_has_chunks_and_newer_suffixes_are_known():
    known = {row[0]: row for row in languages.LANGUAGES}
    assert all(row[3] for row in known.values() if row[2] != "none")
    assert {".cs", ".dart", ".hs", ".ex", ".lua", ".sh", ".r", ".rb", ".rs", ".php", ".c", ".cpp"} <= set(known)


def test_braces_that_never_close_and_nested_headers():
    js = chunks.header("braces_js")
    source = "function a() {\n  function b() {}\n}\n} stray\nclass C {\n  x() {}\nlet y = 1"
    assert [(a, b) for a, b, _ in chunks.braced(source, js)] == [(1, 3), (5, 8)]
    assert [(a, b) for a, b, _ in chunks.braced("const f = async (x) => x\nlet g = 2", js)] == [(1, 3)]


def test_sparse_search_takes_long_texts_in_linear_time(spark):
    import time

    from tessera.operators import search

    long = " ".join(f"w{k % 7919}" for k in range(20_000))
    texts = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "w1 w2")], "item_id long, text string")
    began = time.time()
    found = [(r.doc_id, r.rank, r.distance) for r in search.sparse_top_k(asked, texts).orderBy("rank").collect()]
    assert time.time() - began < 20
    n = [20_000 // 7919 + (k < 20_000 % 7919) for k in range(7919)]
    assert found == [(2, 1, 0.0), (1, 2, round(1 - (n[1] + n[2]) / (2**0.5 * sum(x * x for x in n) ** 0.5), 6))]


def test_sparse_search_scores_in_as_many_tasks_as_the_pairs_need(spark, monkeypatch):
    from tessera.operators import search

    texts = spark.createDataFrame([(k, f"w{k % 5} w{k % 3} x{k}") for k in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"w{k} w0") for k in range(4)], "item_id long, text string")
    listed = lambda: sorted(map(tuple, search.sparse_top_k(asked, texts).collect()))
    found = listed()
    assert len(found) == 20
    monkeypatch.setattr(search, "TASK_PAIRS", 10)
    assert search.scoring_tasks(texts, "text", 4) == 24  # 60 texts, 4 queries
    plan = search.sparse_top_k(asked, texts)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id[^)]*, 24\), REPARTITION_BY_NUM", plan)  # which Spark doesn't merge again
    assert listed() == found
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert listed() == found


def test_numbering_in_partitions(spark):
    from tessera.operators import ordering

    rows = spark.range(0, 1_000_000, 1, 16).select(((F.col("id") * 7919) % 1_000_003).alias("x"), F.lit("z").alias("part"))
    found = ordering.numbered(rows, "x", name="ord")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    sums = found.agg(F.count_distinct("ord").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high")).first()
    assert (sums.n, sums.low, sums.high) == (1_000_000, 1, 1_000_000)
    falls = found.withColumn("before", F.lag("x").over(Window.partitionBy(F.floor(F.col("ord") / 1000)).orderBy("ord"))).filter("before >= x").count()
    assert falls == 0 and ordering.numbered(rows.limit(0), "x").count() == 0
    assert [r.pos for r in ordering.numbered(spark.createDataFrame([(1,)] * 3, "x long"), "x", start=5).orderBy("pos").collect()] == [5, 6, 7]


def test_cells_against_all_vectors(spark, tmp_path):
    import numpy as np
    from tessera.operators import cells, search

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in middle[k % 30] + 0.4 * rng.normal(size=16)]) for k in range(3000)]
    rows += [(3001, rows[5][1]), (3002, [0.0] * 16), (3003, None), (3004, [1.0]), (3005, [None] * 16), (None, rows[7][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.filter("vec_id % 50 = 0 OR vec_id > 3000").withColumnRenamed("vec_id", "query_id")
    own = cells.CellIndex(spark, str(tmp_path / "cells"))
    assert own.build(vectors, cells=40) == 40 and own.vectors().count() == 3002
    exact = search.top_k(asked.filter("size(embedding) = 16"), vectors.filter("size(embedding) = 16"), 5)
    listed = lambda df: sorted((r.query_id, r.rank, r.vec_id if r.query_id != 3002 else None, round(r.distance, 6)) for r in df.collect())
    assert listed(own.search(asked, 5, exact=True)) == listed(exact)
    near = {(r.query_id, r.vec_id) for r in own.search(asked, 5).collect()}
    every = {(r.query_id, r.vec_id) for r in exact.collect()}
    assert own.cells().first().probes < 20 and len(near & every) >= 0.9 * len(every)
    one = vectors.filter("vec_id = 50").withColumnRenamed("vec_id", "query_id")
    plan = own.vectors().filter(F.col("cell").isin([3, 4]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and {r.vec_id for r in own.search(one, 1, probes=1).collect()} == {50}
    assert own.build(vectors.limit(0)) == 0 and own.search(asked).count() == 0 and own.search(asked, exact=True).count() == 0


def test_index_versions_are_merged_and_only_full_buckets_rewritten(spark, tmp_path):
    from tessera.operators import index

    own = index.VectorIndex(spark, str(tmp_path / "i"), index.HashingEmbedder(8), buckets=8, most_versions=100)
    paths = [f"f{k}.py" for k in range(60)]
    made = lambda names, said: index.embedded(spark.createDataFrame([(n, 1, 2, f"{said} {n}?") for n in names], "rel_path string, start_line int, end_line int, question string"), own.embedder)
    gone = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    held = lambda: sorted((r.file_path, r.question) for r in own.rows().collect())
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "i" / "rows").rglob("*.parquet")}
    assert own.rows().count() == 0 and own.replace(made(paths, "a")) == 60
    expected = {n: {f"a {n}?"} for n in paths}
    for step in range(4):
        some, other = paths[step::7], paths[step::9]
        before = files()
        own.upsert(made(some, f"b{step}"))
        own.delete_files(gone(other), made(other[:2], f"c{step}"))
        assert before.items() <= files().items()  # nothing written before is touched
        for n in some:
            expected[n].add(f"b{step} {n}?")
        for k, n in enumerate(other):
            expected[n] = {f"c{step} {n}?"} if k < 2 else set()
    every = sorted((n, q) for n, qs in expected.items() for q in qs)
    assert held() == every
    own.delete_files(gone(["f1.py"]))
    own.upsert(made(["f1.py"], "d"))
    expected["f1.py"] = {"d f1.py?"}
    every = sorted((n, q) for n, qs in expected.items() for q in qs)
    versions = own._read("rows", index.SCHEMA, own._state()).select("bucket", "seq").union(own._read("removed", "file_path string", own._state()).select("bucket", "seq"))
    most = max(r.n for r in versions.groupBy("bucket").agg(F.count_distinct("seq").alias("n")).collect()) - 1
    before = files()
    full = own.compact(most)
    assert held() == every and full and set(full) < set(range(8))
    kept = {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in full}
    assert kept and all(files().get(p) == before[p] for p in kept)
    new = set(files()) - set(before)
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in new} == set(full)
    # what a run that was cut off has left is replaced by the next write
    version = own.meta()["version"] + 1
    own._bucketed(made(["lost.py"], "x").select(*index.COLUMNS), [0] * 8).write.partitionBy("bucket").parquet(str(tmp_path / f"i/rows/seq={version}"))
    assert held() == every
    own.delete_files(gone(["none.py"]))
    assert held() == every and own.compact(0) == list(range(8)) and held() == every
    assert {p.name for p in (tmp_path / "i/rows").iterdir()} >= {f"seq={own.meta()['version']}"} and len(list((tmp_path / "i/rows").iterdir())) <= 2


def test_graph_kept_by_change_sets_equals_a_full_build(spark):
    import random

    from tessera.operators import changes, graph_upkeep

    rng = random.Random(4)
    folders = ["a", "a/b", "a/b/c", "d", "", "e/f"]
    names = [f"{f}/{n}".lstrip("/") for f in folders for n in ("x.js", "y.ts", "z.py", "index.js", "m.go")]

    def text(path):
        up = "../" * path.count("/")
        if path.endswith(".py"):
            return "".join(f"from {rng.choice(['a', 'a.b', 'e.f', 'd'])}.{rng.choice('xyz')} import q\n" for _ in range(2))
        return "".join(f"import k from './{up}{rng.choice(folders)}{rng.choice(['', '/x', '/y', '/none'])}'\n" for _ in range(3))

    def tables(repo):
        df = spark.createDataFrame(sorted(repo.items()), "rel_path string, text string")
        return languages.supported(df), df.select("rel_path"), df.select(F.col("rel_path").alias("path"), F.md5("text").alias("digest"))

    def listed(g):
        rows = lambda df: sorted(map(tuple, df.collect()))
        return [rows(g.paths), rows(g.folders), rows(g.edges.select("src", "dst", "pos")), rows(g.children), rows(g.wanted.select("src", "pos", "raw"))]

    repo = {n: text(n) for n in rng.sample(names, 16)}
    files, every, before = tables(repo)
    kept = graph_upkeep.build(files, every).settled()
    all_nodes = graph.nodes(files.withColumn("parts", F.split("rel_path", "/")), *[spark.createDataFrame([], "path string, summary string")] * 2)
    assert sorted(map(tuple, graph.child_edges(all_nodes).select("src", "dst", "dst_type", "pos").collect())) == listed(kept)[3]
    for _ in range(2):
        for n in rng.sample(sorted(repo), 4):
            del repo[n]
        repo |= {n: text(n) for n in rng.sample(names, 6)}
        files, every, now = tables(repo)
        kept = graph_upkeep.advance(kept, changes.change_set(before, now), files).settled()
        before = now
        assert listed(kept) == listed(graph_upkeep.build(files, every))
    assert listed(graph_upkeep.advance(kept, changes.change_set(now, now), files)) == listed(kept)


def test_imports_read_the_files_once_and_search_each_text_once(spark, tmp_path):
    from tessera.operators import graph_upkeep

    rows = [("a/x.js", "import k from './y'\n/* import export require */ export {m} from \"./z\"\nconst q = require( './w' )"), ("a/p.py", "from .q import r\nimport b.c"), ("a/y.js", None), ("n.md", "import 'x'")]
    spark.createDataFrame(rows, "rel_path string, text string").coalesce(1).write.parquet(str(tmp_path / "files"))
    files = languages.supported(spark.read.parquet(str(tmp_path / "files")))
    wanted = imports.wanted(files)
    found = sorted((r.src, r.pos, r.raw) for r in wanted.collect())
    assert found == [("a/p.py", 0, ".q"), ("a/p.py", 1, "b.c"), ("a/x.js", 0, "./y"), ("a/x.js", 1, "./z"), ("a/x.js", 2, "./w")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(wanted).count("parquet") == 1 and len(re.findall(r"regexp_extract_all\(text#\d+, [^,]*import\|export", plan(wanted))) == 1
    kept = graph_upkeep.build(files, files.select("rel_path"))
    assert "regexp_extract_all" not in plan(kept.edges)
    assert sorted((r.src, r.dst) for r in kept.edges.collect()) == [("a/x.js", "a/y.js")]


def test_only_broken_bytes_are_decoded_in_python(spark):
    rows = [(1, "a\u00e9\ufffd".encode()), (2, b"a\xff\xe2\x82b\xed\xa0\x80c\xf0\x9f\x98"), (3, None), (4, b"")]
    files = spark.createDataFrame(rows, "id int, content binary")
    assert sorted(map(tuple, files.select("id", lenient_text("content")).collect())) == [(i, None if b is None else b.decode("utf-8", "ignore")) for i, b in rows]
    broken = files.select(lenient_text("content"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_without_broken\(CASE WHEN", broken)


def test_texts_go_to_python_in_small_batches(spark):
    from pyspark.sql.types import IntegerType
    from tessera.operators.lineage import bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        chunks.chunks(spark.createDataFrame([], "rel_path string, chunker string, text string"))
        assert spark.conf.get(name) == "4m"
        size = F.pandas_udf(lambda part: part.map(lambda _: len(part)), IntegerType())
        long = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        assert long.agg(F.max(size("text"))).first()[0] <= 5
        spark.conf.set(name, "1m")
        bound_batches(spark)
        assert spark.conf.get(name) == "1m"  # its own bound stays
    finally:
        spark.conf.set(name, before)


def test_front_matter_of_any_fields(spark):
    notes_ = {
        "---\ntype: file\nlinks:\n  - a\n  - b: c\nx y: \n  - 1\n---\nbody: no": {"type": ["file"], "links": ["a", "b: c"], "x y": ["1"]},
        "---\na: 1\n  - lost\na:\n  - 2\nnothing\n  - 3\n---": {"a": ["2", "3"]},
        "---\r\na: 1\r\nb::\u2028  - 2\n---": {"a": ["1"], "b": ["2"]},
        "---\n  - x\nurl: http://a: b:\n:\n---": {"url": ["http://a: b:"], "": []},
        "no front": {}, "---\nopen: 1\n": {}, "---\n---": {}, "": {},
    }
    long = "---\n" + "".join(f"k{i % 700}: {i}\n" for i in range(20_000)) + "items:\n" + "".join(f"  - {i}\n" for i in range(20_000)) + "---\n"
    rows = [*notes_, None, long]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, note string").select("id", T.front_matter_map(F.col("note")).alias("m"))
    found = {r.id: r.m for r in df.collect()}
    assert [found[k] for k in range(len(notes_))] == list(notes_.values()) and found[len(notes_)] == {}
    last = found[len(rows) - 1]
    assert len(last) == 701 and last["k5"] == ["19605"] and last["items"][-1] == "19999"
    reply = spark.createDataFrame([("What is this one?\rAnd what is that?\u2028no\nshort?",)], "r string").select(T.questions(F.col("r")).alias("q")).first().q
    assert reply == ["What is this one?", "And what is that?"]


def test_files_that_are_not_needed_are_not_opened(spark, tmp_path):
    """A file of 3 GB (without blocks) can be listed but not read into a row."""
    from tessera.operators.languages import suffixes
    from tessera.sources.tree import source_paths, suffix

    root = make(tmp_path, {"a.py": "x = 1\n", "b/c.js": "y", "b/d.bin": "", ".env": "", "node_modules/e.py": "", "b/f.": ""})
    with open(tmp_path / "b/d.bin", "r+b") as f:
        f.truncate(3 << 30)
    assert {(r.rel_path, r.n_bytes) for r in source_paths(spark, root).collect()} == {("a.py", 6), ("b/c.js", 1), ("b/d.bin", 3 << 30), (".env", 0), ("b/f.", 0)}
    assert {r.rel_path for r in source_files(spark, root, suffixes=suffixes()).collect()} == {"a.py", "b/c.js"}
    only = source_files(spark, root, only=["b/c.js", "none.py", "../x", "node_modules/e.py", "/a.py", "b", "a.py", "a.py"]).collect()
    assert {(r.rel_path, r.text) for r in only} == {("a.py", "x = 1\n"), ("b/c.js", "y")} and len(only) == 2
    assert source_files(spark, root, only=[]).count() == 0
    names = ["a.py", "x/.py", "x/.a.py", "a.", "a", "a.b/c", "a.tar.gz"]
    found = spark.createDataFrame([(n,) for n in names], "p string").select("p", P.suffix(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in found} == {n: suffix(n) for n in names}
