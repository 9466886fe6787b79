"""The repository engine: ingest, search, explore, markers, cost and upkeep.

Every step is a DataFrame; what is generated is written down before it is used again. Tables
live below the index folder (summaries, notes, index versions); notes are also exported as
markdown files below the note folder.
"""

from __future__ import annotations

import datetime
import os
import shutil
import tempfile
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import changes, chunks, cost, generate, graph, imports, lookups, markers, notes, sync, traverse
from ..operators.index import Embedder, HashingEmbedder, VectorIndex, embedded
from ..operators.languages import suffixes, supported
from ..operators.lineage import bound_batches
from ..operators.search import MAX_DISTANCE
from ..operators.urls import REMOTE
from ..scope import Scope, guard, resolve
from ..sources import git, summaries
from ..sources.tree import IGNORED, lenient_text, source_files, source_paths
from . import render

NOTES = "node_path string, note_path string, content string"


class Engine:
    """One repository's tables and the questions that they answer."""

    def __init__(self, spark: SparkSession, scope: Scope | None = None, generator: generate.TextGenerator | None = None, embedder: Embedder | None = None, today: str | None = None):
        bound_batches(spark)
        self.spark, self.scope = spark, scope or Scope()
        self.generator = generator or generate.Extractive()
        self.embedder = embedder or HashingEmbedder()
        self.today = today or datetime.date.today().isoformat()

    # --- tables -----------------------------------------------------------------------------

    def files(self, root: str | None = None) -> DataFrame:
        """Supported files of the repository with language, importer and chunker."""
        return supported(source_files(self.spark, root or self.scope.get("repo_root"), suffixes=suffixes()))

    def everything(self, root: str | None = None) -> DataFrame:
        """All paths of the repository; no file is opened."""
        return source_paths(self.spark, root or self.scope.get("repo_root")).select("rel_path")

    def imports(self, root: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Import edges (src, dst, pos) and warnings (rel_path, pos, message)."""
        files, listing = self.files(root), imports.listing(self.everything(root))
        wanted = imports.wanted(files)
        return imports.resolve(wanted, listing), imports.unresolved(wanted, listing, files)

    def chunks(self, root: str | None = None) -> DataFrame:
        return chunks.non_blank(chunks.chunks(self.files(root)))

    def graph(self, file_summaries: DataFrame, dir_summaries: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, child edges and the top level."""
        all_nodes = graph.nodes(self.files(root), file_summaries, dir_summaries)
        return all_nodes, graph.child_edges(all_nodes), graph.top_level(all_nodes)

    def notes(self, file_summaries: DataFrame, dir_summaries: DataFrame, extra: Mapping[str, object] | None = None, root: str | None = None) -> DataFrame:
        """(node_path, note_path, content) of all nodes; of notes with one path the last in node order stays."""
        all_nodes, children, top = self.graph(file_summaries, dir_summaries, root)
        edges, _ = self.imports(root)
        of = lambda kind: all_nodes.filter(F.col("node_type") == kind).select("path", "summary")
        written = notes.file_notes(of("file"), edges, extra).unionByName(notes.directory_notes(of("directory"), children, extra)).join(all_nodes.select("path", "ord"), "path")
        last = lookups.last_writer(written, "note_path", "content", "ord").unionByName(notes.index_note(top, extra).select("note_path", "content"))
        return last.select(F.regexp_replace("note_path", r"\.md$", "").alias("node_path"), "note_path", "content")

    def index(self) -> VectorIndex:
        return VectorIndex(self.spark, self.scope.get("index_path"), self.embedder)

    def answers(self) -> generate.AnswerStore:
        """Where the generator's answers are kept, so that no prompt is asked twice."""
        return generate.AnswerStore(self.spark, f"{self.scope.get('index_path')}/answers")

    def stored_notes(self) -> DataFrame:
        """The notes of the last ingest or upkeep."""
        path = self.scope.get("index_path")
        return self.spark.read.schema(NOTES).parquet(f"{path}/notes-{self._state('notes')}")

    # --- small state beside the tables --------------------------------------------------------

    def _state(self, kind: str) -> int:
        path = f"{self.scope.get('index_path')}/{kind}.version"
        return int(open(path).read()) if os.path.exists(path) else -1

    def _store_notes(self, rows: DataFrame) -> None:
        """A new version of the notes, then the pointer; files below the note folder follow as far as they differ."""
        path, number = self.scope.get("index_path"), self._state("notes") + 1
        before = self.stored_notes() if number else self.spark.createDataFrame([], NOTES)
        rows.select("node_path", "note_path", "content").write.mode("overwrite").parquet(f"{path}/notes-{number}")
        with open(f"{path}/notes.version.new", "w") as f:
            f.write(str(number))
        os.replace(f"{path}/notes.version.new", f"{path}/notes.version")
        shutil.rmtree(f"{path}/notes-{number - 2}", ignore_errors=True)
        export_notes(self.stored_notes(), before, self.scope.get("vault_root"))

    def _summaries_path(self) -> str:
        return f"{self.scope.get('vault_root').rstrip('/')}.summaries.json"

    # --- pipelines -----------------------------------------------------------------------------

    def estimate(self, root: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The calls that an ingest would take, and the files by suffix."""
        files = self.files(root)
        counts = lookups.suffix_counts(files.withColumn("ord", F.col("parts")), "rel_path")
        return cost.estimate(files, chunks.chunks(files.filter("suffix = '.py'"))), counts

    def estimate_cost(self, root: str | None = None) -> str:
        row, counts = self.estimate(root)
        return render.cost(row.first(), counts.collect())

    def dry_run(self, root: str | None = None) -> dict[str, int]:
        """Files that aren't blank, their directories, and the calls at least needed for both."""
        files = self.files(root).withColumn("text", lenient_text("content")).filter(~T.is_blank(F.col("text")))
        row = files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.when(F.col("parent") != ".", F.col("parent"))).alias("dirs")).first()
        return {"files": row.files, "directories": row.dirs, "calls": row.files + row.dirs}

    def ingest(self, source: str | None = None, *, extra: Mapping[str, object] | None = None, reuse: bool = False, generate_text: bool = True, explanations: str | None = None) -> dict[str, int]:
        """Summaries, graph, notes and index of a folder or a remote address.

        ``reuse`` takes stored summaries, ``explanations`` those of a JSON file; ``generate_text`` off makes notes without any.
        """
        source = source or self.scope.get("repo_root")
        temporary = None
        if source.startswith(REMOTE):
            temporary = tempfile.mkdtemp(prefix="clone-")
            source = git.clone(source, f"{temporary}/repo")
        try:
            guard(source)
            if generate_text and not self.generator.available():
                raise RuntimeError("the text generator is not available")
            if explanations:
                _, by_file, by_dir = summaries.read(explanations)
            elif reuse and os.path.exists(self._summaries_path()):
                _, by_file, by_dir = summaries.read(self._summaries_path())
            elif generate_text:
                made = generate.file_summaries(self.files(source), self.generator, self.answers()).persist(StorageLevel.MEMORY_AND_DISK)
                by_file = {r.path: r.summary for r in made.collect()}
                by_dir = {r.path: r.summary for r in generate.directory_summaries(made, self.generator, self.answers()).collect()}
                made.unpersist()
            else:
                by_file, by_dir = {}, {}
            return self._build(source, by_file, by_dir, extra, index=generate_text, clear=False)
        finally:
            if temporary:
                shutil.rmtree(temporary, ignore_errors=True)

    def rebuild(self, *, extra: Mapping[str, object] | None = None) -> dict[str, int]:
        """Notes and index again, from the stored summaries."""
        _, by_file, by_dir = summaries.read(self._summaries_path())
        return self._build(self.scope.get("repo_root"), by_file, by_dir, extra, index=True, clear=True)

    def _build(self, root, by_file, by_dir, extra, *, index: bool, clear: bool) -> dict[str, int]:
        os.makedirs(self.scope.get("index_path"), exist_ok=True)
        os.makedirs(self.scope.get("vault_root"), exist_ok=True)
        known = summaries.table(self.spark, by_file, by_dir)
        of = lambda kind: known.filter(F.col("kind") == kind).select("path", "summary")
        self._store_notes(self.notes(of("file"), of("directory"), extra, root))
        warned = self.imports(root)[1].orderBy("rel_path", "pos").collect()
        if warned:
            with open(f"{self.scope.get('vault_root')}/warnings.log", "w", encoding="utf-8") as f:
                f.write("\n".join(r.message for r in warned))
        questions = 0
        if index:
            rows = embedded(generate.chunk_questions(self.chunks(root), self.generator, self.answers()), self.embedder)
            questions = (self.index().replace if clear else self.index().upsert)(rows)
        summaries.write(self._summaries_path(), git.head(root), by_file, by_dir)
        return {"notes": self.stored_notes().count(), "warnings": len(warned), "questions": questions}

    # --- questions -------------------------------------------------------------------------------

    def search(self, query: str, k: int = 5, most: float = MAX_DISTANCE) -> DataFrame:
        """The k nearest chunks with ``confidence`` and note paths relative to the note folder."""
        found = self.index().search(query, k).withColumn("markdown_path", P.relative_if_below(F.col("markdown_path"), self.scope.get("vault_root")))
        return found.withColumn("confidence", F.when(F.col("distance") <= most, "high").otherwise("low"))

    def search_code(self, query: str, k: int = 5, most: float = MAX_DISTANCE) -> str:
        return render.hits(self.search(query, k, most).collect())

    def explore(self, max_depth: int = 2, start: str = "INDEX") -> DataFrame:
        """(depth, node_path, overview, ord) breadth first."""
        stored = self.stored_notes()
        found = traverse.bfs(notes.links_of(stored), stored, start, max_depth)
        return found.join(stored, "node_path").select("depth", "node_path", T.overview_line(F.col("content")).alias("overview"), "ord").orderBy("depth", "ord")

    def explore_repo(self, max_depth: int = 2) -> str:
        return render.overview(self.explore(max_depth).collect())

    def read_note(self, node_path: str) -> str:
        name = node_path.removesuffix(".md")
        row = self.stored_notes().filter(F.col("node_path") == name).first()
        return row.content if row else f"There is no note {name}."

    def find_todos(self, query: str, n_files: int = 5, n_commits: int = 5) -> str:
        """Markers and recent commits of the files nearest to a question, one section for each in the order of the hits.

        Lines are scanned as bytes, so files that aren't UTF-8 count, too.
        """
        names = list(dict.fromkeys(r.file_path for r in self.search(query, n_files).collect()))  # at most n_files
        root = self.scope.get("repo_root").rstrip("/")
        own = [x.removeprefix(root + "/") for x in names]  # no other file is opened
        wanted = self.spark.createDataFrame([(x,) for x in names], "file_path string").withColumn("full", P.absolute(F.col("file_path"), root))
        texts = source_files(self.spark, root, only=own).withColumn("full", P.absolute(F.col("rel_path"), root)).join(F.broadcast(wanted), "full").select("file_path", lenient_text("content").alias("text"))
        found = markers.scan(texts).orderBy("file_path", "line_number").collect()
        return render.todos(names, found, git.commits(self.spark, root, names, n_commits).orderBy("file_path", "ord").collect())

    def snippets(self, rows: DataFrame) -> dict[str, str]:
        """The snippet of the note of each hit."""
        wanted = rows.select(F.col("markdown_path").alias("note_path")).distinct()
        return {r.note_path: r.snippet for r in self.stored_notes().join(F.broadcast(wanted), "note_path").select("note_path", T.snippet(F.col("content")).alias("snippet")).collect()}

    def vault_append(self, query: str) -> str:
        """Which note an annotation belongs to; writes nothing."""
        row = self.search(query, 1).first()
        if row is None:
            return "Nothing is indexed yet."
        root = self.scope.get("vault_root")
        return f"Note: {row.markdown_path}\nFile: {os.path.join(root, row.markdown_path)}\nOpen it, add the annotation under its own heading, and save it."

    def read_guidelines(self, path: str | None = None) -> str:
        try:
            with open(resolve("guidelines", path), encoding="utf-8") as f:
                return f.read()
        except (RuntimeError, OSError) as e:
            return f"No guidelines: {e}"

    def active_scope(self) -> str:
        return render.scope(self.scope.status())

    # --- upkeep ----------------------------------------------------------------------------------

    def sync_plan(self, since: str) -> tuple[sync.Plan, dict[str, str], dict[str, str]]:
        _, by_file, by_dir = summaries.read(self._summaries_path())
        known = summaries.table(self.spark, by_file, {}).select("path")
        return sync.plan(git.changed_paths(self.spark, self.scope.get("repo_root"), since), known, IGNORED), by_file, by_dir

    def sync(self, dry_run: bool = True, extra: Mapping[str, object] | None = None) -> str:
        """Brings notes, index and summaries up to the commit checked out; the commit is stored last.

        If a step fails, nothing that a reader sees has moved past it and the commit stays, so the
        next run does the work again.
        """
        root = self.scope.get("repo_root")
        since, _, _ = summaries.read(self._summaries_path())
        if not since:
            return "No commit is stored; ingest first."
        now = git.head(root) or ""
        planned, by_file, by_dir = self.sync_plan(since)
        new, modified, deleted = (sorted(r.path for r in rows.collect()) for rows in (planned.new, planned.modified, planned.deleted))
        if dry_run:
            return render.plan(new, modified, deleted)
        touched = self.spark.createDataFrame([(x,) for x in new + modified], "rel_path string")
        files = self.files(root).join(F.broadcast(touched), "rel_path").persist(StorageLevel.MEMORY_AND_DISK)
        made = {r.path: r.summary for r in generate.file_summaries(files, self.generator, self.answers()).collect()}
        by_file = {k: v for k, v in by_file.items() if k not in deleted} | made
        folders = sorted({os.path.dirname(p) for p in new + modified + deleted} - {""})
        own = summaries.table(self.spark, by_file, {}).select("path", "summary")
        inside = own.filter(P.parent(F.col("path")).isin(folders)) if folders else own.limit(0)
        by_dir = {k: v for k, v in by_dir.items() if k not in folders} | {r.path: r.summary for r in generate.directory_summaries(inside, self.generator, self.answers()).collect()}

        known = summaries.table(self.spark, by_file, by_dir)
        fresh = self.notes(known.filter("kind = 'file'").select("path", "summary"), known.filter("kind = 'directory'").select("path", "summary"), extra, root).persist(StorageLevel.MEMORY_AND_DISK)
        ids = lambda names: self.spark.createDataFrame([(os.path.splitext(x)[0],) for x in names], "node_path string")
        renamed = lambda rows: rows.select(F.col("node_path").alias("path"), "content")
        old = self.stored_notes()
        judged = sync.rewritten(renamed(old.join(ids(modified), "node_path", "left_semi")), renamed(fresh.join(ids(modified), "node_path", "left_semi")), self.generator, self.today, now, self.answers()).persist(StorageLevel.MEMORY_AND_DISK)
        n_conflicts = judged.filter("conflict").count()
        logged = judged.select("path", "content").unionByName(sync.added(renamed(fresh.join(ids(new), "node_path", "left_semi")), self.today, now))
        unchanged = old.join(fresh.select("node_path"), "node_path", "left_semi").filter(T.scalar_field(F.col("content"), "type") == "file").join(ids(new + modified), "node_path", "left_anti").select(F.col("node_path").alias("path"), "content")
        own_text = logged.unionByName(unchanged).withColumnsRenamed({"path": "node_path", "content": "own"})
        self._store_notes(fresh.join(own_text, "node_path", "left").select("node_path", "note_path", F.coalesce("own", "content").alias("content")))
        questions = embedded(generate.chunk_questions(chunks.non_blank(chunks.chunks(files)), self.generator, self.answers()), self.embedder)
        self.index().delete_files(self.spark.createDataFrame([(x,) for x in new + modified + deleted], "path string"), questions)
        summaries.write(self._summaries_path(), now, by_file, by_dir)
        for rows in (files, fresh, judged):
            rows.unpersist()
        return f"{len(modified)} modified ({n_conflicts} rewritten), {len(new)} new, {len(deleted)} deleted; now at {now[: T.SHORT_SHA]}."


def export_notes(rows: DataFrame, before: DataFrame, folder: str) -> None:
    """One markdown file for each note below a folder that executors can write.

    Written are notes that differ from the version before and files that are missing; files of notes that are gone
    are removed. Other files are left alone.
    """
    digests = lambda notes: notes.select("note_path", F.md5("content").alias("digest"))
    differs = changes.change_set(digests(before), digests(rows), "note_path")
    now = rows.join(differs, "note_path", "left").select("note_path", "content", F.col("status").isNotNull().alias("changed"))
    gone = differs.filter("status = 'D'").select("note_path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("changed"))

    def write(part) -> None:
        for r in part:
            path = os.path.join(folder, r.note_path)
            if r.content is None:
                if os.path.exists(path):
                    os.remove(path)
            elif r.changed or not os.path.exists(path):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(r.content)

    now.union(gone).foreachPartition(write)
