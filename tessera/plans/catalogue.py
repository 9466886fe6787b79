"""Named queries that apply the repository operators to the benchmark tables, with SQL oracles.

The benchmark has no source tree, so each operator runs on an analogous table: documents as
files, their source as directory, page addresses as paths, labels as stored summaries, events
as commit log, embeddings as vector index, region/nation/supplier as the note graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import changes, logs, lookups, markers, search, traverse, urls

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


# --- texts -----------------------------------------------------------------------------------


@query("""
    SELECT doc_id, i::INT AS line_number, length(line)::INT AS n_chars, md5(line) AS line_md5
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)""")
def line_scan(spark, sf_dir):
    found = markers.lines_of(table(spark, sf_dir, "documents"), key="doc_id")
    return found.select("doc_id", "line_number", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


@query("""
    SELECT doc_id, i::INT AS line_number, md5(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS text_md5,
        CASE WHEN contains(line, 'THE') THEN 'THE' WHEN contains(line, 'AND') THEN 'AND' ELSE 'QUE' END AS tag
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
    WHERE contains(line, 'THE') OR contains(line, 'AND') OR contains(line, 'QUE')""")
def marker_grep(spark, sf_dir):
    found = markers.scan(table(spark, sf_dir, "documents"), key="doc_id", markers=("THE", "AND", "QUE"))
    return found.select("doc_id", "line_number", F.md5("text").alias("text_md5"), "tag")


@query("""
    SELECT doc_id, 1::INT AS start_line, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS end_line, md5(text) AS text_md5 FROM documents
    WHERE regexp_matches(text, '\\S')""")
def whole_file_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(~T.is_blank(F.col("text")))
    return docs.select("doc_id", F.lit(1).alias("start_line"), T.line_count(F.col("text")).alias("end_line"), F.md5("text").alias("text_md5"))


@query("SELECT doc_id, length(substring(text, 1, 12000))::INT AS n_chars, md5(substring(text, 1, 12000)) AS head_md5 FROM documents")
def truncate_12k(spark, sf_dir):
    head = T.head(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(head).alias("n_chars"), F.md5(head).alias("head_md5"))


@query("""
    SELECT doc_id, md5(line) AS question_md5 FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents)
    WHERE line LIKE '%.' AND length(line) > 10""")
def question_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.questions(F.col("text"), ending=".")).alias("q")).select("doc_id", F.md5("q").alias("question_md5"))


def _noted(spark, sf_dir) -> DataFrame:
    head = F.concat(F.lit("---\ntype: file\npath: "), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\nlinks:\n"))
    links = F.when(F.col("doc_id") % 3 == 0, F.lit("  []")).otherwise(F.concat(F.lit("  - a/"), "source", F.lit("\n  - b/"), "lang"))
    note = F.concat(head, links, F.lit("\n---\n\n## d"), F.col("doc_id").cast("string"), F.lit("\n\n"), F.when(F.col("doc_id") % 5 == 0, F.lit("<!-- summary placeholder -->\n")).otherwise(""), "text", F.lit("\n\n## Connections\n- [[a/"), "source", F.lit("]]\n"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", note.alias("note"))


_NOTED_SQL = """
    n AS (SELECT doc_id, source, lang, '---' || chr(10) || 'type: file' || chr(10) || 'path: ' || source || '/' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'links:' || chr(10)
        || CASE WHEN doc_id % 3 = 0 THEN '  []' ELSE '  - a/' || source || chr(10) || '  - b/' || lang END || chr(10) || '---' || chr(10) || chr(10) || '## d' || doc_id || chr(10) || chr(10)
        || CASE WHEN doc_id % 5 = 0 THEN '<!-- summary placeholder -->' || chr(10) ELSE '' END || text || chr(10) || chr(10) || '## Connections' || chr(10) || '- [[a/' || source || ']]' || chr(10) AS note FROM documents)"""


@query(f"""WITH {_NOTED_SQL}
    SELECT doc_id, 'file' AS node_type, source || '/' || doc_id AS path, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a/' || source || '|b/' || lang END AS links, 'a/' || source AS wikilinks FROM n""")
def frontmatter_parse(spark, sf_dir):
    note = F.col("note")
    return _noted(spark, sf_dir).select("doc_id", T.scalar_field(note, "type").alias("node_type"), T.scalar_field(note, "path").alias("path"), T.scalar_field(note, "lang").alias("lang"), F.array_join(T.list_field(note, "links"), "|").alias("links"), F.array_join(T.wikilinks(note), "|").alias("wikilinks"))


@query("""
    WITH n AS (SELECT doc_id, source, lang, regexp_replace(regexp_extract(text, '[^\\s]+'), ':', '', 'g') AS word FROM documents)
    SELECT doc_id, 'type' AS name, 'note' AS found FROM n UNION ALL SELECT doc_id, 'x-' || lang, source || ': ' || doc_id || '|' FROM n UNION ALL SELECT doc_id, 'items', 'a: ' || source || '|' || doc_id FROM n
    UNION ALL SELECT doc_id, 'empty', '' FROM n UNION ALL SELECT doc_id, 'first-' || word, word FROM n WHERE word <> ''""")
def frontmatter_map(spark, sf_dir):
    """Fields with names not known beforehand, one of them named by the text's first word, repeated and empty ones."""
    word = F.replace(F.regexp_extract("text", r"\S+", 0), F.lit(":"), F.lit(""))
    named = F.when(word != "", F.concat(F.lit("first-"), word, F.lit(": "), word, F.lit("\n"))).otherwise("")
    number = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\ntype: file\nitems: early\n  - lost\nx-"), "lang", F.lit(": "), "source", F.lit(": "), number, F.lit("|\nitems:\n\n  - a: "), "source", F.lit("\nno field\n  - "), number, F.lit("\nempty: \n"), named, F.lit("type: note\n---\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.front_matter_map(F.concat(head, "text")).alias("fields"))
    return rows.select("doc_id", F.explode("fields").alias("name", "values")).select("doc_id", "name", F.array_join("values", "|").alias("found"))


@query(f"""WITH {_NOTED_SQL},
    l AS (SELECT doc_id, regexp_replace(unnest(string_split(substring(note, strpos(note, chr(10) || '---') + 4), chr(10))), '^\\s+|\\s+$', '', 'g') AS line, unnest(generate_series(1, len(string_split(substring(note, strpos(note, chr(10) || '---') + 4), chr(10))))) AS i FROM n),
    h AS (SELECT doc_id, min(i) FILTER (WHERE starts_with(line, '##')) AS h1, list(i ORDER BY i) FILTER (WHERE starts_with(line, '##')) AS hs FROM l GROUP BY doc_id),
    k AS (SELECT doc_id, line, i FROM l WHERE line <> '' AND NOT contains(line, 'placeholder') AND NOT starts_with(line, '<!--')),
    a AS (SELECT k.doc_id, min_by(line, i) AS line FROM k JOIN h USING (doc_id) WHERE i < h1 GROUP BY k.doc_id),
    b AS (SELECT k.doc_id, min_by(line, i) AS line FROM k JOIN h USING (doc_id) WHERE i > h1 AND (len(hs) < 2 OR i < hs[2]) GROUP BY k.doc_id)
    SELECT doc_id, substring(coalesce(a.line, b.line, ''), 1, 200) AS overview FROM n LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def overview_line(spark, sf_dir):
    return _noted(spark, sf_dir).select("doc_id", T.overview_line(F.col("note")).alias("overview"))


@query(f"""WITH {_NOTED_SQL}
    SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0
        THEN note || '## 🔄 Sync Log' || chr(10) || '- 2024-01-02 — commit abcdef12: new' || chr(10) || '- old' || chr(10)
        ELSE note || chr(10) || '## 🔄 Sync Log' || chr(10) || '- 2024-01-02 — commit abcdef12: new' || chr(10) END) AS note_md5 FROM n""")
def sync_log_append(spark, sf_dir):
    note = F.concat("note", F.when(F.col("doc_id") % 2 == 0, F.lit("## 🔄 Sync Log\n- old\n")).otherwise(""))
    logged = T.append_sync_log(note, F.lit("2024-01-02"), F.lit("abcdef1234567890"), F.lit("new"))
    return _noted(spark, sf_dir).select("doc_id", F.md5(logged).alias("note_md5"))


@query("""
    SELECT conv_id, turn, turn % 3 <> 1 AS conflict, CASE turn % 3 WHEN 0 THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) WHEN 1 THEN md5('same') ELSE md5('') END AS reason_md5 FROM conversations""")
def verdict_parse(spark, sf_dir):
    kind = F.col("turn") % 3
    reply = F.when(kind == 0, F.concat(F.lit("Conflict: YES\nREASON:  "), "text")).when(kind == 1, F.lit("CONFLICT:no\nReason: same")).otherwise(F.lit("unsure"))
    rows = table(spark, sf_dir, "conversations").withColumn("reply", reply)
    return rows.select("conv_id", "turn", T.conflict(F.col("reply")).alias("conflict"), F.md5(T.reason(F.col("reply"))).alias("reason_md5"))


@query("SELECT p_partkey, lower(regexp_replace(name, '([^^])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT p_partkey, replace(p_brand, '#', 'X') || 'Of' || substring(p_type, 1, 1) || lower(substring(p_type, 2)) AS name FROM part)")
def snake_case(spark, sf_dir):
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("X")), F.lit("Of"), F.initcap("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", P.snake_case(name).alias("snake"))


# --- paths, links and directories --------------------------------------------------------------


def _links(spark, sf_dir) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


_LINKS_SQL = """l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, (unnest(generate_series(1, len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) - 1)::INT AS pos FROM pages)"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, href FROM l")
def link_extract(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"WITH {_LINKS_SQL} SELECT page_id, href, min(pos) AS pos FROM l GROUP BY page_id, href")
def link_distinct_first(spark, sf_dir):
    return lookups.first_occurrences(_links(spark, sf_dir), ["page_id", "href"])


def _url_path() -> F.Column:
    return F.regexp_extract("url", r"^[a-z]+://([^?#]*[^?#/])", 1)


_URL_PATH_SQL = "regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1)"


@query(f"""
    WITH p AS (SELECT string_split({_URL_PATH_SQL}, '/') AS parts FROM pages),
    a AS (SELECT array_to_string(parts[1:unnest(generate_series(1, len(parts) - 1))], '/') AS path FROM p WHERE len(parts) > 1)
    SELECT path, count(*) AS n_files FROM a GROUP BY path""")
def dir_ancestor_rollup(spark, sf_dir):
    return lookups.directories(table(spark, sf_dir, "pages").select(_url_path().alias("path")))


@query(f"""
    SELECT page_id, starts_with(url, 'https://') AS is_remote, regexp_replace(regexp_extract({_URL_PATH_SQL}, '([^/:]+)$', 1), '\\.git$', '') AS name FROM pages""")
def url_classify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.is_remote(F.col("url"), ("https://",)).alias("is_remote"), urls.clone_name(_url_path()).alias("name"))


@query(f"""
    SELECT doc_id, suffix, language FROM (SELECT doc_id, (['.py', '.tsx', '.go', '.R', '.hh', '.PY', '.txt', '.gql'])[doc_id % 8 + 1] AS suffix FROM documents)
    JOIN (VALUES ('.py', 'python'), ('.tsx', 'typescript'), ('.go', 'go'), ('.R', 'r'), ('.hh', 'cpp'), ('.gql', 'graphql')) AS k(suffix, language) USING (suffix)""")
def ext_dispatch(spark, sf_dir):
    from ..operators import languages

    suffix = F.get(F.array(*map(F.lit, [".py", ".tsx", ".go", ".R", ".hh", ".PY", ".txt", ".gql"])), (F.col("doc_id") % 8).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), suffix).alias("rel_path"))
    return languages.supported(files).select("doc_id", "suffix", "language")


@query(f"""WITH {_LINKS_SQL},
    words AS (SELECT DISTINCT lower(regexp_replace(p_name, ' .*$', '')) AS path FROM part UNION SELECT DISTINCT 'the' FROM region UNION SELECT DISTINCT 'and' FROM region UNION SELECT 'de/index' FROM region),
    c AS (SELECT page_id, pos, regexp_replace(lower(substring(href, 2)), '[.,]$', '') AS raw FROM l),
    r AS (SELECT page_id, pos, 0 AS rank, raw AS candidate FROM c UNION ALL SELECT page_id, pos, 1, raw || '/index' FROM c),
    f AS (SELECT page_id, pos, min_by(candidate, rank) AS dst FROM r JOIN words ON candidate = path GROUP BY page_id, pos)
    SELECT page_id, dst, min(pos) AS pos FROM f GROUP BY page_id, dst""")
def import_resolve(spark, sf_dir):
    from ..operators import imports

    listing = (
        table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_name", " .*$", "")).alias("path")).union(spark.createDataFrame([("the",), ("and",), ("de/index",)], "path string")).distinct()
    )
    raw = F.regexp_replace(F.lower(F.substring("href", 2, 1 << 30)), r"[.,]\z", "")
    wanted = _links(spark, sf_dir).select(F.col("page_id").alias("src"), "pos", F.array(raw, F.concat(raw, F.lit("/index"))).alias("candidates"))
    return imports.resolve(wanted, listing).select(F.col("src").alias("page_id"), "dst", "pos")


# --- joins and aggregates ------------------------------------------------------------------------


@query("""
    SELECT s_nationkey, md5(string_agg('### ' || s_name || chr(10) || s_acctbal::DECIMAL(18, 2)::VARCHAR, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY s_name)) AS text_md5 FROM supplier GROUP BY s_nationkey""")
def directory_moc_input(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("summary", F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    return lookups.joined_summaries(rows, "s_nationkey", "s_name", "summary").select("s_nationkey", F.md5("text").alias("text_md5"))


@query("""
    SELECT lang, count(*) AS n_files, count(DISTINCT source) AS n_dirs, sum(greatest(1, CASE WHEN source = 'src1' THEN length(text) - length(replace(text, chr(10), '')) ELSE 1 END))::BIGINT AS n_chunks,
        (count(*) + count(DISTINCT source) + sum(greatest(1, CASE WHEN source = 'src1' THEN length(text) - length(replace(text, chr(10), '')) ELSE 1 END)))::BIGINT AS n_calls FROM documents GROUP BY lang""")
def cost_estimate(spark, sf_dir):
    from ..operators import cost

    docs = table(spark, sf_dir, "documents").withColumn("n_chunks", F.when(F.col("source") == "src1", T.line_count(F.col("text")) - 1).otherwise(1))
    return cost.calls(docs, group="lang", directory="source", chunks="n_chunks")


@query("SELECT doc_id, coalesce('q' || quality || 't' || toxic, '') AS summary FROM documents LEFT JOIN labels USING (doc_id)")
def summary_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("summary"))
    return lookups.with_summary(table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_paths(spark, sf_dir):
    return changes.new_paths(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def modified_paths(spark, sf_dir):
    return changes.modified_paths(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def deleted_paths(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id")
    return changes.without_deleted(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), gone, "doc_id")


@query("""
    SELECT doc_id, CASE WHEN lang = 'es' AND source <> 'src2' THEN 'A' WHEN source = 'src2' THEN 'D' ELSE 'M' END AS status FROM documents
    WHERE (lang = 'es' OR source = 'src2' OR lang = 'fr') AND NOT (lang = 'es' AND source = 'src2')""")
def sync_change_set(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    before = docs.filter("lang <> 'es'").withColumn("digest", F.when(F.col("lang") == "fr", F.concat(F.lit("x"), "digest")).otherwise(F.col("digest")))
    return changes.change_set(before, docs.filter("source <> 'src2'"), "doc_id")


@query("SELECT user_id, rank::INT AS rank, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def recent_log_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return logs.recent(events, "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "rank", "event_id", "event_type")


@query("SELECT 'notes/' || lower(replace(p_brand, '#', '-')) AS note_path, max_by(p_name || ' ' || p_partkey, p_partkey) AS content FROM part GROUP BY 1")
def note_collision(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("notes/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("note_path"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("content"), F.col("p_partkey").alias("ord"))
    return lookups.last_writer(rows, "note_path", "content", "ord")


# --- graph -------------------------------------------------------------------------------------


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """INDEX -> regions -> nations -> suppliers -> INDEX, as edges and nodes."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    pos = lambda key: F.col(key).cast("long").alias("pos")
    edges = (
        region.select(F.lit("INDEX").alias("src"), pos("r_regionkey"), of("r", "r_regionkey").alias("dst"))
        .union(nation.select(of("r", "n_regionkey"), pos("n_nationkey"), of("n", "n_nationkey")))
        .union(supplier.select(of("n", "s_nationkey"), pos("s_suppkey"), of("s", "s_suppkey")))
        .union(supplier.select(of("s", "s_suppkey"), F.lit(0).cast("long"), F.lit("INDEX")))
    )
    nodes = spark.createDataFrame([("INDEX",)], "node_path string").union(region.select(of("r", "r_regionkey"))).union(nation.select(of("n", "n_nationkey"))).union(supplier.select(of("s", "s_suppkey")))
    return edges, nodes


def _bfs_sql(depth: int) -> str:
    parts = ["SELECT 0::INT AS depth, 'INDEX' AS node_path, 1::BIGINT AS ord", "SELECT 1::INT, 'r' || r_regionkey, row_number() OVER (ORDER BY r_regionkey) FROM region", "SELECT 2::INT, 'n' || n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) FROM nation", "SELECT 3::INT, 's' || s_suppkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey, s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey"]
    return " UNION ALL ".join(parts[: min(depth, 3) + 1])


@query(_bfs_sql(2))
def graph_bfs(spark, sf_dir):
    return traverse.bfs(*_graph(spark, sf_dir), "INDEX", 2)


@query(_bfs_sql(4))
def graph_bfs_deep(spark, sf_dir):
    return traverse.bfs(*_graph(spark, sf_dir), "INDEX", 4)


@query("SELECT 'r' || r_regionkey AS path, (row_number() OVER (ORDER BY r_name))::BIGINT AS pos FROM region")
def top_level(spark, sf_dir):
    from ..operators import graph

    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("ord"))
    return graph.numbered(rows, None, "ord").select("path", "pos")


@query("SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::BIGINT AS pos FROM nation")
def child_edges(spark, sf_dir):
    from ..operators import graph

    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.col("n_name").alias("ord"))
    return graph.numbered(rows, "src", "ord").select("src", "dst", "pos")


@query("""
    SELECT 'r' || r_regionkey AS path, md5('---' || chr(10) || 'type: directory' || chr(10) || 'path: r' || r_regionkey || chr(10) || 'children:' || chr(10) || string_agg('  - n' || n_nationkey || '.py', chr(10) ORDER BY n_nationkey) || chr(10) || '---' || chr(10) || chr(10)
        || any_value(r_name) || chr(10) || chr(10) || '## Contents' || chr(10) || string_agg('- [[n' || n_nationkey || ']]', chr(10) ORDER BY n_nationkey) || chr(10)) AS note_md5
    FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey""")
def directory_note(spark, sf_dir):
    from ..operators import notes

    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("summary"))
    children = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("dst"), F.lit("file").alias("dst_type"), F.col("n_nationkey").cast("long").alias("pos"))
    return notes.directory_notes(region, children).select("path", F.md5("content").alias("note_md5"))


@query("""
    SELECT 'n' || n_nationkey || '.py' AS path, md5('---' || chr(10) || 'type: file' || chr(10) || 'path: n' || n_nationkey || '.py' || chr(10) || 'links:' || chr(10) || coalesce(string_agg('  - s' || s_suppkey, chr(10) ORDER BY s_suppkey), '  []') || chr(10) || '---' || chr(10) || chr(10)
        || '## n' || n_nationkey || '.py' || chr(10) || chr(10) || '<!-- summary placeholder -->' || chr(10) || chr(10) || '## Connections' || chr(10) || coalesce(string_agg('- [[s' || s_suppkey || ']]', chr(10) ORDER BY s_suppkey), '_No internal imports found._') || chr(10)) AS note_md5
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def file_note(spark, sf_dir):
    from ..operators import notes

    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit("").alias("summary"))
    links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".go")).alias("dst"), F.col("s_suppkey").alias("pos"))
    return notes.file_notes(files, links).select("path", F.md5("content").alias("note_md5"))


@query("""
    SELECT 'INDEX' AS path, md5('---' || chr(10) || 'type: index' || chr(10) || '---' || chr(10) || chr(10) || '## Index' || chr(10) || chr(10) || '<!-- repo summary placeholder -->' || chr(10) || chr(10) || '## Top Level' || chr(10)
        || string_agg('- [[r' || r_regionkey || ']]', chr(10) ORDER BY r_regionkey) || chr(10)) AS note_md5 FROM region""")
def index_note(spark, sf_dir):
    from ..operators import notes

    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.lit("directory").alias("node_type"), F.col("r_regionkey").cast("long").alias("pos"))
    return notes.index_note(top).select("path", F.md5("content").alias("note_md5"))


# --- search ------------------------------------------------------------------------------------


def _asked(spark, sf_dir) -> DataFrame:
    """The searches: every vector whose id is divisible by 50, against all vectors."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _top_sql(k: int) -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank
        FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= {k}"""


@query(f"SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank::INT AS rank FROM ({_top_sql(5)})")
def vector_topk(spark, sf_dir):
    hits = search.top_k(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5)
    return hits.select("query_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query(f"SELECT query_id, vec_id, rank::INT AS rank, CASE WHEN d <= 0.6 THEN 'high' ELSE 'low' END AS confidence, bool_and(d > 0.6) OVER (PARTITION BY query_id) AS all_low FROM ({_top_sql(5)})")
def vector_confidence(spark, sf_dir):
    hits = search.top_k(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5)
    return search.with_confidence(hits, 0.6).select("query_id", "vec_id", "rank", "confidence", "all_low")


def _cells(spark, sf_dir):
    from ..operators.cells import CellIndex
    from ..operators.lineage import folder

    own = CellIndex(spark, f"{folder(spark)}/cells-{uuid.uuid4().hex}")
    own.build(table(spark, sf_dir, "embeddings"))
    return own


@query(f"SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank::INT AS rank FROM ({_top_sql(5)})")
def vector_index_exact(spark, sf_dir):
    """The cell index with its second pass: the exact neighbours, from the cells that can hold them."""
    hits = _cells(spark, sf_dir).search(_asked(spark, sf_dir), 5, exact=True)
    return hits.select("query_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """The cell index without it, reading as many cells as its build has measured: whether nine tenths of the exact neighbours are found in the nearest cells."""
    asked = _asked(spark, sf_dir)
    near = _cells(spark, sf_dir).search(asked, 5).select("query_id", "vec_id", F.lit(1).alias("found"))
    exact = search.top_k(asked, table(spark, sf_dir, "embeddings"), 5)
    sums = exact.join(near, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.coalesce(F.sum("found"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))
    return sums.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("""
    WITH q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) AS tf FROM q GROUP BY ALL),
    d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), dt AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS qn FROM qt GROUP BY item_id), dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM dt GROUP BY doc_id),
    s AS (SELECT item_id, doc_id, sum(qt.tf * dt.tf) AS dot FROM qt JOIN dt USING (term) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, round(1 - dot / (qn * dn), 6) AS distance FROM s JOIN qn USING (item_id) JOIN dn USING (doc_id))
    SELECT item_id, doc_id, distance, (row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id))::INT AS rank FROM r QUALIFY rank <= 5""")
def sparse_cosine_search(spark, sf_dir):
    return search.sparse_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5)


@query(f"""
    WITH hit AS (SELECT DISTINCT vec_id FROM ({_top_sql(5)})),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IN (SELECT vec_id FROM hit)),
    m AS (SELECT doc_id, count(*) AS n_markers FROM l WHERE regexp_matches(line, 'The|And|De') GROUP BY doc_id),
    g AS (SELECT user_id, count(*) AS n_log, min(event_id) AS oldest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 5) GROUP BY user_id)
    SELECT vec_id AS file_id, coalesce(n_markers, 0) AS n_markers, coalesce(n_log, 0) AS n_log, oldest FROM hit LEFT JOIN m ON vec_id = doc_id LEFT JOIN g ON vec_id = user_id""")
def find_markers_pipeline(spark, sf_dir):
    hits = search.top_k(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5).select(F.col("vec_id").alias("file_id")).distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text").join(hits, "file_id", "left_semi")
    found = markers.scan(docs, key="file_id", markers=("The", "And", "De")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_markers"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "ts", "event_id").join(hits, "file_id", "left_semi")
    log = logs.recent(events, "file_id", [F.desc("ts"), F.desc("event_id")], 5).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_log"), F.min("event_id").alias("oldest"))
    zero = F.lit(0).cast("long")
    return hits.join(found, "file_id", "left").join(log, "file_id", "left").select("file_id", F.coalesce("n_markers", zero).alias("n_markers"), F.coalesce("n_log", zero).alias("n_log"), "oldest")


# --- source texts made from documents -------------------------------------------------------------


@query(f"""WITH {_NOTED_SQL}
    SELECT doc_id, pos, dst FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE ['a/' || source, 'b/' || lang] END) AS dst, unnest(CASE WHEN doc_id % 3 = 0 THEN []::BIGINT[] ELSE [0::BIGINT, 1::BIGINT] END) AS pos FROM n)""")
def note_links(spark, sf_dir):
    from ..operators import notes

    rows = _noted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("node_path"), F.col("note").alias("content"))
    return notes.links_of(rows).select(F.col("src").cast("long").alias("doc_id"), "pos", "dst")


@query("""
    WITH d AS (SELECT doc_id, '  if (x) {' || chr(10) || translate(text, '{}', '') || chr(10) || '  }' AS body, (length(text) - length(replace(text, chr(10), '')) + 5)::INT AS n FROM documents)
    SELECT doc_id, 1::INT AS start_line, n AS end_line, md5('function d' || doc_id || '() {' || chr(10) || body || chr(10) || '}') AS text_md5 FROM d
    UNION ALL SELECT doc_id, n + 2, n + 4, md5('export default class D' || doc_id || ' {' || chr(10) || '  run() { return {} }' || chr(10) || '}') FROM d
    UNION ALL SELECT doc_id, n + 5, n + 7, md5('const open = () => {' || chr(10) || 'never closed') FROM d""")
def brace_chunks(spark, sf_dir):
    """Each document as a block in a function, with a class and a function that never closes after it."""
    from ..operators import chunks

    number = F.col("doc_id").cast("string")
    body = F.concat(F.lit("  if (x) {\n"), F.translate("text", "{}", ""), F.lit("\n  }"))
    source = F.concat(F.lit("function d"), number, F.lit("() {\n"), body, F.lit("\n}\nlet y = 1\nexport default class D"), number, F.lit(" {\n  run() { return {} }\n}\nconst open = () => {\nnever closed"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.lit("braces_js").alias("chunker"), source.alias("text"))
    return chunks.chunks(files).select(F.col("rel_path").cast("long").alias("doc_id"), "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("""
    SELECT doc_id, chunk_no, start_line, end_line, (CASE chunk_no WHEN 0 THEN length('def f' || doc_id || '():') + length('    return ' || n_chars) + 13 WHEN 1 THEN 38 ELSE 29 END)::INT AS n_chars
    FROM documents, (VALUES (0, 1, 3), (1, 4, 6), (2, 5, 6)) AS c(chunk_no, start_line, end_line)""")
def python_chunks(spark, sf_dir):
    """A module for each document, read by the Python parser."""
    from ..operators import chunks

    number = F.col("doc_id").cast("string")
    source = F.concat(F.lit("def f"), number, F.lit("():\n    '''x'''\n    return "), F.col("n_chars").cast("string"), F.lit("\nclass C:\n    def m(self):\n        pass\n"))
    files = table(spark, sf_dir, "documents").select(number.alias("rel_path"), F.lit("python").alias("chunker"), source.alias("text"))
    return chunks.chunks(files).select(F.col("rel_path").cast("long").alias("doc_id"), "chunk_no", "start_line", "end_line", F.length("text").alias("n_chars"))


@query("""
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pkg/d' || doc_id || '.py' ELSE 'web/d' || doc_id || '.js' END AS src, source FROM documents),
    e AS (SELECT src, CASE WHEN doc_id % 2 = 0 THEN source || '.py' ELSE 'lib/' || source || '.js' END AS dst, 0 AS k FROM f
        UNION ALL SELECT a.src, b.src, 1 FROM f a JOIN f b ON b.doc_id = a.doc_id + 2)
    SELECT src, dst, k AS ord FROM e""")
def import_edges(spark, sf_dir):
    """Even documents as Python modules and odd ones as JavaScript; each imports its source and its neighbour."""
    from pyspark.sql import Window

    from ..operators import imports, languages

    number, other = F.col("doc_id").cast("string"), (F.col("doc_id") + 2).cast("string")
    even = F.col("doc_id") % 2 == 0
    path = F.when(even, F.concat(F.lit("pkg/d"), number, F.lit(".py"))).otherwise(F.concat(F.lit("web/d"), number, F.lit(".js")))
    python = F.concat(F.lit("import os, "), "source", F.lit("\nfrom .d"), other, F.lit(" import x\n"))
    script = F.concat(F.lit("import a from '../lib/"), "source", F.lit("'\nimport 'react'\nconst b = require('./d"), other, F.lit("')\n"))
    docs = table(spark, sf_dir, "documents").select("source", path.alias("rel_path"), F.when(even, python).otherwise(script).alias("text"))
    sources = docs.select("source").distinct()
    everything = docs.select("rel_path").union(sources.select(F.concat("source", F.lit(".py")))).union(sources.select(F.concat(F.lit("lib/"), "source", F.lit(".js"))))
    edges = imports.resolve(imports.wanted(languages.supported(docs)), imports.listing(everything))
    order = Window.partitionBy("src").orderBy("pos")
    return edges.select("src", "dst", (F.row_number().over(order) - 1).alias("ord"))


def _tree_sql() -> str:
    from ..scope import PACKAGE

    return f"""SELECT replace(filename, '{PACKAGE}/', '') AS rel_path, 'python' AS language, true AS is_utf8, (length(content) - length(replace(content, chr(10), '')) + 1)::INT AS n_lines
        FROM read_text('{PACKAGE}/**/*.py')"""


@query(_tree_sql())
def tree_scan(spark, sf_dir):
    """This package's own source tree through the data source; the tables play no part."""
    from ..operators.languages import supported
    from ..scope import PACKAGE
    from ..sources.tree import source_files

    return supported(source_files(spark, str(PACKAGE))).select("rel_path", "language", "is_utf8", T.line_count(F.col("text")).alias("n_lines"))


from . import repository_queries  # noqa: E402, F401 - registers its queries here
