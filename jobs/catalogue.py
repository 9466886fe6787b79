"""The jobs as named queries: each runs twice into one new folder, and gives what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import folder

from . import note_vault, task_feed

#: Words of the benchmark's texts that stand for markers.
MARKERS = ["The", "And", "De"]
SUMMARY = note_vault.DEFAULTS["summary_chars"]


def job1_task_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        task_feed.run(spark, f"{sf_dir}/documents[.]parquet", f"{at}/feed", f"{at}/progress", markers=MARKERS)
    return task_feed.open_tasks(task_feed.feed(spark, f"{at}/feed")).select("doc_id", "lang", "source", "line_number", "tag", F.md5("text").alias("text_md5"))


def job2_note_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        note_vault.run(spark, f"{sf_dir}/documents.parquet", f"{at}/vault", markers=MARKERS)
    return note_vault.live(spark, f"{at}/vault").select("path", "node_type", F.md5("content").alias("note_md5"))


QUERIES = {"job1_task_feed": job1_task_feed, "job2_note_vault": job2_note_vault}

_LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)"
_TAG = "CASE WHEN contains(line, 'The') THEN 'The' WHEN contains(line, 'And') THEN 'And' ELSE 'De' END"
_MARKED = "(contains(line, 'The') OR contains(line, 'And') OR contains(line, 'De'))"

ORACLES = {
    "job1_task_feed": f"""
        SELECT doc_id, lang, source, i::INT AS line_number, {_TAG} AS tag, md5(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM {_LINES} WHERE {_MARKED}""",
    "job2_note_vault": f"""
        WITH m AS (SELECT doc_id, count(*) AS tasks FROM {_LINES} WHERE {_MARKED} GROUP BY doc_id),
        f AS (SELECT coalesce(lang, 'none') AS a, coalesce(source, 'none') AS b, 'd' || doc_id || '.md' AS name, length(text) AS chars, coalesce(tasks, 0) AS tasks,
            substring(regexp_replace(regexp_extract(coalesce(text, ''), '\\S[^\\n]*'), '\\s+$', ''), 1, {SUMMARY}) AS summary FROM documents LEFT JOIN m USING (doc_id)),
        d AS (SELECT a AS path, * FROM f UNION ALL SELECT a || '/' || b, * FROM f)
        SELECT a || '/' || b || '/' || name AS path, 'file' AS node_type, md5('---' || chr(10) || 'type: file' || chr(10) || 'path: ' || a || '/' || b || '/' || name || chr(10) || 'links:' || chr(10) || '  []' || chr(10) || '---' || chr(10) || chr(10)
            || '## ' || name || chr(10) || chr(10) || CASE WHEN summary = '' THEN '<!-- summary placeholder -->' ELSE summary END || chr(10) || chr(10) || '## Connections' || chr(10) || '_No internal imports found._' || chr(10)) AS note_md5 FROM f
        UNION ALL SELECT path, 'directory', md5('---' || chr(10) || 'type: directory' || chr(10) || 'path: ' || path || chr(10) || '---' || chr(10) || chr(10) || count(*) || ' files, ' || coalesce(sum(chars), 0) || ' characters, ' || coalesce(sum(tasks), 0) || ' open tasks' || chr(10)) FROM d GROUP BY path""",
}
