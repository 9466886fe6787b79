"""The queries of this subpackage over the benchmark tables, with SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, fill_middle, license_scan, mixing, pii, quality_model, quality_rules, secret_scan, simhash, substring_dedup, toxicity
from .shared import bound_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "at", "nth", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["web-1"])
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failures")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does by itself, from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["web-1"])


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_license_scan": op12_license_scan,
    "rule_ablations": rule_ablations,
}

_MEASURES_SQL = r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
        g AS (SELECT r, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
        d AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) > 1 AND w3 IS NOT NULL AS twice FROM g),
        c AS (SELECT r, i, twice OR coalesce(lag(twice) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS covered FROM d WINDOW p AS (PARTITION BY r ORDER BY i)),
        cw AS (SELECT r, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY r),
        ww AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(DISTINCT word) AS n_distinct_words, count(*) FILTER (WHERE regexp_matches(word, '[#*$%&|<>]')) AS n_symbol_words FROM w GROUP BY r),
        l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
        ll AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_distinct_words, 0) AS n_distinct_words, coalesce(n_symbol_words, 0) AS n_symbol_words,
            length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
            length(regexp_replace(text, '[^|]', '', 'g')) AS n_pipes, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim, length(text) AS n_chars
            FROM t LEFT JOIN ww USING (r) LEFT JOIN ll USING (r) LEFT JOIN cw USING (r))"""


def _rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, rule in quality_rules.RULES)
    base, mask = quality_rules.BASE, quality_rules.POLICIES["web-1"].mask
    return f"""{_MEASURES_SQL},
        b AS (SELECT *, ({bits})::BIGINT AS failures FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {base}) <> 0 AS base_failed, (failures & {mask}) = 0 AS kept, failures FROM b"""


def _ablations_sql() -> str:
    policy = quality_rules.POLICIES["web-1"]
    bits = " + ".join(f"CASE WHEN {rule} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, rule in quality_rules.RULES)
    rules = ", ".join(f"('{name}', {quality_rules.BIT[name]}::BIGINT)" for name in policy.rules)
    return f"""{_MEASURES_SQL},
        b AS (SELECT ({bits})::BIGINT & {policy.mask} AS bits FROM m)
        SELECT rule, count(*) AS n_docs, count(*) FILTER (WHERE bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE bits = bit) AS n_failed_alone, count(*) FILTER (WHERE bits & ~bit = 0) AS n_kept_without
        FROM b, (VALUES {rules}) AS r(rule, bit) GROUP BY rule"""


def _licenses_sql() -> str:
    of = license_scan.templates()
    listed = ", ".join(f"({n}, '{label}', {base}, {k}, {gap}, {len(words) - k + 1}, {words!r})" for n, label, base, k, gap, words in of)
    gram = lambda words, at, k: f"array_to_string({words}[{at} + 1:{at} + {k}], ' ')"
    sizes = ", ".join(f"({k})" for k in sorted({k for _, _, _, k, _, _ in of}))
    return f"""
        WITH tp(template, label, base, k, gap, places, words) AS (VALUES {listed}),
        sd AS (SELECT template, label, base, k, gap, places, pos, {gram("words", "pos", "k")} AS gram FROM (SELECT *, unnest(range(places)) AS pos FROM tp)),
        t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan._UPPER}', '{license_scan._LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
        u AS (SELECT r, unnest(words) AS w0, unnest(words[2:] || ['']) AS w1, unnest(words[3:] || ['', '']) AS w2, unnest(range(len(words))) AS i, len(words) AS n FROM t),
        g AS (SELECT r, i, k, CASE k WHEN 2 THEN w0 || ' ' || w1 ELSE w0 || ' ' || w1 || ' ' || w2 END AS gram FROM u, (VALUES {sizes}) AS s(k) WHERE i + k <= n),
        h AS (SELECT r, i, i - pos AS diagonal, pos, template, label, base, k, gap, places FROM g JOIN sd USING (k, gram)),
        d AS (SELECT DISTINCT r, template, gap, diagonal FROM h),
        b AS (SELECT r, template, diagonal, coalesce((diagonal - lag(diagonal) OVER p > gap)::INT, 1) AS begins FROM d WINDOW p AS (PARTITION BY r, template ORDER BY diagonal)),
        m AS (SELECT r, template, diagonal, sum(begins) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM b),
        s AS (SELECT r, template, label, base, k, gap, places, span, min(i) AS first, max(i) + k - 1 AS last, count(DISTINCT pos) / places AS share FROM h JOIN m USING (r, template, diagonal) GROUP BY r, template, label, base, k, gap, places, span),
        v AS (SELECT *, share >= {license_scan.SHARE} AND last - first + 1 <= (places + k - 1) * 1.25 + gap AS good FROM s),
        f AS (SELECT r, count(*) FILTER (WHERE good AND base) AS n_base, min(first) FILTER (WHERE good AND base) AS first_word, max(first) FILTER (WHERE good AND base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good) AS labels, max(share) AS score FROM v GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM t LEFT JOIN f USING (r)"""


ORACLES = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER p AS key, count(*) OVER p AS n FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        m AS (SELECT key, min(doc_id) AS low FROM k WHERE n = 13 GROUP BY key),
        r AS (SELECT doc_id, i, word, coalesce(n = 13 AND low < doc_id, false) AS again FROM k LEFT JOIN m USING (key)),
        c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM r),
        s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)""",
    "op8_quality_rules": _rules_sql(),
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op11_fill_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        d AS (SELECT *, len(u) AS n, ('0x' || substring(h, 1, 8))::BIGINT AS h1, ('0x' || substring(h, 9, 8))::BIGINT AS h2, ('0x' || substring(h, 17, 8))::BIGINT AS h3, ('0x' || substring(h, 25, 8))::BIGINT AS h4 FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_license_scan": _licenses_sql(),
    "rule_ablations": _ablations_sql(),
}
