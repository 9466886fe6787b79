"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more of ``[A-Za-z0-9+/_-]`` with a digit, or any value of 6 or more
characters, digits or not, that is assigned to a word such as ``password`` or ``token``. The forest sees
its length, its character classes and the transitions between them, how much of it common letter pairs
and dictionary words cover, the path of its document, and the words beside it. All of it is Spark
expressions; the forest is Spark's own, fitted on labelled findings (value, before, after, path,
label), at most ``MOST`` of them. No labelled findings come with the tables, so
``labelled_findings`` makes some by rule: keys, tokens and passwords of common shapes against commit
hashes, checksums, identifiers, paths, placeholders, names and counters. Documents never enter the fit.

Nothing is shuffled: texts without a candidate are dropped by two linear patterns, the others are
split into words once; only a word that holds a candidate gets its context.

Defined cases: null and empty texts have no candidates; repeated rows give repeated findings, and a value
found twice in a word is found twice; a null id or path is kept; an empty table gives an empty
result; extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample

MOST = 8_000
_RUN = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{16,}}+"
_SPACE = r"[\x20\x09-\x0D]+"

# The words and pairs that features count.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
DICTIONARY = "password|secret|token|example|sample|test|user|name|value|data|file|path|class|function|method|index|string|number|object|array|list|config|default|local|server|client|request|response|message|account|service|manager|handler|controller|python|java|script|image|video|version|release|build|update|create|delete|change|your|here|this|that|with|from|key|api|get|set|lib|usr|bin|src|http|www|com|org"
FOR_WORDS = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|auth|bearer|credential|private[_-]?key|access[_-]?key|client[_-]?secret"
AGAINST_WORDS = r"commit|revision|sha-?(?:1|256)|md5|hash|digest|checksum|etag|uuid|guid|version|build|isbn|order|serial|id"
#: A value given to one of these words, with at most a sign and quotes between.
ASSIGNED = rf"(?i)(?:{FOR_WORDS})[\"']?[\x20\x09-\x0D]?[=:][\x20\x09-\x0D]?[\"']?([^\x20\x09-\x0D\"'`,;<>(){{}}\[\]=:]{{6,}})"
ASSIGNED_LAST = ASSIGNED + r"[^\x20\x09-\x0D]*\z"
PLACEHOLDERS = "xxxx|0000|1234|abcd|your|example|changeme|placeholder|dummy|redacted|sample|here"
TEST_PATHS = "test|example|sample|mock|fixture|docs?/|readme|vendor"
KNOWN = "AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-|AIza[A-Za-z0-9_-]{30,}|sk_live_|eyJ[A-Za-z0-9]"


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, at, nth, value, before, after): at is the word's number from 0, nth the candidate's in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    some = rows.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED))
    words = some.select("doc_id", "path", F.split("text", _SPACE).alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    given = lambda i: F.concat(word(i - 2), F.lit(" "), word(i - 1), F.lit(" "), word(i))
    # Only a word after or with a sign of assignment is looked at with the words before it.
    assigned = lambda i: (word(i).rlike("[=:]") | word(i - 1).rlike(r"[=:][\"']?\z")) & given(i).rlike(ASSIGNED_LAST)
    found = words.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: word(i).rlike(CANDIDATE) | assigned(i))))
    at = F.col("at")
    first = F.greatest(at - 3, F.lit(0))
    context = found.select("doc_id", "path", "at", word(at).alias("word"), F.array_join(F.slice("words", first + 1, at - first), " ").alias("before"), word(at + 1).alias("after"), F.when(assigned(at), F.regexp_extract(given(at), ASSIGNED_LAST, 1)).otherwise("").alias("own"))
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1), lambda x: ~F.contains(F.col("own"), x))
    values = F.concat(F.when(F.col("own") != "", F.array("own")).otherwise(F.array().cast("array<string>")), runs)
    each = context.withColumn("values", values).select("*", F.posexplode("values").alias("nth", "value"))
    earlier = F.size(F.filter(F.slice("values", F.lit(1), F.col("nth")), lambda x: x == F.col("value")))
    each = each.withColumn("count", earlier + 1)
    before = F.concat("before", F.lit(" "), F.expr("substring_index(word, value, count)"))
    return each.select("doc_id", "path", "at", "nth", "value", before.alias("before"), "after")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features() -> dict[str, Column]:
    """Columns over (value, before, after, path)."""
    v, low = F.col("value"), F.lower("value")
    n = F.length(v).cast("double")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    share = lambda pattern, text=v: _count(text, pattern) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[+/_-]"),
        "slashes": share("/"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "only_hex": flag(low.rlike(r"\A[0-9a-f-]+\z")),
        "only_digits": flag(v.rlike(r"\A[0-9_/-]+\z")),
        "only_letters": flag(v.rlike(r"\A[A-Za-z]+\z")),
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "same_again": share(r"(.)(?=\1)"),
        "pairs": share(f"(?=(?:{PAIRS}))", low),
        "vowels": share("[aeiou]", low),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length)), F.lit(0)).cast("double") / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / n,
        "placeholder": flag(low.rlike(PLACEHOLDERS)),
        "known": flag(v.rlike(KNOWN)),
        "uuid": flag(low.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")),
        "near_for": flag(near.rlike(rf"(?:\A|[^a-z])(?:{FOR_WORDS})(?:[^a-z]|\z)")),
        "near_against": flag(near.rlike(rf"(?:\A|[^a-z])(?:{AGAINST_WORDS})(?:[^a-z]|\z)")),
        "assigned": flag(F.col("before").rlike(r"[=:][\x20\"']*\z")),
        "quoted": flag(F.col("before").rlike(r"[\"']\z")),
        "test_path": flag(F.lower("path").rlike(TEST_PATHS)),
    }


def labelled_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """(value, before, after, path, label, template): about n findings made by 16 rules, half of them for secrets; the same every time."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    hexed = lambda salt, size: F.substring(h(salt), 1, size)
    mixed = F.regexp_replace(F.concat(F.base64(F.unhex(h("a"))), F.base64(F.unhex(h("b")))), "=", "")
    capitals = F.upper(F.translate(mixed, "+/01", "QX27"))
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(options))) + 1).cast("int"))
    size = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("int")
    prose = pick("p1", "the of and ", "er en die ", "la de que ", "see also ", "", "on this is ")
    later = pick("p2", "and the", "en", "de", "", ".", "was")
    dictionary = F.concat(pick("d1", "get", "user", "config", "default", "manager", "updateRequest"), pick("d2", "Account", "Service", "_handler", "Response", "-message"), pick("d3", "ByName", "_version", "Controller", "Index", "_list"), pick("d4", "2", "10", "3", "v1"))
    signs = F.translate(F.substring(mixed, F.lit(1), size("p", 7, 14)), "aeiou05", "!@#$%!~")
    letters = F.substring(F.regexp_replace(mixed, "[^A-Za-z]", ""), F.lit(1), size("l", 10, 30))
    rows = [
        (1, signs, F.concat(prose, pick("k5", "password=", "passwd: ", "pwd=", 'passphrase = "'))),
        (1, letters, F.concat(prose, pick("k6", "password=", "token = ", "client_secret: ", 'api_key="'))),
        (0, pick("x2", "required", "optional", "string", "changeme", "example", "invalid", "expired", "username", "disabled", "undefined"), F.concat(prose, pick("n6", "password: ", "token=", "secret: ", 'auth = "'))),
        (1, F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16)), F.concat(prose, pick("k0", "", "", "aws_access_key_id=", "key: "))),
        (1, hexed("c", 18), F.concat(prose, pick("k1", "password=", "passwd=", "pwd: ", "secret="))),
        (1, F.substring(h("t"), F.lit(1), size("t", 32, 64)), F.concat(prose, pick("k2", 'token = "', "auth_token='", "api_key: ", 'secret = "'))),
        (1, F.substring(mixed, F.lit(1), size("m", 24, 64)), F.concat(prose, pick("k3", "api_key=", "client_secret: ", "Authorization: Bearer ", 'secret_key = "', "password="))),
        (1, F.concat(pick("g", "ghp_", "sk_live_", "gho_"), F.substring(F.translate(mixed, "+/", "ab"), 1, 36)), prose),
        (1, F.substring(F.translate(mixed, "+/", "-_"), 1, 40), F.concat(prose, pick("k4", "token: ", "access_token=", "private_key="))),
        (0, hexed("s", 40), F.concat(prose, pick("n0", "commit ", "revision ", "sha1 ", "git hash "))),
        (0, F.concat(hexed("u", 8), F.lit("-"), F.substring(h("u"), 9, 4), F.lit("-"), F.substring(h("u"), 13, 4), F.lit("-"), F.substring(h("u"), 17, 4), F.lit("-"), F.substring(h("u"), 21, 12)), F.concat(prose, pick("n1", "uuid ", "id=", "request id: ", ""))),
        (0, dictionary, F.concat(prose, pick("n2", "", "token = ", "call ", "password=", "key: "))),
        (0, F.concat(pick("f1", "usr/local/lib/", "src/main/java/", "docs/images/", "home/user/data/"), pick("f2", "python3", "server2/config", "file10", "v2/index")), prose),
        (0, pick("x", "your_api_key_here_1234", "xxxxxxxxxxxxxxxx0000", "changeme_password_123", "example-token-0000-abcd", "1234567890abcdef1234"), F.concat(prose, pick("n3", "password=", "token = ", 'secret = "', "api_key: "))),
        (0, F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**17)).cast("string"), 18, "20240131"), F.concat(prose, pick("n4", "order ", "serial ", "", "version "))),
        (0, hexed("q", 32), F.concat(prose, pick("n5", "md5 ", "checksum: ", "etag=", "digest "))),
    ]
    tables = [
        spark.range(n // 16).select(value.alias("value"), before.alias("before"), later.alias("after"), pick("path", "src0", "src7", "app/main.py", "lib/a.js", "config.yml").alias("path"), F.lit(label).alias("label"), F.lit(k).alias("template"))
        for k, (label, value, before) in enumerate(rows)
    ]
    return reduce(DataFrame.unionByName, tables)


def train(findings: DataFrame, *, trees: int = 24, depth: int = 8, seed: int = 11) -> PipelineModel:
    """A forest from labelled findings (value, before, after, path, label), at most ``MOST`` of them."""
    own = features()
    order = F.xxhash64("value", "before")
    sample = bounded_sample(findings, MOST, "value", "before").orderBy(order, "value").select(*[c.alias(k) for k, c in own.items()], F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=list(own), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3, featureSubsetStrategy="sqrt", cacheNodeIds=False)
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def scan(docs: DataFrame, model: PipelineModel, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, at, nth, value, score, is_secret."""
    own = features()
    rows = candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col)
    scored = model.transform(rows.select("doc_id", "at", "nth", "value", *[c.alias(k) for k, c in own.items()]))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
    return scored.select("doc_id", "at", "nth", "value", score.alias("score"), (score >= threshold).alias("is_secret"))
