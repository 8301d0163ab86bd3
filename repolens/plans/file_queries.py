"""Queries over file listings, archives, paths, lines and text."""

from __future__ import annotations

import io
import zipfile
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens import constants as K
from repolens import schemas
from repolens.functions import jsontext as J
from repolens.functions import labels as L
from repolens.functions import names as N
from repolens.functions import paths as P
from repolens.functions import text as X
from repolens.operators import lines as LN
from repolens.operators import profile as PR
from repolens.plans.registry import Tables, literal, query
from repolens.session import ensure_checkpoint_dir, materialize
from repolens.sources import archives as A
from repolens.sources import trees


def _names(values) -> str:
    return ", ".join(literal(v) for v in values)


_SUFFIX = r"regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)"
_LANGUAGE = "CASE lower({s}) " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in K.LANGUAGES.items()) + " END"
_EXACT_LANGUAGE = _LANGUAGE.replace("lower({s})", "{s}").replace("{s}", _SUFFIX)
_LANGUAGE = _LANGUAGE.replace("{s}", _SUFFIX)
_IN_PROFILE = (
    f"NOT list_has_any(string_split(path, '/'), [{_names(K.PROFILE_SKIP_PARTS)}]) "
    f"AND lower({_SUFFIX}) NOT IN ({_names(K.PROFILE_SKIP_SUFFIXES)})"
)
_SHALLOW = "len(string_split(path, '/')) <= 6"
_LISTED = f"(SELECT * FROM {{PATHS}} p WHERE {_IN_PROFILE} AND {_SHALLOW})"
# Lines as (repo_id, path, line_number, line); the corpus has no line break but the newline.
_LINES = """(SELECT repo_id, path, CAST(i AS int) AS line_number, l[i] AS line FROM (
  SELECT repo_id, path, l, unnest(range(1, len(l) + 1 - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END)) AS i
  FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l FROM {CORPUS} c) a) b)"""


@query("SELECT repo_id, path, CAST(octet_length(encode(content)) AS bigint) AS bytes, md5(content) AS hash FROM {CORPUS} c")
def corpus_scan(t: Tables) -> DataFrame:
    return t.corpus.select("repo_id", "path", F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("hash"))


@query("SELECT repo_id, path, CAST(octet_length(encode(content)) AS bigint) AS bytes, md5(content) AS hash FROM {CORPUS} c")
def tree_scan(t: Tables) -> DataFrame:
    """The corpus written as directory trees, listed and read back."""
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/trees-{uuid4().hex}"
    trees.write_trees(t.corpus, root)
    return trees.read_trees(t.spark, root).select("repo_id", "path", F.col("size").alias("bytes"), F.md5("content").alias("hash"))


@query("SELECT repo_id, path, md5(content) AS hash FROM {CORPUS} c")
def decode_source(t: Tables) -> DataFrame:
    """The corpus as bytes with Windows newlines, read back as text."""
    raw = F.replace("content", F.lit("\n"), F.lit("\r\n")).cast("binary")
    return t.corpus.select("repo_id", "path", F.md5(X.decode_source(raw)).alias("hash"))


@F.pandas_udf(T.BinaryType())
def _zipped(path: pd.Series, content: pd.Series) -> pd.Series:
    """One archive per file, with the file below the folder ``proj``."""

    def one(name, text):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"proj/{name}", text)
        return buffer.getvalue()

    return pd.Series([one(p, c) for p, c in zip(path, content)])


@query("SELECT concat(repo_id, '-', doc_id, '.zip') AS archive, path, md5(content) AS hash FROM {CORPUS} c")
def explode_archives(t: Tables) -> DataFrame:
    """The corpus packed into one archive per file, and unpacked again."""
    packed = t.corpus.select(
        F.concat("repo_id", F.lit("-"), "doc_id", F.lit(".zip")).alias("path"), _zipped("path", "content").alias("content")
    )
    members = materialize(A.explode_archives(packed.withColumn("length", F.octet_length("content").cast("bigint"))), "members")
    return A.archive_files(members).select(
        F.col("repo_id").alias("archive"), "path", F.md5(F.col("content")).alias("hash")
    )


@query("""
SELECT archive, CASE WHEN max(archive_bytes) > 104857600 THEN 'too large' WHEN bool_or(NOT crc_ok) THEN 'corrupt'
  WHEN bool_or(starts_with(member, '/') OR contains(member, '..')) THEN 'unsafe path' ELSE 'admitted' END AS verdict
FROM {MEMBERS} m GROUP BY archive
""")
def archive_admission(t: Tables) -> DataFrame:
    return A.archive_verdicts(t.members).select("archive", F.coalesce("reason", F.lit("admitted")).alias("verdict"))


@query("""
WITH m AS (SELECT * FROM {MEMBERS} m), bad AS (SELECT DISTINCT archive FROM m
  WHERE archive_bytes > 104857600 OR NOT crc_ok OR starts_with(member, '/') OR contains(member, '..'))
SELECT archive, ord, member FROM m WHERE archive NOT IN (SELECT archive FROM bad)
""")
def admitted_members(t: Tables) -> DataFrame:
    return A.admit_archives(t.members)[0].select("archive", "ord", "member")


@query("""
WITH m AS (SELECT archive, member, string_split(member, '/')[1] AS top, contains(member, '/') AS deep FROM {MEMBERS} m),
  one AS (SELECT archive FROM m GROUP BY archive HAVING count(DISTINCT top) = 1 AND bool_and(deep))
SELECT archive, member, CASE WHEN archive IN (SELECT archive FROM one) THEN substr(member, length(top) + 2) ELSE member END AS path FROM m
""")
def archive_unwrap_root(t: Tables) -> DataFrame:
    return A.unwrap_root(t.members).select("archive", "member", "path")


@query("""
SELECT issue_id, repo_id, title, status, '-' AS evidence, CAST(-1 AS double) AS confidence, strftime(detected_at, '%Y-%m-%d') AS day FROM {ISSUES} i
""")
def conform_schema(t: Tables) -> DataFrame:
    rows = schemas.conform(schemas.conform(t.issues, schemas.ISSUES), schemas.ISSUES)
    return rows.select(
        "issue_id", "repo_id", "title", "status", F.coalesce("evidence", F.lit("-")).alias("evidence"),
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.date_format("detected_at", "yyyy-MM-dd").alias("day"),
    )


@query(f"SELECT repo_id, path FROM {{PATHS}} p WHERE NOT list_has_any(string_split(path, '/'), [{_names(K.ANALYSIS_SKIP_PARTS)}])")
def filter_analysis_paths(t: Tables) -> DataFrame:
    return t.paths.where(P.keep_for_analysis(F.col("path"))).select("repo_id", "path")


@query(f"SELECT repo_id, path FROM {{PATHS}} p WHERE {_IN_PROFILE}")
def filter_profile_paths(t: Tables) -> DataFrame:
    return t.paths.where(P.keep_for_profile(F.col("path"))).select("repo_id", "path")


@query(f"SELECT repo_id, path FROM {{PATHS}} p WHERE lower({_SUFFIX}) IN ({_names(K.PYTHON_SUFFIXES + K.SCRIPT_SUFFIXES)})")
def filter_ext(t: Tables) -> DataFrame:
    return t.paths.where(P.has_ext(F.col("path"), K.PYTHON_SUFFIXES + K.SCRIPT_SUFFIXES)).select("repo_id", "path")


@query(f"SELECT repo_id, path FROM {{PATHS}} p WHERE {_SHALLOW}")
def filter_depth(t: Tables) -> DataFrame:
    return t.paths.where(P.depth_ok(F.col("path"))).select("repo_id", "path")


@query("""
SELECT repo_id, path, contains(regexp_extract(path, '[^/]*$'), 'test_') OR contains(path, '/tests/') AS is_test FROM {CORPUS} c
""")
def is_test_file(t: Tables) -> DataFrame:
    return t.corpus.select("repo_id", "path", P.is_test_file(F.col("path")).alias("is_test"))


@query(f"""
SELECT repo_id, path, line_number, line FROM {_LINES} l
WHERE path LIKE '%.js' AND trim(line) <> '' AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*')
""")
def js_code_lines(t: Tables) -> DataFrame:
    scripts = t.corpus.where(P.has_ext(F.col("path"), K.SCRIPT_SUFFIXES))
    return LN.source_lines(scripts).where(X.is_js_code(F.col("line")))


@query(f"SELECT repo_id, path, line_number, line FROM {_LINES} l")
def lines(t: Tables) -> DataFrame:
    return LN.source_lines(t.corpus)


@query("""
SELECT repo_id, path, coalesce(trim(CASE WHEN doc_id % 7 > 0 THEN string_split(content, chr(10))[CAST(doc_id % 7 AS int)] END), '') AS evidence FROM {CORPUS} c
""")
def evidence(t: Tables) -> DataFrame:
    number = (F.col("doc_id") % 7).cast("int")
    return t.corpus.select("repo_id", "path", X.evidence_line(X.split_lines(F.col("content")), number).alias("evidence"))


_PY_REDACT = """regexp_replace(line, '(=\\s*["''])[^"'']+(["''])', '\\1[REDACTED]\\2', 'g')"""


@query(f"""
SELECT repo_id, path, line_number, {_PY_REDACT} AS py, {_PY_REDACT.replace("(=", "([=:]")} AS js FROM {_LINES} l
""")
def redact(t: Tables) -> DataFrame:
    line = F.col("line")
    return LN.source_lines(t.corpus).select(
        "repo_id", "path", "line_number", X.redact_py(line).alias("py"), X.redact_js(line).alias("js")
    )


@query(f"""
SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS name, {_SUFFIX} AS suffix,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, replace(replace(path, '/', chr(92)), chr(92), '/') AS posix FROM {{PATHS}} p
""")
def path_parts(t: Tables) -> DataFrame:
    windows = F.translate(F.col("path"), "/", "\\")
    return t.paths.select(
        "repo_id", "path", P.file_name(F.col("path")).alias("name"), P.suffix(F.col("path")).alias("suffix"), P.parent(F.col("path")).alias("parent"),
        P.posix_path(windows).alias("posix"),
    )


@query(f"SELECT repo_id, path, coalesce({_LANGUAGE}, '-') AS language FROM {{PATHS}} p")
def file_language(t: Tables) -> DataFrame:
    return t.paths.select("repo_id", "path", F.coalesce(P.language(F.col("path")), F.lit("-")).alias("language"))


@query(f"""
SELECT repo_id, CAST(count(*) FILTER (WHERE {_IN_PROFILE} AND {_SHALLOW}) AS bigint) AS file_count,
  CAST(coalesce(sum(size) FILTER (WHERE {_IN_PROFILE} AND {_SHALLOW}), 0) AS bigint) AS total_size_bytes FROM {{PATHS}} p GROUP BY repo_id
""")
def repo_size(t: Tables) -> DataFrame:
    return PR.repo_size(t.paths)


_COUNTS = f"""(SELECT repo_id, language, CAST(count(*) AS bigint) AS files FROM
  (SELECT repo_id, {_LANGUAGE} AS language FROM {_LISTED} l) x WHERE language IS NOT NULL GROUP BY repo_id, language)"""


@query(f"SELECT repo_id, language, files FROM {_COUNTS} c")
def language_counts(t: Tables) -> DataFrame:
    return PR.language_map(t.paths).select("repo_id", F.explode("language_counts").alias("language", "files"))


@query(f"""
SELECT repo_id, language, files, rank, pct FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, language) AS int) AS rank,
  CAST(floor(files / sum(files) OVER (PARTITION BY repo_id) * 100 + 0.5) AS bigint) AS pct FROM {_COUNTS} c) r WHERE rank <= 8
""")
def language_share_top8(t: Tables) -> DataFrame:
    return PR.language_share(t.paths)


_MAIN = """(SELECT repo_id, lower(language) AS language FROM (SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS rn
  FROM (SELECT repo_id, %s AS language, count(*) AS n FROM {%s} f GROUP BY 1, 2) c WHERE language IS NOT NULL) r WHERE rn = 1)"""


@query(f"""
SELECT r.repo_id, coalesce(m.language, 'unknown') AS language FROM (SELECT DISTINCT repo_id FROM {{PATHS}} p) r
LEFT JOIN {_MAIN % (_EXACT_LANGUAGE, 'PATHS')} m ON m.repo_id = r.repo_id
""")
def main_language(t: Tables) -> DataFrame:
    return PR.main_language(t.paths)


_STACK = f"""(SELECT f.repo_id, coalesce(CASE WHEN s = 'javascript' AND ts THEN 'typescript' ELSE s END, m.language, 'unknown') AS tech_stack FROM
  (SELECT repo_id, bool_or(path = 'tsconfig.json') AS ts, arg_min(stack, pr) AS s FROM (SELECT repo_id, path,
     CASE path {" ".join(f"WHEN {literal(n)} THEN {literal(s)}" for n, s in K.STACK_MARKERS)} END AS stack,
     CASE path {" ".join(f"WHEN {literal(n)} THEN {i}" for i, (n, _) in enumerate(K.STACK_MARKERS))} END AS pr FROM {{MARKERS}} a) b GROUP BY repo_id) f
  LEFT JOIN {_MAIN % (_EXACT_LANGUAGE, 'MARKERS')} m ON m.repo_id = f.repo_id)"""


@query(f"""
SELECT repo_id, path, CASE path {" ".join(f"WHEN {literal(n)} THEN {literal(s)}" for n, s in K.STACK_MARKERS)} END AS stack,
  CAST(CASE path {" ".join(f"WHEN {literal(n)} THEN {i}" for i, (n, _) in enumerate(K.STACK_MARKERS))} END AS int) AS priority
FROM {{MARKERS}} m WHERE path IN ({_names(n for n, _ in K.STACK_MARKERS)})
""")
def root_markers(t: Tables) -> DataFrame:
    return PR.root_markers(t.markers)


@query(f"SELECT repo_id, tech_stack FROM {_STACK} s")
def detect_stack(t: Tables) -> DataFrame:
    return PR.detect_stack(t.markers)


_FLAGS = """(SELECT repo_id, bool_or(path IN ('pytest.ini', 'conftest.py')) AS ini,
  bool_or(path IN ('pyproject.toml', 'setup.cfg') AND contains(content, 'pytest')) AS named,
  bool_or(path = 'package.json' AND contains(content, 'vitest')) AS vitest, bool_or(path = 'package.json' AND contains(content, 'jest')) AS jest,
  bool_or(path = 'package.json' AND contains(content, 'mocha')) AS mocha,
  bool_or(path LIKE '%Test.java' OR path LIKE '%Spec.java') AS java FROM {MARKERS} m GROUP BY repo_id)"""
_DEFAULT_FRAMEWORK = "CASE tech_stack " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in K.FRAMEWORK_BY_STACK.items()) + " ELSE 'unknown' END"
_FRAMEWORK = (
    "CASE WHEN ini OR named THEN 'pytest' WHEN vitest THEN 'vitest' WHEN jest THEN 'jest' WHEN mocha THEN 'mocha' "
    f"WHEN java THEN 'junit' ELSE {_DEFAULT_FRAMEWORK} END"
)


@query(f"SELECT s.repo_id, {_FRAMEWORK} AS test_framework FROM {_STACK} s JOIN {_FLAGS} f ON f.repo_id = s.repo_id")
def detect_framework(t: Tables) -> DataFrame:
    return PR.detect_framework(t.markers, PR.detect_stack(t.markers))


@query(f"""
SELECT s.repo_id, CASE WHEN ini THEN 'pytest' WHEN tech_stack IN ('javascript', 'typescript') AND vitest THEN 'vitest'
  WHEN tech_stack IN ('javascript', 'typescript') AND jest THEN 'jest' ELSE 'pytest' END AS runner FROM {_STACK} s JOIN {_FLAGS} f ON f.repo_id = s.repo_id
""")
def detect_runner(t: Tables) -> DataFrame:
    return PR.detect_runner(t.markers, PR.detect_stack(t.markers))


@query(f"""
SELECT s.repo_id, s.tech_stack, {_FRAMEWORK} AS test_framework, n AS file_count, bytes AS total_size_bytes
FROM {_STACK} s JOIN {_FLAGS} f ON f.repo_id = s.repo_id JOIN
  (SELECT repo_id, CAST(count(*) AS bigint) AS n, CAST(sum(length(content)) AS bigint) AS bytes FROM {{MARKERS}} m GROUP BY repo_id) c ON c.repo_id = s.repo_id
""")
def repo_profile(t: Tables) -> DataFrame:
    files = t.markers.withColumn("size", F.octet_length("content").cast("bigint"))
    return PR.repo_profile(files).select("repo_id", "tech_stack", "test_framework", "file_count", "total_size_bytes")


_NODES = f"""(SELECT repo_id, path, 'file' AS type, size, {_LANGUAGE} AS language FROM {_LISTED} l UNION ALL
  SELECT DISTINCT repo_id, folder, 'dir', NULL, NULL FROM (SELECT repo_id, array_to_string(l[1:i], '/') AS folder FROM (
    SELECT repo_id, l, unnest(range(1, least(len(l), 7))) AS i FROM (SELECT repo_id, string_split(path, '/') AS l FROM {{PATHS}} p) a) b) c
  WHERE NOT list_has_any(string_split(folder, '/'), [{_names(K.PROFILE_SKIP_PARTS)}]))"""


@query(f"""
SELECT repo_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^/]*$') AS name, type,
  CAST(len(string_split(path, '/')) AS int) AS depth, coalesce(size, -1) AS size, coalesce(language, '-') AS language,
  row_number() OVER (PARTITION BY repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY type = 'file', regexp_extract(path, '[^/]*$')) AS sibling_rank
FROM {_NODES} n
""")
def tree_nodes(t: Tables) -> DataFrame:
    return PR.tree_nodes(t.paths).fillna(-1, ["size"]).fillna("-", ["language"])


_URL_OK = r"^https?://github\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+(\.git|/)?$"
_CLEAN_URL = f"""(SELECT page_id, u, CASE WHEN u = '' THEN 'empty' WHEN NOT regexp_matches(u, '{_URL_OK}') THEN 'invalid' ELSE '' END AS error
  FROM (SELECT page_id, rtrim(trim(url), '/') AS u FROM {{URLS}} a) b)"""
_CLONE_URL = f"(SELECT page_id, error, CASE WHEN error = '' THEN CASE WHEN u LIKE '%.git' THEN u ELSE concat(u, '.git') END ELSE '' END AS url FROM {_CLEAN_URL} c)"


@query(f"SELECT page_id, url, error FROM {_CLONE_URL} c")
def normalize_repo_url(t: Tables) -> DataFrame:
    return t.urls.select("page_id", N.normalize_repo_url(F.col("url")).alias("u")).select(
        "page_id", F.coalesce("u.url", F.lit("")).alias("url"), F.coalesce("u.error", F.lit("")).alias("error")
    )


@query(f"""
SELECT page_id, array_to_string(list_slice(string_split(rtrim(rtrim(url, '.git'), '/'), '/'), -2, -1), '/') AS name,
  array_to_string(list_slice(string_split(regexp_replace(url, '\\.git$', ''), '/'), -2, -1), '/') AS exact_name FROM {_CLONE_URL} c WHERE error = ''
""")
def repo_display_name(t: Tables) -> DataFrame:
    clean = t.urls.select("page_id", N.normalize_repo_url(F.col("url")).url.alias("url")).where(F.col("url").isNotNull())
    return clean.select(
        "page_id", N.repo_display_name(F.col("url")).alias("name"),
        N.repo_display_name(F.col("url"), exact_suffix=True).alias("exact_name"),
    )


@query(f"SELECT page_id, regexp_replace(url, '\\.git', '') AS url FROM {_CLONE_URL} c")
def display_url(t: Tables) -> DataFrame:
    clean = t.urls.select("page_id", N.normalize_repo_url(F.col("url")).url.alias("url"))
    return clean.select("page_id", F.coalesce(N.display_url(F.col("url")), F.lit("")).alias("url"))


@query("SELECT c_custkey, CASE WHEN lower(file_name) LIKE '%.zip' THEN replace(file_name, '.zip', '') ELSE '-' END AS name FROM {UPLOADS} u")
def archive_name(t: Tables) -> DataFrame:
    return t.uploads.select("c_custkey", F.coalesce(N.archive_name(F.col("file_name")), F.lit("-")).alias("name"))


@query("""
WITH a AS (SELECT conv_id, turn, text, length(text) - strpos(reverse(text), '{') + 1 AS s, length(text) - strpos(reverse(text), '}') + 1 AS e FROM {TEXTS} t)
SELECT conv_id, turn, CASE WHEN contains(text, '{') AND contains(text, '}') AND e > s AND json_valid(substr(text, s, e - s + 1)) THEN substr(text, s, e - s + 1) ELSE '{}' END AS piece FROM a
""")
def extract_last_json(t: Tables) -> DataFrame:
    return t.texts.select("conv_id", "turn", J.extract_last_json(F.col("text")).alias("piece"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN concat('{"root_cause":"', replace(text, '"', chr(92) || '"'), '"}') ELSE '-' END AS cause,
  CASE turn % 4 WHEN 0 THEN concat('c', conv_id) WHEN 1 THEN text ELSE '' END AS cause_text FROM {CAUSES} c
""")
def safe_root_cause(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.causes.select(
        "conv_id", "turn", F.coalesce(J.safe_root_cause(text), F.lit("-")).alias("cause"), J.root_cause_text(text).alias("cause_text")
    )


@query("""
SELECT repo_id, path, CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10)
  ELSE printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) END AS size FROM (SELECT repo_id, path, size * (size % 1000) AS b FROM {PATHS} p) x
""")
def format_bytes(t: Tables) -> DataFrame:
    return t.paths.select("repo_id", "path", L.format_bytes(F.col("size") * (F.col("size") % 1000)).alias("size"))


@query("""
SELECT seq, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END) AS iso FROM {EVENTS} e
""")
def iso_timestamps(t: Tables) -> DataFrame:
    return t.events.select("seq", L.iso_utc(F.col("ts")).alias("iso"))
