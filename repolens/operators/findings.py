"""Findings of all rules: dispatch, union, deduplication, and storing them as issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens import constants as K
from repolens.functions import paths as P
from repolens.functions import text as X
from repolens.operators import factrules
from repolens.operators.enrich import root_cause
from repolens.operators.facts import extract_facts
from repolens.operators.lines import LINE_RULES, LineRule, apply_line_rules, hit_findings, line_hits, rule_language
from repolens.session import materialize

KEY = ["repo_id", "file_path", "line_number", "title"]


def stack_allows(path: Column, stack: Column) -> Column:
    """True if the rules for this file's language run on repositories of this stack."""
    python = P.has_ext(path, K.PYTHON_SUFFIXES) & stack.isin(K.PYTHON_RULE_STACKS)
    script = P.has_ext(path, K.SCRIPT_SUFFIXES) & stack.isin(K.SCRIPT_RULE_STACKS)
    return python | script


def dispatch(rows: DataFrame, stacks: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose language is analysed in repositories of their stack; no stack counts as unknown.

    ``stacks(repo_id, tech_stack)`` is one row per repository. It is written first, once, so that Spark
    knows its bytes and broadcasts it below its own threshold. Beyond that, use this on findings, which
    are narrow: the outcome is the same.
    """
    side = materialize(stacks.select("repo_id", F.coalesce("tech_stack", F.lit("unknown")).alias("_stack")), "stacks")
    joined = rows.join(side, "repo_id", "left")
    return joined.where(stack_allows(F.col(path), F.coalesce("_stack", F.lit("unknown")))).drop("_stack")


def file_findings(facts: DataFrame) -> DataFrame:
    """Findings of the file-local fact rules, for files the analysis looks at."""
    path = F.col("path")
    analysed = facts.where(P.keep_for_analysis(path) & P.has_ext(path, K.PYTHON_SUFFIXES))
    found = [rule(analysed) for rule in factrules.FILE_RULES]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def line_findings(files: DataFrame, rules: list[LineRule] = LINE_RULES, content: str = "content") -> DataFrame:
    """Findings of the line rules, before files that do not parse are taken out."""
    return apply_line_rules(files.where(P.keep_for_analysis(F.col("path"))), rules, content)


def scan_files(files: DataFrame, rules: list[LineRule] = LINE_RULES, content: str = "content") -> DataFrame:
    """Facts of Python files and hits of the line rules, a row per file, from one scan of the contents."""
    path = F.col("path")
    named = with_text(files, content).withColumn("language", F.when(P.keep_for_analysis(path), rule_language(path)))
    source = F.when(is_python(path), F.col(content)).alias(content)
    return extract_facts(named.select("repo_id", "path", source, line_hits(rules, content).alias("hits")), content, "hits")


def scanned_findings(scanned: DataFrame, scan_unparsed: bool = False) -> DataFrame:
    """Findings of single files from :func:`scan_files`. Files that are no valid Python have no line
    findings unless ``scan_unparsed``; one the parser only gave up on, for its depth or size, keeps them."""
    lines = scanned if scan_unparsed else scanned.where(F.coalesce(F.col("error.kind"), F.lit("")) != "syntax_error")
    return file_findings(scanned).unionByName(hit_findings(lines))


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Contents as text; bytes are decoded."""
    if isinstance(files.schema[content].dataType, T.BinaryType):
        return files.withColumn(content, X.decode_source(F.col(content)))
    return files


def is_python(path: Column) -> Column:
    return P.has_ext(path, K.PYTHON_SUFFIXES) | path.endswith(".py")


def python_files(files: DataFrame) -> DataFrame:
    return files.where(is_python(F.col("path")))


def all_findings(
    files: DataFrame,
    rules: list[LineRule] = LINE_RULES,
    stacks: DataFrame | None = None,
    content: str = "content",
    scan_unparsed: bool = False,
) -> DataFrame:
    """Every finding of every rule, before deduplication.

    Contents are read once, for patterns and syntax trees together, and never shuffled; what is written and
    joined afterwards are facts and hits. ``seq`` orders findings as they are produced: Python file
    checks, missing tests, scripts. With ``stacks`` only findings of languages analysed in their
    repository's stack are kept. Contents may be text or bytes.
    """
    scanned = materialize(scan_files(files, rules, content), "scanned")
    tests = factrules.untested_functions(python_files(scanned))
    found = scanned_findings(scanned, scan_unparsed).unionByName(tests)
    return found if stacks is None else dispatch(found, stacks, "file_path")


def dedup_findings(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """The first finding, by ``seq``, of each repository, file, line and title.

    Each task keeps only its first row of a key before the shuffle, so many copies of one finding
    do not meet in one task.
    """
    first = Window.partitionBy(*KEY).orderBy(seq)
    return findings.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per repository before and after deduplication."""
    per_key = findings.groupBy(*KEY).agg(F.count("*").alias("n"))
    return per_key.groupBy("repo_id").agg(F.sum("n").alias("raw"), F.count("*").alias("deduplicated"))


def store_findings(files: DataFrame, out: str, rules: list[LineRule] = LINE_RULES, stacks: DataFrame | None = None, content: str = "content") -> dict[str, int]:
    """Writes the deduplicated findings of a corpus to ``out/findings`` and its facts to ``out/scanned``, and gives what the run
    saw: ``files``, ``bytes``, ``unparsed`` files, ``findings`` with copies, and ``distinct`` ones.

    The numbers are observed as the rows pass by on their way to the tables; nothing is read again for them.
    """
    read, parsed, raw, kept = (Observation(n) for n in ("read", "parsed", "raw", "kept"))
    size = F.octet_length(F.col(content))
    seen = files.observe(read, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    scanned = scan_files(seen, rules, content).observe(parsed, F.count_if(F.col("error.kind").isNotNull()).alias("unparsed"))
    scanned.write.mode("overwrite").parquet(f"{out}/scanned")
    stored = files.sparkSession.read.schema(scanned.schema).parquet(f"{out}/scanned")
    found = scanned_findings(stored).unionByName(factrules.untested_functions(python_files(stored)))
    found = found if stacks is None else dispatch(found, stacks, "file_path")
    unique = dedup_findings(found.observe(raw, F.count(F.lit(1)).alias("findings"))).observe(kept, F.count(F.lit(1)).alias("distinct"))
    unique.write.mode("overwrite").parquet(f"{out}/findings")
    return {**read.get, **parsed.get, **raw.get, **kept.get}


def to_issues(findings: DataFrame, run_id: str, detected_at: Column | None = None) -> DataFrame:
    """Findings as open issues with their root cause.

    The id is a hash of run and finding, so a repeated task writes the same rows.
    """
    parts = [F.lit(run_id), F.col("repo_id"), F.col("file_path"), F.col("line_number").cast("string"), F.col("title")]
    return findings.select(
        F.sha2(F.concat_ws("\u0001", *parts), 256).alias("issue_id"),
        F.lit(run_id).alias("run_id"),
        *[c for c in findings.columns if c != "seq"],
        F.to_json(root_cause(F.col("category"), F.col("file_path"))).alias("root_cause"),
        F.to_json(F.array("file_path")).alias("affected_files"),
        F.lit("open").alias("status"),
        (F.current_timestamp() if detected_at is None else detected_at).alias("detected_at"),
    )


def files_with_issues(issues: DataFrame) -> DataFrame:
    return issues.where(F.coalesce("file_path", F.lit("")) != "").select("repo_id", "file_path").distinct()
