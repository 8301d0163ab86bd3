"""Profile of repositories: files, sizes, languages, stack, frameworks, tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import paths as P
from repolens.functions.labels import half_up
from repolens.functions.text import lookup_map
from repolens.operators.skew import ordinal


def listed_files(files: DataFrame) -> DataFrame:
    """Files a profile lists: no skipped name or suffix, not too deep."""
    path = F.col("path")
    return files.where(P.keep_for_profile(path) & P.depth_ok(path))


def repo_size(files: DataFrame) -> DataFrame:
    """Listed files and their bytes; a repository without any has 0 and 0."""
    path = F.col("path")
    listed = P.keep_for_profile(path) & P.depth_ok(path)
    return files.groupBy("repo_id").agg(
        F.count_if(listed).alias("file_count"),
        F.coalesce(F.sum(F.when(listed, F.col("size"))), F.lit(0)).cast("bigint").alias("total_size_bytes"),
    )


def language_counts(files: DataFrame) -> DataFrame:
    """``(repo_id, language, files)`` of the listed files with a known language."""
    named = listed_files(files).select("repo_id", P.language(F.col("path")).alias("language"))
    return named.where(F.col("language").isNotNull()).groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def language_map(files: DataFrame) -> DataFrame:
    """The counts as one map per repository; its size is bound by the number of languages."""
    pairs = F.sort_array(F.collect_list(F.struct("language", "files")))
    return language_counts(files).groupBy("repo_id").agg(F.map_from_entries(pairs).alias("language_counts"))


def language_share(files: DataFrame, top: int = 8) -> DataFrame:
    """The most common languages with their share of all files of a known language."""
    counts = language_counts(files)
    rank = Window.partitionBy("repo_id").orderBy(F.desc("files"), "language")
    total = F.sum("files").over(Window.partitionBy("repo_id"))
    return (
        counts.withColumn("rank", F.row_number().over(rank))
        .withColumn("pct", half_up(F.col("files") / total * 100).cast("bigint"))
        .where(F.col("rank") <= top)
    )


def main_language(files: DataFrame) -> DataFrame:
    """The most common language over all files, skipped folders included; ties go by name."""
    path = F.col("path")
    counts = files.groupBy("repo_id", P.exact_language(path).alias("language")).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("language").isNotNull(), F.struct(-F.col("n"), F.col("language").alias("language"))))
    return counts.groupBy("repo_id").agg(F.coalesce(F.lower(best.language), F.lit("unknown")).alias("language"))


def root_markers(files: DataFrame) -> DataFrame:
    """``(repo_id, path, stack, priority)`` of the marker files at repository roots."""
    entry = lookup_map({name: i for i, (name, _) in enumerate(K.STACK_MARKERS)})
    stacks = F.array(*[F.lit(s) for _, s in K.STACK_MARKERS])
    found = files.where(F.col("path").isin([n for n, _ in K.STACK_MARKERS]))
    return found.select("repo_id", "path", F.try_element_at(entry, F.col("path")).alias("priority")).withColumn(
        "stack", F.get(stacks, F.col("priority"))
    )


def _has(path: str) -> Column:
    return F.col("path") == path


def _path_flags() -> dict[str, Column]:
    """What the framework rules ask of the path of a file."""
    return {
        "pytest_file": _has("pytest.ini") | _has("conftest.py"),
        "java_tests": F.col("path").rlike(r"(Test|Spec)\.java$"),
    }


def _content_flags(files: DataFrame, content: str) -> DataFrame:
    """What the framework rules ask of contents, one row per repository with one of the three files.

    The test of the path is pushed to the scan, so contents are read only where those files are.
    """
    holds = lambda path, word: _has(path) & F.contains(F.col(content).cast("string"), F.lit(word))
    return files.where(F.col("path").isin("pyproject.toml", "setup.cfg", "package.json")).groupBy("repo_id").agg(
        F.bool_or(holds("pyproject.toml", "pytest") | holds("setup.cfg", "pytest")).alias("pytest_named"),
        *[F.bool_or(holds("package.json", name)).alias(name) for name in ("vitest", "jest", "mocha")],
    )


def _framework(stack: Column) -> Column:
    default = F.coalesce(F.try_element_at(lookup_map(K.FRAMEWORK_BY_STACK), stack), F.lit("unknown"))
    return (
        F.when(F.col("pytest_file") | F.col("pytest_named"), F.lit("pytest"))
        .when(F.col("vitest"), F.lit("vitest"))
        .when(F.col("jest"), F.lit("jest"))
        .when(F.col("mocha"), F.lit("mocha"))
        .when(F.col("java_tests"), F.lit("junit"))
        .otherwise(default)
    )


def _per_language(files: DataFrame) -> DataFrame:
    """Counts, sizes, best marker and path flags per repository and language: one pass over paths and
    sizes, reduced to a few rows per repository in each task before anything is shuffled."""
    path = F.col("path")
    listed = P.keep_for_profile(path) & P.depth_ok(path)
    order = lookup_map({name: i for i, (name, _) in enumerate(K.STACK_MARKERS)})
    return files.groupBy(
        "repo_id", P.exact_language(path).alias("exact"), P.language(path).alias("language")
    ).agg(
        F.count("*").alias("n"),
        F.count_if(listed).alias("listed"),
        *([F.sum(F.when(listed, F.col("size"))).alias("bytes")] if "size" in files.columns else []),
        F.min(F.try_element_at(order, path)).alias("marker"),
        F.bool_or(_has("tsconfig.json")).alias("typed"),
        *[F.bool_or(test).alias(name) for name, test in _path_flags().items()],
    )


def _main_language() -> Column:
    """The language with most files; a language has one row per repository where ``exact`` is set."""
    best = F.min(F.when(F.col("exact").isNotNull(), F.struct(-F.col("n"), F.col("exact").alias("language"))))
    return F.lower(best.language)


def _stack() -> Column:
    stacks = F.array(*[F.lit(s) for _, s in K.STACK_MARKERS])
    marked = F.get(stacks, F.col("marker"))
    stack = F.when((marked == "javascript") & F.col("typed"), F.lit("typescript")).otherwise(marked)
    return F.coalesce(stack, F.col("main"), F.lit("unknown"))


def detect_stack(files: DataFrame) -> DataFrame:
    """``(repo_id, tech_stack)``: the first marker by priority, else the main language."""
    repos = _per_language(files).groupBy("repo_id").agg(
        F.min("marker").alias("marker"), F.bool_or("typed").alias("typed"), _main_language().alias("main")
    )
    return repos.select("repo_id", _stack().alias("tech_stack"))


def _with_flags(files: DataFrame, stacks: DataFrame, content: str) -> DataFrame:
    """Stacks with the framework flags of their repository."""
    flags = _path_flags()
    by_path = files.where(flags["pytest_file"] | flags["java_tests"]).groupBy("repo_id").agg(
        *[F.bool_or(test).alias(name) for name, test in flags.items()]
    )
    return stacks.join(by_path, "repo_id", "left").join(_content_flags(files, content), "repo_id", "left")


def detect_framework(files: DataFrame, stacks: DataFrame, content: str = "content") -> DataFrame:
    """``(repo_id, test_framework)`` by marker files, then by stack."""
    rows = _with_flags(files, stacks, content)
    return rows.select("repo_id", _framework(F.col("tech_stack")).alias("test_framework"))


def detect_runner(files: DataFrame, stacks: DataFrame, content: str = "content") -> DataFrame:
    """``(repo_id, runner)``: the command tests are run with, a narrower rule than the framework."""
    script = F.col("tech_stack").isin("javascript", "typescript")
    runner = (
        F.when(F.col("pytest_file"), F.lit("pytest"))
        .when(script & F.col("vitest"), F.lit("vitest"))
        .when(script & F.col("jest"), F.lit("jest"))
        .otherwise(F.lit("pytest"))
    )
    return _with_flags(files, stacks, content).select("repo_id", runner.alias("runner"))


def repo_profile(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per repository: stack, framework, size and language counts.

    Paths and sizes are read once, contents only of the files the framework rules name.

    ``language_counts`` holds the languages that occur among the listed files.
    """
    languages = sorted(set(K.LANGUAGES.values()))
    rows = _per_language(files).groupBy("repo_id").agg(
        F.sum("listed").alias("file_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        F.min("marker").alias("marker"),
        F.bool_or("typed").alias("typed"),
        _main_language().alias("main"),
        *[F.bool_or(name).alias(name) for name in _path_flags()],
        *[F.sum(F.when(F.col("language") == name, F.col("listed"))).alias(name) for name in languages],
    )
    counts = F.create_map(*[x for name in languages for x in (F.lit(name), F.col(f"`{name}`"))])
    rows = rows.join(_content_flags(files, content), "repo_id", "left").withColumn("tech_stack", _stack())
    return rows.select(
        "repo_id", "tech_stack", _framework(F.col("tech_stack")).alias("test_framework"), "file_count",
        "total_size_bytes", F.map_filter(counts, lambda _, n: n > 0).alias("language_counts"),
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """``(repo_id, path, parent, name, type, depth, size, language, sibling_rank)``.

    The listed files, and every directory above any file unless one of its parts is skipped. A file
    below the depth limit is not listed, its directories down to the limit are. Directories come
    first among siblings, then names.
    """
    path = F.col("path")
    leaves = listed_files(files).select(
        "repo_id", "path", F.lit("file").alias("type"), "size", P.language(path).alias("language")
    )
    parts = P.parts(path)
    above = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(K.TREE_DEPTH))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    folders = (
        files.where(F.size(parts) > 1)
        .select("repo_id", F.explode(above).alias("path"))
        .where(~P.has_part(path, K.PROFILE_SKIP_PARTS))
        .distinct()
        .select("repo_id", "path", F.lit("dir").alias("type"), F.lit(None).cast("bigint").alias("size"),
                F.lit(None).cast("string").alias("language"))
    )
    nodes = leaves.unionByName(folders).select(
        "repo_id", "path", P.parent(path).alias("parent"), P.file_name(path).alias("name"), "type",
        F.size(parts).alias("depth"), "size", "language",
    )
    return ordinal(nodes, ["repo_id", "parent"], [F.col("type") == "file", "name"], "sibling_rank")
