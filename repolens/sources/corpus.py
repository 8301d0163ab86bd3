"""Corpora as rows ``files(repo_id, path, size, content)``: directory trees and packed tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repolens import schemas


class RepoTreeSource(DataSource):
    """Every regular file below each repository directory of a root folder.

    Spark's own file sources leave out names that start with ``_`` or ``.``, such as
    ``__init__.py``; this one reads them. The root must be a folder all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self):
        return schemas.FILES

    def reader(self, schema):
        return RepoTreeReader(self.options["path"], int(self.options.get("split_depth", "1")))


class RepoTreeReader(DataSourceReader):
    """One task per directory down to ``split_depth`` levels below a repository, so that one large
    repository is read by many tasks. The driver lists only those levels, no files."""

    def __init__(self, root: str, split_depth: int):
        self.root = root
        self.split_depth = split_depth

    def partitions(self):
        tasks = []
        for repo in sorted(e.name for e in os.scandir(self.root) if e.is_dir()):
            level = [""]
            for depth in range(self.split_depth + 1):
                last = depth == self.split_depth
                tasks += [InputPartition((repo, rel, last)) for rel in level]
                if not last:
                    level = [os.path.join(rel, name) for rel in level for name in self._folders(repo, rel)]
        return tasks

    def _folders(self, repo, rel):
        with os.scandir(os.path.join(self.root, repo, rel)) as entries:
            return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))

    def read(self, partition):
        repo, rel, deep = partition.value
        base = os.path.join(self.root, repo)
        for folder, _, names in os.walk(os.path.join(base, rel)):
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.isfile(full):
                    with open(full, "rb") as f:
                        data = f.read()
                    yield repo, os.path.relpath(full, base).replace(os.sep, "/"), len(data), data
            if not deep:
                break


def read_repo_trees(spark: SparkSession, root: str, split_depth: int = 1) -> DataFrame:
    spark.dataSource.register(RepoTreeSource)
    return spark.read.format("repo_tree").option("split_depth", split_depth).load(root)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A packed corpus; queries that do not name ``content`` do not read it."""
    return spark.read.parquet(path)
