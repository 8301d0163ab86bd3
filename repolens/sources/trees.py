"""Directory trees in any file system Arrow knows (``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a plain path all
executors see), listed, read and written by tasks.

The root holds one directory per repository. Listing goes in rounds over open directories as rows: a task walks each
of its directories until it has seen a number of entries, and what it has not entered by then is the next round.
So neither a large root nor a large repository is listed in one place. Written by rounds into the checkpoint
folder, a lost executor costs only its own directories.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import materialize

LISTING = "repo_id string, path string, size bigint"
FILES = "repo_id string, path string, size bigint, content binary"
#: Entries a task lists below one directory before it leaves the rest to the next round.
ENTRIES = 20_000
#: Contents and files that one reading task should have.
TASK_BYTES = 128 * 1024 * 1024
TASK_FILES = 5_000
#: A larger file is listed without its content.
LARGEST_FILE = 1024 * 1024 * 1024
_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 10_000


def _open(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    system, path = afs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (afs.LocalFileSystem(), os.path.abspath(root))
    return system, path.rstrip("/")


def _below(root: str, *parts: str) -> str:
    return "/".join([root, *[p for p in parts if p]])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded number and weight."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += weight(row)
        if len(kept) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield _batch(kept, schema)
            kept, size = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _walk(system: afs.FileSystem, root: str, repo: str | None, start: str, entries: int) -> Iterator[tuple]:
    """``(repo_id, path, size, open)`` below one directory: its files, and the directories it did not come to.

    Without a repository it is the root, whose directories are all left open. Links to directories below a
    repository are not followed, links to files are; what is neither file nor directory is left out.
    """
    local = isinstance(system, afs.LocalFileSystem)
    todo, seen = deque([start]), 0
    while todo:
        if seen >= entries:
            yield from ((repo, rel, 0, True) for rel in todo)
            return
        rel = todo.popleft()
        for info in system.get_file_info(afs.FileSelector(_below(root, repo or "", rel))):
            seen += 1
            inner = f"{rel}/{info.base_name}" if rel else info.base_name
            if info.type == afs.FileType.Directory:
                if repo is None:
                    yield info.base_name, "", 0, True
                elif not (local and os.path.islink(info.path)):
                    todo.append(inner)
            elif info.type == afs.FileType.File and repo is not None:
                yield repo, inner, info.size, False


def list_trees(spark: SparkSession, root: str, entries: int = ENTRIES) -> DataFrame:
    """``(repo_id, path, size)`` of every regular file below each repository directory of ``root``, names
    that start with ``_`` or ``.`` included. Files beside the repositories belong to none and are left out.

    The driver sees how many directories are open, not which. A root without directories gives no rows; one that
    does not exist is an error.
    """
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("open", pa.bool_())])

    def walk(batches):
        system, base = _open(root)
        found = (row for repo, rel in _rows(batches) for row in _walk(system, base, repo, rel, entries))
        return _batches(found, schema)

    todo, rounds = spark.createDataFrame([(None, "")], "repo_id string, path string"), []
    while True:
        seen = materialize(todo.mapInArrow(walk, f"{LISTING}, open boolean"), "listing")
        rounds.append(seen.where(~F.col("open")).drop("open"))
        todo = seen.where("open").select("repo_id", "path")
        left = todo.count()
        if left == 0:
            return reduce(DataFrame.unionByName, rounds)
        todo = todo.repartition(min(left, 8 * spark.sparkContext.defaultParallelism))


def read_listed(listing: DataFrame, root: str, largest: int = LARGEST_FILE) -> DataFrame:
    """``(repo_id, path, size, content)`` of listed files, dealt to tasks by their number and size.

    So a listing can be filtered before anything is read. A file above ``largest`` bytes keeps its size and has
    a null content. A file that has gone since it was listed is an error.
    """
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def read(batches):
        system, base = _open(root)

        def one(repo, path, size):
            if size > largest:
                return repo, path, size, None
            with system.open_input_stream(_below(base, repo, path)) as f:
                data = f.read()
            return repo, path, len(data), data

        found = (one(*row) for row in _rows(batches))
        return _batches(found, schema, lambda row: len(row[3] or b""))

    rows, size = listing.agg(F.count(F.lit(1)), F.sum("size")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(rows // TASK_FILES + 1, (size or 0) // TASK_BYTES + 1, min(cores, rows))
    return listing.select("repo_id", "path", "size").repartition(int(tasks)).mapInArrow(read, FILES)


def read_trees(spark: SparkSession, root: str, entries: int = ENTRIES) -> DataFrame:
    """``files(repo_id, path, size, content)`` of all repositories below ``root``."""
    return read_listed(list_trees(spark, root, entries), root)


def write_trees(files: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Write every row of ``files`` to ``root/repo_id/path``, such as the files a codemod has rewritten, and
    return what was written as ``(repo_id, path, size)``.

    Text is written as UTF-8. A repeated task writes the same bytes again; files that are there and not named
    stay. A null, and a path that leaves its repository, are errors. Each key stands in one row. Without rows
    the root is made all the same.
    """
    system, base = _open(root)
    system.create_dir(base, recursive=True)
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64())])

    def write(batches):
        system, base = _open(root)
        made: set[str] = set()

        def one(repo, path, data):
            if repo is None or path is None or data is None:
                raise ValueError(f"a file without repository, path or content: {repo!r}, {path!r}")
            if repo in ("", ".", "..") or "/" in repo or not path or any(p in ("", ".", "..") for p in path.split("/")):
                raise ValueError(f"not a path inside a repository: {repo!r}, {path!r}")
            full = _below(base, repo, path)
            folder = full.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(full) as f:
                f.write(data)
            return repo, path, len(data)

        return _batches((one(*row) for row in _rows(batches)), schema)

    return materialize(files.select("repo_id", "path", F.col(content).cast("binary").alias("content")).mapInArrow(write, LISTING), "written")
