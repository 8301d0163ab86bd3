"""Trees listed in rounds by tasks: the files of a plain walk, whatever the rounds and the form of the root."""

import os
import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from repolens.sources import corpus as CO
from repolens.sources import trees as TR


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "ro ot"
    for path, data in {
        "one/__init__.py": b"", "one/.env": b"K=1", "one/pkg/a/b/deep.py": b"d", "one/.github/w.yml": b"on: x", "one/_x/_y/z#1.py": b"%41",
        "two/a b.txt": b"\xff\xfe", "two/pkg/é.py": b"y", "stray.txt": b"z",
    }.items():
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (base / "none").mkdir()
    for i in range(120):
        (base / f"big/d{i % 7}/e{i % 3}").mkdir(parents=True, exist_ok=True)
        (base / f"big/d{i % 7}/e{i % 3}/f{i}.py").write_bytes(b"x" * i)
    os.symlink(base / "two", base / "one/loop")
    os.symlink(base / "two/a b.txt", base / "one/link.txt")
    os.symlink(base / "nowhere", base / "one/broken")
    return base


def rows(df):
    return sorted((r.repo_id, r.path, r.size, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("entries", [1, 10, 20_000])
@pytest.mark.parametrize("uri", [False, True])
def test_the_files_of_the_other_reader(spark, root, entries, uri):
    place = pathlib.Path(root).as_uri() if uri else str(root)
    mine = rows(TR.read_trees(spark, place, entries))
    assert mine == rows(CO.read_repo_trees(spark, str(root)))
    assert len(mine) == 128 and ("one", "link.txt", 2, b"\xff\xfe") in mine


def test_the_driver_lists_nothing(spark, root, monkeypatch):
    """Listing is done by tasks: it works while the driver cannot look into a folder."""

    def refuse(*a, **k):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(os, "scandir", refuse)
    monkeypatch.setattr(os, "walk", refuse)
    monkeypatch.setattr(os, "listdir", refuse)
    assert TR.list_trees(spark, str(root)).count() == 128


def test_a_filtered_listing_reads_what_is_left(spark, root):
    listing = TR.list_trees(spark, str(root))
    (root / "big/d0/e0/f0.py").unlink()
    python = listing.where("path LIKE '%.py' AND repo_id <> 'big'")
    assert [r[1] for r in rows(TR.read_listed(python, str(root)))] == ["__init__.py", "_x/_y/z#1.py", "pkg/a/b/deep.py", "pkg/é.py"]
    large = TR.read_listed(listing.where("repo_id = 'big' AND size > 117"), str(root), largest=118)
    assert sorted((r.size, r.content is None) for r in large.collect()) == [(118, False), (119, True)]
    with pytest.raises(PySparkException, match="f0.py"):
        TR.read_listed(listing, str(root)).count()


def test_no_repositories(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert TR.read_trees(spark, str(tmp_path)).collect() == []
    with pytest.raises(PySparkException):
        TR.list_trees(spark, str(tmp_path / "absent"))


def test_round_trip(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", "a.py", "x = 'é'"), ("r", ".h/_i.py", ""), ("q q", "b/c/d.txt", "y" * 100_000)], "repo_id string, path string, content string"
    )
    written = TR.write_trees(files, str(tmp_path / "out"))
    assert sorted(map(tuple, written.collect())) == [("q q", "b/c/d.txt", 100_000), ("r", ".h/_i.py", 0), ("r", "a.py", 8)]
    TR.write_trees(files, str(tmp_path / "out"))
    back = TR.read_trees(spark, str(tmp_path / "out")).withColumn("content", F.col("content").cast("string"))
    assert sorted(back.drop("size").collect()) == sorted(files.collect())


@pytest.mark.parametrize("repo, path", [("r", "../x"), ("r", "/x"), ("..", "x"), ("a/b", "x"), ("r", "a//b"), ("r", None), (None, "x"), ("r", "")])
def test_a_path_that_leaves_its_repository_is_refused(spark, tmp_path, repo, path):
    files = spark.createDataFrame([(repo, path, "x")], "repo_id string, path string, content string")
    with pytest.raises(PySparkException, match="repository"):
        TR.write_trees(files, str(tmp_path / "out"))
    assert not (tmp_path / "x").exists()
