"""Directory trees, archives, workflow tables."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from repolens import constants as K
from repolens import schemas
from repolens.functions.text import decode_source
from repolens.plans.analysis import analyze
from repolens.operators.profile import repo_profile, repo_size
from repolens.sources import archives as A
from repolens.sources import corpus as CO
from repolens.sources import tables as T


@pytest.fixture
def tree(tmp_path):
    for path, data in {
        "one/__init__.py": b"", "one/.env": b"K=1", "one/_priv.py": b"x = 1\r\n", "one/pkg/a/b/deep.py": b"d", "one/.github/w.yml": b"on: x",
        "two/a b.txt": b"\xff\xfe", "two/pkg/\xc3\xa9.py".encode("latin-1").decode("utf-8"): b"y", "stray.txt": b"z",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_trees_have_every_file_once(spark, tree, depth):
    rows = CO.read_repo_trees(spark, tree, split_depth=depth).collect()
    got = {(r.repo_id, r.path): bytes(r.content) for r in rows}
    assert len(rows) == len(got) == 7
    assert got["one", "__init__.py"] == b"" and got["one", ".env"] == b"K=1" and got["one", ".github/w.yml"] == b"on: x"
    assert got["one", "pkg/a/b/deep.py"] == b"d" and got["two", "pkg/é.py"] == b"y"
    assert all(r.size == len(r.content) for r in rows)


def test_packed_corpus_reads_only_named_columns(spark, tree, tmp_path):
    out = str(tmp_path / "packed")
    CO.read_repo_trees(spark, tree).write.parquet(out)
    files = CO.read_corpus(spark, out)
    plan = repo_size(files)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    texts = files.select(decode_source(F.col("content")).alias("t")).collect()
    assert "x = 1\n" in [r.t for r in texts]


def zipped(members, compression=zipfile.ZIP_STORED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", compression) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_damaged_archives_are_judged(spark, tmp_path, method):
    """Whatever byte of a member is damaged, every archive gets a verdict and the good one is admitted."""
    whole = zipped({"a.py": "".join(f"line {i} of text\n" for i in range(400))}, method)
    (tmp_path / "good.zip").write_bytes(whole)
    for at in range(30, len(whole) - 60, max(1, len(whole) // 25)):
        damaged = bytearray(whole)
        damaged[at] ^= 0x5A
        (tmp_path / f"bad{at}.zip").write_bytes(bytes(damaged))
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    verdicts = {r.archive.rsplit("/", 1)[1]: r.reason for r in A.archive_verdicts(A.explode_archives(A.read_archives(spark, str(tmp_path)))).collect()}
    assert len(verdicts) == len(list(tmp_path.iterdir()))
    assert verdicts["good.zip"] is None and verdicts["cut.zip"] is not None
    assert sum(v == "corrupt" for v in verdicts.values()) > 5


def test_archives(spark, tmp_path):
    broken = bytearray(zipped({"a.py": "unique-content"}))
    at = broken.find(b"unique-content")
    broken[at] ^= 0xFF
    files = {
        "good.zip": zipped({"proj/a.py": "a", "proj/b/c.py": "c", "proj/empty/": ""}),
        "flat.ZIP": zipped({"a.py": "a", "b/c.py": "c"}),
        "single.zip": zipped({"only.py": "o"}),
        "up.zip": zipped({"ok.py": "1", "../evil.py": "2"}),
        "dots.zip": zipped({"a..b.py": "1"}),
        "abs.zip": zipped({"/etc/passwd": "1"}),
        "crc.zip": bytes(broken),
        "text.zip": b"this is no archive",
        "notes.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    members = A.explode_archives(A.read_archives(spark, str(tmp_path))).withColumn("archive", F.substring_index("archive", "/", -1)).cache()
    verdicts = {r.archive: r.reason for r in A.archive_verdicts(members).collect()}
    assert verdicts == {
        "good.zip": None, "flat.ZIP": None, "single.zip": None, "up.zip": "unsafe path", "dots.zip": "unsafe path",
        "abs.zip": "unsafe path", "crc.zip": "corrupt", "text.zip": "not a zip archive",
    }
    rows = {(r.repo_id, r.path): bytes(r.content) for r in A.archive_files(members).where("size > 0").collect()}
    assert rows == {
        ("good.zip", "a.py"): b"a", ("good.zip", "b/c.py"): b"c", ("flat.ZIP", "a.py"): b"a", ("flat.ZIP", "b/c.py"): b"c",
        ("single.zip", "only.py"): b"o",
    }
    admitted, refused = A.admit_archives(members)
    assert {r.archive for r in admitted.select("archive").distinct().collect()} == {"good.zip", "flat.ZIP", "single.zip"}
    assert refused.count() == 5


def test_large_archives_are_refused_unread(spark, tmp_path, monkeypatch):
    (tmp_path / "big.zip").write_bytes(zipped({"a.py": "x" * 500}))
    (tmp_path / "small.zip").write_bytes(zipped({"a.py": "x"}))
    monkeypatch.setattr(K, "MAX_ARCHIVE_BYTES", 300)
    members = A.explode_archives(A.read_archives(spark, str(tmp_path)))
    got = {r.archive.rsplit("/")[-1]: r.reason for r in A.archive_verdicts(members).collect()}
    assert got == {"big.zip": "too large", "small.zip": None}


def test_many_members_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "_BATCH_BYTES", 1000)
    (tmp_path / "many.zip").write_bytes(zipped({f"d/{i}.py": "y" * 300 for i in range(50)}))
    assert A.explode_archives(A.read_archives(spark, str(tmp_path))).count() == 50


def test_climbing_paths(spark):
    names = {"a/b": False, "a/../b": False, "a/../../b": True, "../a": True, "./a": False, "a/./../..": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.v for r in df.select("n", A._resolves_outside(F.col("n")).alias("v")).collect()} == names


def test_conform(spark):
    old = spark.createDataFrame([("i", "r", 7)], "issue_id string, repo_id string, extra int")
    new = schemas.conform(old, schemas.ISSUES)
    assert new.columns == schemas.ISSUES.names + ["extra"]
    assert [f.dataType for f in new.schema.fields[:-1]] == [f.dataType for f in schemas.ISSUES.fields]
    assert new.first().extra == 7 and new.first().confidence is None
    assert schemas.conform(new, schemas.ISSUES).schema == new.schema


def test_tables(spark, tmp_path):
    path = str(tmp_path / "issues")
    rows = [(f"i{i}", f"r{i % 5}", "high") for i in range(100)]
    df = spark.createDataFrame(rows, "issue_id string, repo_id string, severity string")
    T.append_table(df, path, schemas.ISSUES, buckets=8)
    T.append_table(df.limit(1), path, schemas.ISSUES, buckets=8)
    assert T.read_table(spark, path, schemas.ISSUES).count() == 101
    one = T.read_table(spark, path, schemas.ISSUES, repo_id="r1", buckets=8)
    assert {r.repo_id for r in one.collect()} == {"r1"} and one.count() >= 20
    assert "PartitionFilters: [isnotnull(repo_bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert one.schema == schemas.ISSUES
    assert len(os.listdir(path)) <= 10


def test_profile(spark):
    rows = [
        ("py", "requirements.txt", "flask"), ("py", "src/a.py", "x"), ("py", "node_modules/b.js", "x"), ("py", "logo.png", "x"),
        ("ts", "package.json", '{"vitest": 1}'), ("ts", "tsconfig.json", "{}"), ("both", "Pipfile", ""), ("both", "package.json", "jest"),
        ("java", "src/AppSpec.java", "x"), ("tie", "a.rb", ""), ("tie", "b.go", ""), ("skip", "node_modules/x.js", ""), ("none", "LICENSE", ""),
        ("cfg", "setup.cfg", "[tool:pytest]"), ("nested", "sub/pytest.ini", ""), ("nested", "sub/go.mod", ""),
    ]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string").withColumn("size", F.length("content").cast("long"))
    got = {r.repo_id: (r.tech_stack, r.test_framework, r.file_count, r.language_counts) for r in repo_profile(files).collect()}
    assert got == {
        "py": ("python", "pytest", 2, {"Python": 1}), "ts": ("typescript", "vitest", 2, {"JSON": 2}),
        "both": ("python", "jest", 2, {"JSON": 1}), "java": ("java", "junit", 1, {"Java": 1}),
        "tie": ("go", "go_test", 2, {"Go": 1, "Ruby": 1}), "skip": ("javascript", "jest", 0, {}), "none": ("unknown", "unknown", 1, {}),
        "cfg": ("python", "pytest", 1, {}), "nested": ("unknown", "unknown", 2, {}),
    }


def test_trees_are_analysed_as_they_are_read(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "_a.py").write_bytes(b"import os\r\neval(x)\r\xff")
    (tmp_path / "shop" / "b.js").write_bytes(b"el.innerHTML = 1\r\n")
    rows = analyze(CO.read_repo_trees(spark, str(tmp_path))).select("file_path", "line_number", "title").collect()
    assert sorted(map(tuple, rows)) == [("_a.py", 3, "Syntax Error"), ("b.js", 1, "Potential XSS via innerHTML")]


def test_the_size_limit_is_a_parameter(spark, tmp_path):
    small, large = zipped({"p/a.py": "x"}), zipped({"p/b.py": "y" * 5000})
    (tmp_path / "small.zip").write_bytes(small)
    (tmp_path / "large.zip").write_bytes(large)
    for limit, admitted in ((len(small), ["a.py"]), (len(large), ["a.py", "b.py"]), (1, [])):
        members = A.explode_archives(A.read_archives(spark, str(tmp_path), limit))
        assert sorted(r.path for r in A.archive_files(members, limit).collect()) == admitted
        refused = A.admit_archives(members, limit)[1].collect()
        assert [r.reason for r in refused] == ["too large"] * (2 - len(admitted))


def test_unwrapping_leaves_contents_in_place(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"p/a.py": "x", "p/q/b.py": "y"}))
    (tmp_path / "b.zip").write_bytes(zipped({"p/a.py": "x", "c.py": "y"}))
    out = str(tmp_path / "members")
    A.explode_archives(A.read_archives(spark, str(tmp_path))).write.parquet(out)
    rows = A.unwrap_root(spark.read.parquet(out))
    assert sorted(r.path for r in rows.collect()) == ["a.py", "c.py", "p/a.py", "q/b.py"]
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_an_empty_archive_is_admitted(spark, tmp_path):
    (tmp_path / "empty.zip").write_bytes(zipped({}))
    members = A.explode_archives(A.read_archives(spark, str(tmp_path)))
    assert [r.reason for r in A.archive_verdicts(members).collect()] == [None]
    assert A.archive_files(members).count() == 0


def test_profile_reads_contents_of_named_files_only(spark, tmp_path):
    out = str(tmp_path / "packed")
    spark.createDataFrame([("r", "a.py", 1, "x")], "repo_id string, path string, size long, content string").write.parquet(out)
    plan = repo_profile(CO.read_corpus(spark, out))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert [("content" in s.split("ReadSchema")[1], "In(path, [package.json,pyproject.toml,setup.cfg])" in s) for s in sorted(scans, key=lambda s: "content" in s)] == [
        (False, False), (True, True)]
