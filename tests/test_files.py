"""The listing of project files by tasks, against a listing of everything."""

import subprocess

import pytest
from pyspark.sql import functions as F

from siftwood.sources.files import PUSHDOWN, FilesReader, Folders, PrunedFilesReader, project_files

NAMES = ("a.py", "src/b.py", "src/deep/er/c.py", "src/deep/skip.log", "src/g[1]*/d.py", "src/g[1]*/e/f.py", "docs/é ü.md", "docs/keep.log", "docs/.gitignore", "build/x.py", "node_modules/y.js", ".hid/z.py", "many/0/f.txt", "many/1/f.txt", "many/2/f.txt")


@pytest.fixture
def project(tmp_path):
    for name in NAMES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == ".gitignore" else name)
    (tmp_path / ".gitignore").write_text("*.log\n/build/\n")
    (tmp_path / "docs" / ".gitignore").write_text("!keep.log\n")
    (tmp_path / "link.py").symlink_to("a.py")
    return tmp_path


def left_in(hidden):
    out = {n for n in NAMES if n not in ("src/deep/skip.log", "build/x.py", "node_modules/y.js", ".hid/z.py")} | {".gitignore"}
    return out | {"node_modules/y.js", ".hid/z.py"} if hidden else out


@pytest.mark.parametrize("git", [False, True])
@pytest.mark.parametrize("count", [1, 4, 7, 64])
def test_every_file_once_whatever_the_partitions(project, git, count):
    if git:
        subprocess.run(["git", "init", "-q", str(project)], check=True)
        subprocess.run(["git", "-C", str(project), "add", "src", "docs"], check=True)
        (project / "src" / "b.py").unlink()  # tracked, and gone
    reader = FilesReader(str(project), count)
    parts = reader.partitions()
    assert len(parts) <= count and reader.by_git == git
    found = [r[0] for p in parts for r in reader.read(p)]
    assert sorted(found) == sorted(left_in(git) - ({"src/b.py"} if git else set()))


def test_partitions_hold_folders_and_no_files(project):
    reader = FilesReader(str(project), 4)
    assert {f for p in reader.partitions() for f in p.flat + p.deep} == {"", "src", "docs", "many"}
    gone = Folders(["not/there"], ["nor/this"], reader.partitions()[0].rules)
    assert list(reader.read(gone)) == []


def test_pushed_prefixes_leave_folders_closed(project):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = PrunedFilesReader(str(project), 64)
    filters = [StringStartsWith(("path",), "src/de"), GreaterThan(("size",), 1)]
    assert list(reader.pushFilters(filters)) == filters
    assert {f for p in reader.partitions() for f in p.flat + p.deep} == {"src", "src/deep", "src/deep/er"}  # src/de.py may be there
    one = PrunedFilesReader(str(project), 64)
    list(one.pushFilters([EqualTo(("path",), "many/1/f.txt")]))
    assert [f for p in one.partitions() for f in p.flat + p.deep] == ["many/1"]


def test_as_a_table(spark, project):
    files = project_files(spark, project, 5)
    rows = {r.path: r["size"] for r in files.collect()}
    assert set(rows) == left_in(False) and rows["a.py"] == 4
    assert files.rdd.getNumPartitions() <= 5
    spark.conf.set(PUSHDOWN, "true")
    try:
        under = project_files(spark, project).filter(F.col("path").startswith("many/"))
        assert sorted(r.path for r in under.collect()) == ["many/0/f.txt", "many/1/f.txt", "many/2/f.txt"]
    finally:
        spark.conf.unset(PUSHDOWN)
    empty = project / "empty"
    empty.mkdir()
    assert project_files(spark, empty).count() == 0
