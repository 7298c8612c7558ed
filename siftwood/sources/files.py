"""Project files as a data source: folders are its partitions, and the tasks list them.

The driver opens folders, level by level, only until there are enough to hand out; names of
files, their status and what version control says of them stay with the tasks.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import stat
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from siftwood.operators.workers import ship_package

from .ignore import IgnoreTree

#: Folders that are never entered where no repository tells what is in it.
HIDDEN = r"(^|/)(\.[^/]*|node_modules)"
_HIDDEN = re.compile(HIDDEN + "$")
#: Partitions, unless the option of this name says otherwise, and folders that one call of git is asked for.
PARTITIONS, ASKED = 64, 100
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Folders(InputPartition):
    """Folders ('' is the top): of some the own files only, of others all below; and the ignore files above them."""

    flat: list[str]
    deep: list[str]
    rules: IgnoreTree


def opened(root: str, here: str, rules: IgnoreTree) -> tuple[list[str], list[str]]:
    """Files and folders in a folder that no ignore file names, outside dot folders and node_modules; its own ignore file is added to the rules."""
    with os.scandir(os.path.join(root, here)) as entries:
        inside = {f"{here}/{e.name}".lstrip("/"): e.is_dir(follow_symlinks=False) for e in entries}
    if (own := f"{here}/.gitignore".lstrip("/")) in inside and not inside[own]:
        rules.add(here, Path(root, own).read_text(errors="replace"))
    kept = [path for path, is_folder in inside.items() if not rules.ignores(path, is_folder)]
    return [p for p in kept if not inside[p]], [p for p in kept if inside[p] and not _HIDDEN.search(p)]


def walked(root: str, part: Folders) -> Iterator[str]:
    for here in part.flat:
        with contextlib.suppress(FileNotFoundError):
            yield from opened(root, here, part.rules)[0]
    stack = list(part.deep)
    while stack:
        with contextlib.suppress(FileNotFoundError):
            files, folders = opened(root, stack.pop(), part.rules)
            yield from files
            stack += folders


def has_repository(root: str) -> bool:
    asked = shutil.which("git") and subprocess.run(["git", "-C", root, "ls-files", "-z", "--", ":(literal).git"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    return bool(asked) and asked.returncode == 0


def tracked(root: str, part: Folders) -> Iterator[str]:
    """What the repository tracks in the folders, and what is new and not ignored."""
    quoted = lambda folder: re.sub(r"([*?\[\\])", r"\\\1", folder)
    specs = [f":(glob){quoted(f)}/*" if f else ":(glob)*" for f in part.flat] + [f":(literal){f}" if f else "." for f in part.deep]
    for i in range(0, len(specs), ASKED):
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "-co", "--exclude-standard", "--", *specs[i : i + ASKED]], stdout=subprocess.PIPE, stderr=subprocess.PIPE, check=True).stdout
        yield from {name for name in out.decode(errors="replace").split("\0") if name}


class FilesReader(DataSourceReader):
    def __init__(self, root: str, count: int):
        self.root, self.count, self.by_git = root, count, has_repository(root)
        self.prefixes: list[str] = []  # every path begins with each of them

    def wanted(self, folder: str, deep: bool) -> bool:
        """Whether a path with the prefixes may lie in a folder, or, if deep, below it."""
        top = f"{folder}/" if folder else ""
        return all(top.startswith(p) if len(p) <= len(top) else p.startswith(top) and (deep or "/" not in p[len(top) :]) for p in self.prefixes)

    def inside(self, folder: str, rules: IgnoreTree) -> list[str]:
        if not self.by_git:
            return opened(self.root, folder, rules)[1]
        with os.scandir(os.path.join(self.root, folder)) as entries:
            return [f"{folder}/{e.name}".lstrip("/") for e in entries if e.is_dir(follow_symlinks=False) and e.name != ".git"]

    def partitions(self) -> list[Folders]:
        rules, flat, level = IgnoreTree(), [], [""]
        while level and len(flat) + len(level) < self.count:
            below = []
            for folder in level:
                with contextlib.suppress(OSError):
                    below += [f for f in self.inside(folder, rules) if self.wanted(f, True)]
            flat += level
            level = below
        flat = [f for f in flat if self.wanted(f, False)]
        parts = [Folders(flat[i :: self.count], level[i :: self.count], rules) for i in range(self.count)]
        return [p for p in parts if p.flat or p.deep] or [Folders([], [], rules)]

    def read(self, partition: Folders) -> Iterator[tuple[str, float, int]]:
        for name in (tracked if self.by_git else walked)(self.root, partition):
            with contextlib.suppress(OSError):  # what has vanished meanwhile is left out
                status = os.lstat(os.path.join(self.root, name))
                if stat.S_ISREG(status.st_mode):
                    yield name, status.st_mtime, status.st_size


class PrunedFilesReader(FilesReader):
    """For sessions that push filters to Python sources: folders that no path asked for can lie in aren't opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            yield f  # Spark tests the paths themselves


class ProjectFiles(DataSource):
    """Options: path, the top folder, which all executors see; partitions; pushdown, whether the session pushes filters."""

    @classmethod
    def name(cls) -> str:
        return "siftwood_files"

    def schema(self) -> str:
        return "path string, mtime double, size long"

    def reader(self, schema) -> DataSourceReader:
        kind = PrunedFilesReader if self.options.get("pushdown") == "true" else FilesReader
        return kind(self.options["path"], max(1, int(self.options.get("partitions", PARTITIONS))))


def project_files(spark: SparkSession, root: str | Path, partitions: int = PARTITIONS) -> DataFrame:
    """(path, mtime, size) of the regular files below root that version control or the ignore files leave in."""
    ship_package(spark)
    spark.dataSource.register(ProjectFiles)
    asked = {"path": str(Path(root).resolve()), "partitions": str(partitions), "pushdown": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    return spark.read.format(ProjectFiles.name()).options(**asked).load()
