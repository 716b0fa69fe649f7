"""Directory listing as a Spark data source.

``spark.read.format("binaryFile")`` leaves out empty files and those whose
names begin with a dot or underscore, which a health scan must report; so the
listing is a source of its own, and content is read beside it.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleanery.config import should_exclude

FILES = "path string, relative_path string, size long, mtime timestamp, ctime timestamp, is_symlink boolean"
#: All that a walk finds: files, issues (permission, symlink_loop), and counts of each part's directories.
FOUND = f"kind string, {FILES}, total_dirs long, empty_dirs long, excluded long"
#: The driver looks at directories level by level until it has so many parts to deal out.
PARTS, LEVELS = 64, 4


@dataclass
class Walk:
    """What a walk found besides files; kinds of issues are permission and symlink_loop."""

    files: list[tuple] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)
    total_dirs: int = 0
    empty_dirs: int = 0
    excluded: int = 0


def _entry(root: str, path: str) -> tuple | None:
    """The row of one file; None for broken links and what is no regular file."""
    try:
        info = os.stat(path)
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(info.st_mode):
        return None
    when = lambda t: datetime.fromtimestamp(t, UTC).replace(tzinfo=None)
    return path, os.path.relpath(path, root).replace(os.sep, "/"), info.st_size, when(info.st_mtime), when(info.st_ctime), os.path.islink(path)


def _loops(link: str, folder: str, root: str, exclude: tuple[str, ...]) -> bool:
    """Whether a link to a directory leads to one above it, or to one that a walk in order of names enters before."""
    target, here, top = os.path.realpath(link), os.path.realpath(folder), os.path.realpath(root)
    inside = lambda path, of: path == of or path.startswith(of.rstrip(os.sep) + os.sep)
    if inside(here, target):
        return True
    if not inside(target, top):
        return False
    to, at = (os.path.relpath(x, top).split(os.sep) for x in (target, here))
    walked = not any(should_exclude("/".join(to[: k + 1]), exclude) for k in range(len(to)))
    return walked and to < ([] if at == ["."] else at)


def walk(root: str, exclude: tuple[str, ...] = (), top: str | None = None, deep: bool = True) -> Walk:
    """Walks ``root`` (or one of its directories, ``top``); directories are pruned before they are entered.

    Symbolic links to files are followed, those to directories only looked at
    for loops, which do not depend on what was walked before. A directory
    without files of its own counts as empty.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    out = Walk()

    def visit(path: str) -> None:
        try:
            with os.scandir(path) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            out.issues.append((path, "permission"))
            return
        out.total_dirs += path != root
        n_files = 0
        for e in entries:
            relative = os.path.relpath(e.path, root).replace(os.sep, "/")
            is_dir = e.is_dir(follow_symlinks=True)
            if should_exclude(relative, exclude):
                out.excluded += 1
                continue
            if is_dir and e.is_symlink():
                if _loops(e.path, path, root, exclude):
                    out.issues.append((e.path, "symlink_loop"))
            elif is_dir:
                if deep:
                    visit(e.path)
            else:
                try:
                    row = _entry(root, e.path)
                except OSError:
                    out.issues.append((e.path, "permission"))
                    continue
                if row:
                    n_files += 1
                    out.files.append(row)
        out.empty_dirs += n_files == 0

    visit(top or root)
    return out


class _Part(InputPartition):
    def __init__(self, top: str, deep: bool):
        self.top, self.deep = top, deep


class FileListReader(DataSourceReader):
    """Partitions for single directories near the root, and for whole ones below them."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.exclude = tuple(p for p in options.get("exclude", "").split("\n") if p)
        self.found = options.get("found") == "all"
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)

    def _below(self, path: str) -> list[str] | None:
        """The directories in one, as a walk enters them; None if it cannot be read (a part of its own then tells)."""
        try:
            with os.scandir(path) as found:
                below = [e.path for e in found if e.is_dir(follow_symlinks=False)]
        except OSError:
            return None
        return sorted(p for p in below if not should_exclude(os.path.relpath(p, self.root).replace(os.sep, "/"), self.exclude))

    def partitions(self) -> list[InputPartition]:
        single, whole = [], [self.root]
        for _ in range(LEVELS):
            if len(single) + len(whole) >= PARTS:
                break
            deeper: list[str] = []
            rest: list[str] = []
            for path in whole:
                below = self._below(path)
                if below is None:
                    rest.append(path)
                else:
                    single.append(path)
                    deeper += below
            if not deeper:
                whole = rest
                break
            whole = rest + deeper
        return [*[_Part(p, False) for p in single], *[_Part(p, True) for p in whole]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        w = walk(self.root, self.exclude, partition.top, partition.deep)
        if not self.found:
            yield from w.files
            return
        nothing = (None,) * 5
        yield from (("file", *f, None, None, None) for f in w.files)
        yield from ((kind, path, *nothing, None, None, None) for path, kind in w.issues)
        yield ("directories", None, *nothing, w.total_dirs, w.empty_dirs, w.excluded)


class FileList(DataSource):
    """``spark.read.format("filelist").option("exclude", "*.bin\\n.git").load(path)``; with option found=all also issues and counts."""

    @classmethod
    def name(cls) -> str:
        return "filelist"

    def schema(self) -> str:
        return FOUND if self.options.get("found") == "all" else FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FileListReader(self.options)


def _read(spark: SparkSession, path: str, exclude: tuple[str, ...], **options: str) -> DataFrame:
    spark.dataSource.register(FileList)
    return spark.read.format("filelist").options(exclude="\n".join(exclude), **options).load(path)


def list_files(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    return _read(spark, path, exclude)


def walk_all(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files, issues and counts of directories from one walk, by kind."""
    return _read(spark, path, exclude, found="all")


def walk_parts(walked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, issues (path, kind) and one row of statistics, of ``walk_all``."""
    names = [f.split(" ")[0] for f in FILES.split(", ")]
    files = walked.where("kind = 'file'").select(*names)
    issues = walked.where("kind in ('permission', 'symlink_loop')").select("path", "kind")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    stats = walked.agg(total("total_dirs"), total("empty_dirs"), total("excluded"), F.count_if(F.col("kind") == "file").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    return files, issues, stats
