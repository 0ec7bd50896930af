"""Listing a file tree, and reading listed files.

Spark's readers leave out some files of a tree: names that start with ``_`` or
``.`` count as bookkeeping, and files of no bytes are skipped. Source trees are
full of them (``__init__.py``), so trees are listed and such files are read here,
in tasks, by a small helper over Arrow's file systems.
"""

from __future__ import annotations

import io
import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from flawsieve.functions.paths import glob_regex
from flawsieve.functions.text import quoted
from flawsieve.sources.folders import shared_folder

# The folders that a task opens in one round; it leaves the others for the next.
FOLDERS_PER_TASK = 256
TASKS_PER_CORE = 4

# The bytes of a file that one task reads line by line, and those of a batch.
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 16 << 20

# Why a file or folder could not be read.
VANISHED, DENIED, SHORT, GROWN, UNREADABLE = "vanished", "denied", "short read", "grown", "unreadable"


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark understands it: absolute, and with its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def plain_root(root: str) -> str:
    """A qualified root without file system and final slash."""
    return re.sub(r"\A[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "", root).rstrip("/")


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified root, and the name of the root in it."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), plain_root(root) or "/"
    system, base = fs.FileSystem.from_uri(re.sub(r"\As3[an]:", "s3:", root))
    return system, base.rstrip("/")


def reason_of(error: OSError) -> str:
    if isinstance(error, FileNotFoundError):
        return VANISHED
    return DENIED if isinstance(error, PermissionError) else UNREADABLE


def _prunes(exclude: Iterable[str]):
    """Tells of a folder whether nothing below it can be in scope."""
    # A name no glob speaks of stands for all that lies below: where a glob takes
    # it, whatever it is, and however deep it goes on, the folder need not be opened.
    globs = [re.compile(glob_regex(g).removesuffix(r"\z"), re.S).fullmatch for g in exclude if g.endswith("/**")]

    def prunes(folder: str) -> bool:
        name = folder.rpartition("/")[2]
        return name == "node_modules" or any(g(f"{folder}/\ufffe") for g in globs)

    return prunes


FILE, FOLDER, PROBLEM = "file", "folder", "problem"
_FOUND = "relative string, length bigint, modified timestamp, kind string, reason string"


def _opened(frontier: DataFrame, root: str, exclude: Iterable[str] | None) -> DataFrame:
    """One round: what lies in the folders of ``frontier (relative)`` and, as far as a task gets, below them."""
    most = FOLDERS_PER_TASK
    prunes = _prunes(exclude) if exclude is not None else lambda folder: False

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        above = len(base.rstrip("/")) + 1
        pending, opened, found = deque(), 0, []

        def rows() -> pd.DataFrame:
            return pd.DataFrame(found, columns=["relative", "length", "modified", "kind", "reason"])

        for batch in batches:
            pending.extend(batch["relative"])
        while pending and opened < most:
            folder = pending.popleft()
            opened += 1
            try:
                children = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))
            except OSError as error:
                found.append((folder, None, None, PROBLEM, reason_of(error)))
                continue
            for child in children:
                relative = child.path[above:]
                if child.type == fs.FileType.File:
                    found.append((relative, child.size, child.mtime, FILE, None))
                elif child.type == fs.FileType.Directory and not prunes(relative):
                    pending.append(relative)
                if len(found) >= 1 << 14:
                    yield rows()
                    found = []
        found += [(folder, None, None, FOLDER, None) for folder in pending]
        if found:
            yield rows()

    return frontier.mapInPandas(walk, _FOUND)


def walk_tree(spark: SparkSession, root: str, exclude: Iterable[str] | None = None) -> DataFrame:
    """``path, length, modified, relative, kind, reason`` of all that was found below ``root``.

    ``kind`` tells files from folders that could not be opened. The tree is
    walked in rounds: a table of folders is dealt out to tasks, each opens a
    bounded number of folders and puts the others it met into the next round's
    table. The driver sees the number of folders left, and no name. With
    ``exclude``, folders in which nothing can be in scope stay closed.
    """
    root = qualified(spark, root)
    exclude = tuple(exclude) if exclude is not None else None
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    cores = spark.sparkContext.defaultParallelism
    frontier, left, n = spark.createDataFrame([("",)], "relative string").coalesce(1), 1, 0
    while left:
        written = f"{folder}/round={n}"
        _opened(frontier, root, exclude).write.parquet(written)
        met = spark.read.schema(_FOUND).parquet(written).filter(f"kind = '{FOLDER}'").select("relative")
        left, n = met.count(), n + 1
        frontier = met.repartition(min(left, TASKS_PER_CORE * cores) or 1, "relative")
    found = spark.read.schema(f"{_FOUND}, round int").parquet(folder).filter(f"kind <> '{FOLDER}'")
    path = f"concat({quoted(plain_root(root) + '/')}, relative) AS path"
    return found.selectExpr(path, "length", "modified", "relative", "kind", "reason")


def list_tree(spark: SparkSession, root: str, exclude: Iterable[str] | None = None) -> DataFrame:
    """``path, length, relative`` of every file below ``root``, hidden ones too (see ``walk_tree``)."""
    return walk_tree(spark, root, exclude).filter(f"kind = '{FILE}'").select("path", "length", "relative")


def read_with_reasons(listing: DataFrame, root: str) -> DataFrame:
    """``path, content, reason`` of the files of a listing (``path, relative, length``) of ``root``.

    In one pass: a file that was read has its content, one that was not has a
    reason. One that ended before its listed length was cut off while it was read or
    listed, and one that goes on is still being written; neither counts as read.
    The files are spread by path, for a listing task may have found many.
    """
    root = qualified(listing.sparkSession, root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        rows, size = [], 0
        for batch in batches:
            for path, relative, length in zip(batch["path"], batch["relative"], batch["length"]):
                content, reason = None, None
                try:
                    with system.open_input_stream(f"{base}/{relative}") as stream:
                        content = stream.read()
                except OSError as error:
                    reason = reason_of(error)
                else:
                    if len(content) != length:
                        content, reason = None, SHORT if len(content) < length else GROWN
                rows.append((path, content, reason))
                size += len(content or b"")
                if size > BATCH_BYTES or len(rows) == 4096:
                    yield pd.DataFrame(rows, columns=["path", "content", "reason"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content", "reason"])

    listed = listing.select("path", "relative", "length").repartition("path")
    return listed.mapInPandas(read, "path string, content binary, reason string")


def read_listed(listing: DataFrame, root: str) -> DataFrame:
    """``path, content`` of the files of a listing of ``root``; those that cannot be read are left out,
    as Spark's readers are told to do."""
    return read_with_reasons(listing, root).filter("reason IS NULL").drop("reason")


def read_listed_lines(listing: DataFrame, root: str) -> DataFrame:
    """``raw, _file, _size, _block``: the lines of the files of a listing.

    Files are read as ranges of ``SPLIT_BYTES``, each by a task: a line belongs
    to the range in which it begins.  As with Spark's reader, a byte order mark
    and the empty line after a final line feed do not show.  Of a range that
    cannot be read to its end nothing is given beyond the error, which the size
    of its file then tells.
    """
    root = qualified(listing.sparkSession, root)
    ranges = listing.selectExpr(
        "path", "relative", "length", f"explode(sequence(0L, greatest(length - 1, 0L), {SPLIT_BYTES}L)) AS start"
    ).repartition("path", "start")
    width = SPLIT_BYTES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)

        def lines_from(relative: str, start: int) -> Iterator[bytes]:
            with io.BufferedReader(system.open_input_file(f"{base}/{relative}"), 1 << 20) as stream:
                if start:  # what began before this range is of an earlier one
                    stream.seek(start - 1)
                    stream.readline()
                at = stream.tell()
                while at < start + width and (line := stream.readline()):
                    yield line.removeprefix(b"\xef\xbb\xbf" if at == 0 else b"").removesuffix(b"\n")
                    at += len(line)

        for batch in batches:
            for path, relative, length, start in batch[["path", "relative", "length", "start"]].itertuples(index=False):
                found, size = [], 0

                def rows() -> pd.DataFrame:
                    return pd.DataFrame({"_raw": found, "_path": path, "_size": length, "_block": start})

                try:
                    for line in lines_from(relative, start):
                        found.append(line)
                        size += len(line)
                        if size > BATCH_BYTES or len(found) == 1 << 16:
                            yield rows()
                            found, size = [], 0
                except OSError:
                    pass
                if found:
                    yield rows()

    lines = ranges.mapInPandas(read, "_raw binary, _path string, _size bigint, _block bigint")
    # The path as part of a URI, as Spark's reader gives it.
    return lines.selectExpr("CAST(_raw AS STRING) AS raw", "replace(_path, '%', '%25') AS _file", "_size", "_block")
