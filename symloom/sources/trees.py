"""File trees and git repositories as data sources of Spark, and a writer of trees.

``register(spark)`` makes three names known:

* ``spark.read.format("symloom_tree")``: the files below ``path`` (rel_path, size,
  modified, sha, text).  The driver lists folders and leaves out what the options rule
  out, whole folders first; files are dealt to partitions by folder, and only what is
  left is read, where its partition runs.
* ``spark.readStream.format("symloom_tree")``: the same rows as files arrive or are
  written again, in order of modification time.  An offset is the place of the last
  file in that order, so a batch that is run again takes the same files.
* ``spark.read.format("symloom_git")``: one row (repository, head_sha, log) for each
  folder of ``paths``; ``git log`` runs where the partition runs.  A folder that is no
  repository has no row.

Options of a tree: ``extensions`` (comma-separated, without regard to case; all if
not given), ``skip`` (``dots``: dot entries are left out; ``sources``: folders of built
and foreign code too; ``none``), ``below`` (the begin of the paths taken), ``min_bytes``
and ``max_bytes``, ``partition_files``.  A missing tree is empty.  These are options
and not pushed filters, as Spark 4.1 keeps a filter that a Python source has taken
over for later queries of the same DataFrame, which then lack rows.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from symloom.functions.paths import SKIPPED_FOLDERS
from symloom.sources.gitlog import COMMAND, parse_git_log

TREE = "rel_path string, size long, modified timestamp, sha string, text string"
GIT = "repository string, head_sha string, log string"
#: Files of a partition.
PARTITION_FILES = 500
#: Tasks of a core that read or write dealt files.
TASKS = 4
#: Listed files of a batch.
_LISTED = 10_000
#: Bytes of text in a batch.
_BATCH_BYTES = 4 << 20


@dataclass
class Files(InputPartition):
    """Files of one folder: (rel_path, size, modification time in ns)."""

    folder: str
    files: list[tuple[str, int, int]]

    def __init__(self, folder: str, files: list[tuple[str, int, int]]):
        super().__init__((folder, len(files)))
        self.folder, self.files = folder, files


@dataclass
class Rules:
    """What a listing takes."""

    extensions: tuple[str, ...] = ()
    skip: str = "dots"
    below: str = ""
    min_bytes: int = 0
    max_bytes: int | None = None

    def enters(self, folder: str) -> bool:
        """Whether a folder (told with a final slash) can hold a file that is taken."""
        name = folder.rstrip("/").rpartition("/")[2]
        if self.skip != "none" and name.startswith(".") or self.skip == "sources" and name in SKIPPED_FOLDERS:
            return False
        return folder.startswith(self.below) or self.below.startswith(folder)

    def takes(self, path: str, size: int) -> bool:
        name = path.rpartition("/")[2]
        if self.skip != "none" and name.startswith(".") or self.extensions and not name.lower().endswith(self.extensions):
            return False
        return path.startswith(self.below) and size >= self.min_bytes and (self.max_bytes is None or size <= self.max_bytes)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path or URI as a file system and the path in it."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner.rstrip("/")


def make_folder(path: str) -> None:
    """A folder (a path or URI) with those above it."""
    system, top = located(path)
    system.create_dir(top, recursive=True)


def listed(path: str, rules: Rules) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(folder, its files) of a tree; a folder that the rules leave out is not listed."""
    system, top = located(path)
    waiting = [""]
    while waiting:
        folder = waiting.pop()
        files = []
        for entry in system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
            below = folder + entry.base_name
            if entry.type == fs.FileType.Directory:
                if rules.enters(below + "/"):
                    waiting.append(below + "/")
            elif entry.type == fs.FileType.File and rules.takes(below, entry.size):
                files.append((below, entry.size, entry.mtime_ns))
        if files:
            yield folder, sorted(files)


def _rows(path: str, files: Sequence[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    system, top = located(path)
    rows, held = [], 0
    for below, size, modified in files:
        with system.open_input_file(f"{top}/{below}") as stream:
            content = stream.read()
        rows.append((below, len(content), datetime.fromtimestamp(modified / 1e9, timezone.utc), sha256(content).hexdigest(), content.decode("utf-8", "replace")))
        held += len(content)
        if held > _BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string())
    names = [f.split()[0] for f in TREE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class TreeReader(DataSourceReader):
    def __init__(self, path: str, rules: Rules, partition_files: int):
        self.path, self.rules, self.partition_files = path, rules, partition_files

    def partitions(self) -> list[Files]:
        found = [Files(folder, files[i : i + self.partition_files]) for folder, files in listed(self.path, self.rules) for i in range(0, len(files), self.partition_files)]
        return found or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition.files)


class TreeStream(DataSourceStreamReader):
    """Files by (modification time, path); a file that appears must not be older than those taken."""

    def __init__(self, path: str, rules: Rules, partition_files: int):
        self.path, self.rules, self.partition_files = path, rules, partition_files

    def _files(self) -> list[tuple[int, str, int]]:
        return sorted((modified, below, size) for _, files in listed(self.path, self.rules) for below, size, modified in files)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": "0", "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        return {"modified": str(files[-1][0]), "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((int(o["modified"]), o["path"]) for o in (start, end))
        new = [(below, size, modified) for modified, below, size in self._files() if after < (modified, below) <= upto]
        return [Files(str(i), new[i : i + self.partition_files]) for i in range(0, len(new), self.partition_files)] or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition.files)

    def commit(self, end: dict) -> None:
        return None


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symloom_tree"

    def schema(self) -> str:
        return TREE

    def _made(self, kind: type):
        path, skip = self.options.get("path"), self.options.get("skip", "dots")
        if not path:
            raise ValueError("path: a folder is needed")
        if skip not in ("dots", "sources", "none"):
            raise ValueError(f"skip: dots, sources or none, not {skip}")
        extensions = tuple(e.strip().lower() for e in self.options.get("extensions", "").split(",") if e.strip())
        most = self.options.get("max_bytes")
        rules = Rules(extensions, skip, self.options.get("below", ""), int(self.options.get("min_bytes", 0)), None if most is None else int(most))
        return kind(path, rules, int(self.options.get("partition_files", PARTITION_FILES)))

    def reader(self, schema) -> TreeReader:
        return self._made(TreeReader)

    def streamReader(self, schema) -> TreeStream:  # noqa: N802
        return self._made(TreeStream)


@dataclass
class Repository(InputPartition):
    folder: str

    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class GitReader(DataSourceReader):
    def __init__(self, folders: list[str], commits: int):
        self.folders, self.commits = folders, commits

    def partitions(self) -> list[Repository]:
        return [Repository(f) for f in self.folders] or [Repository("")]

    def read(self, partition: Repository) -> Iterator[tuple[str, str | None, str]]:
        def git(*words: str) -> str | None:
            try:
                run = subprocess.run(["git", "-C", partition.folder, *words], capture_output=True, check=False)
            except FileNotFoundError:  # no git here
                return None
            return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None

        if partition.folder and (git("rev-parse", "--is-inside-work-tree") or "").strip() == "true":
            head = (git("rev-parse", "HEAD") or "").strip()
            log = git("log", f"-{self.commits}", *COMMAND[3:]) if head else None
            yield partition.folder, head if len(head) == 40 else None, log or ""


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symloom_git"

    def schema(self) -> str:
        return GIT

    def reader(self, schema) -> GitReader:
        folders = json.loads(self.options.get("paths", "[]")) or [p for p in [self.options.get("path")] if p]
        return GitReader(folders, int(self.options.get("commits", COMMAND[2].removeprefix("-"))))


def register(spark: SparkSession) -> None:
    """Make the sources known."""
    for source in (TreeSource, GitSource):
        spark.dataSource.register(source)


def read_tree(spark: SparkSession, path: str, extensions: Sequence[str] = (), **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format("symloom_tree").option("extensions", ",".join(extensions)).options(**options).load(path)


def scan_tree(spark: SparkSession, path: str, extensions: Sequence[str] = (), skip: str = "dots") -> DataFrame:
    """The rows of ``read_tree``, listed in a task and not on the driver, and read by as many tasks as cores need, however small the files."""
    rules = Rules(tuple(e.lower() for e in extensions), skip)
    parts = TASKS * spark.sparkContext.defaultParallelism

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(batch.num_rows for batch in batches):
            for _, files in listed(path, rules):
                for i in range(0, len(files), _LISTED):
                    columns = zip(*files[i : i + _LISTED], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["rel_path", "size", "modified"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(path, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))

    found = spark.range(0, 1, 1, 1).mapInArrow(entries, "rel_path string, size long, modified long")
    return found.repartition(parts, "rel_path").mapInArrow(read, TREE)


def read_git(spark: SparkSession, folders: Sequence[str], commits: int = 500) -> tuple[DataFrame, DataFrame]:
    """Commits (sha, date, message, author_email, files) of repositories, and their heads (repository, head_sha)."""
    register(spark)
    logs = spark.read.format("symloom_git").option("paths", json.dumps(list(folders))).option("commits", commits).load()
    return parse_git_log(logs, "log"), logs.select("repository", "head_sha")


def write_tree(rows: DataFrame, root: str, path_col: str = "rel_path", text_col: str = "text") -> int:
    """Write each row's text to its own file below ``root``, where the row is; the number of files.

    A file is written under a name of its own and moved, so that a task that is run
    again replaces whole files by equal ones.  Rows are dealt by their paths, as a table
    of many small texts may be one partition.  Rows without a path or text, and paths that lead out of the tree, are errors.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = located(root)
        made = set()
        for batch in batches:
            n = 0
            for below, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if below is None or text is None or below.startswith("/") or ".." in below.split("/"):
                    raise ValueError(f"no file of a tree: {below}")
                folder = f"{top}/{below}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{sha256(below.encode()).hexdigest()[:16]}-{id(batch)}.draft"
                with system.open_output_stream(draft) as out:
                    out.write(text.encode())
                system.move(draft, f"{top}/{below}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    parts = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(F.col(path_col), F.col(text_col)).repartition(parts, path_col).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
