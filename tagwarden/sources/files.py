"""Plain files: numbered lines, tails, listings and named log files.

* ``numbered_lines`` - text files of any size, split over many tasks, with every line's place in its file.
* format ``file_listing`` - path, name, modification time and length of files; no content is read.
* format ``file_tail`` - the last lines of each file, read backwards from its end.
* format ``log_files`` - a sink that writes rows as files of given names, moved into place on commit.

The formats are Python data sources; they open files through ``pyarrow.fs``, so paths may be
local, mounted or in a store that it knows. Workers need this package on their path.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from tagwarden.plans.broadcast import broadcast_if_small
from tagwarden.sources.tables import warehouse_location

BLOCK = 1 << 16  # bytes read at a time from a file's end


# --------------------------------------------------------------------------- line numbers
def numbered_lines(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """``(value, file, pos)``: every line of the text files at ``path`` with its place in its file, from 0.

    Two passes, so that a file of any size is read by many tasks. The first writes the lines to
    ``folder`` (by default a new one in the warehouse) with the split they came from and their order of reading; then the lines of each
    split are counted, the counts of a file's earlier splits are summed, and the sum moves the numbers within the
    split. The written copy fixes the splits: a task that runs again, or executors that come and
    go between the passes, change nothing. Lines end at ``\\n`` only.
    """
    folder = folder or f"{warehouse_location(spark, 'numbered')}-{uuid.uuid4().hex}"
    raw = spark.read.option("lineSep", "\n").text(path)
    raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
               F.monotonically_increasing_id().alias("row")).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    splits.select("file", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")) \
        .write.parquet(f"{folder}/splits")
    shifts = broadcast_if_small(spark.read.parquet(f"{folder}/splits"))  # one row a split
    return lines.join(shifts, ["file", "split"]).select("value", "file", (F.col("row") + F.col("shift")).alias("pos"))


# --------------------------------------------------------------------------- listings
def open_store(path: str):
    """``(file system, path in it)``; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _scheme(path: str, at: str) -> str:
    """What ``open_store`` took off the front of ``path``."""
    path = path.rstrip("/")
    return path[:len(path) - len(at.rstrip("/"))]


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all folders below it; else its own files only


class ListingSource(DataSource):
    """``spark.read.format("file_listing").load(path)`` -> ``(path, name, modified, bytes)`` of every file below ``path``.

    Empty files count; no file is opened. The driver opens folders, from the top, only until there are ``folders`` (64) of
    them; each is then listed by a task.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, name string, modified timestamp, bytes long"

    def reader(self, schema) -> "ListingReader":
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.folders = options["path"], int(options.get("folders", 64))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, at = open_store(self.path)
        if store.get_file_info(at).type != fs.FileType.Directory:
            raise NotADirectoryError(self.path)
        opened, todo = [], [at]
        while todo and len(opened) + len(todo) < self.folders:
            folder = todo.pop(0)
            opened.append(Folder(folder, False))
            todo += [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.Directory]
        return opened + [Folder(f, True) for f in todo]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = open_store(self.path)
        scheme = _scheme(self.path, at)
        found = [f for f in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)) if f.is_file]
        for lo in range(0, len(found), 10_000):
            part = found[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([scheme + f.path for f in part]), pa.array([f.base_name for f in part]),
                 pa.array([f.mtime_ns // 1000 for f in part], pa.int64()).cast(pa.timestamp("us", "UTC")),
                 pa.array([f.size for f in part], pa.int64())], names=["path", "name", "modified", "bytes"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, modified, bytes)`` of the files below ``path``, by folder in parallel, without opening a file."""
    register(spark)
    return spark.read.format("file_listing").load(path)


def delete_files(files: DataFrame) -> DataFrame:
    """Deletes the files of ``files (path)`` when the result is read: ``(path, deleted)``; a file that is gone already is not an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, done = b.column("path").to_pylist(), []
            for p in paths:
                store, at = open_store(p)
                try:
                    store.delete_file(at)
                    done.append(True)
                except FileNotFoundError:
                    done.append(False)
            yield pa.RecordBatch.from_pydict({"path": paths, "deleted": done})

    return files.select("path").mapInArrow(run, "path string, deleted boolean")


# --------------------------------------------------------------------------- tails
def last_lines(file, size: int, n: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """The last ``n`` lines of an open file of ``size`` bytes and how many bytes were read to find them.

    Blocks are read backwards until they hold ``n`` line breaks beside a closing one.
    """
    blocks: list[bytes] = []
    breaks, at = 0, size
    while at > 0 and n > 0:
        step = min(block, at)
        at -= step
        file.seek(at)
        part = file.read(step)
        breaks += part.count(b"\n") - (not blocks and part.endswith(b"\n"))
        blocks.append(part)
        if breaks >= n:
            break
    data = b"".join(reversed(blocks))
    lines = data.removesuffix(b"\n").split(b"\n") if data else []
    return (lines[-n:] if n > 0 else []), size - at


@dataclass
class Files(InputPartition):
    paths: list[str]


class TailSource(DataSource):
    """``spark.read.format("file_tail").option("lines", 30).load(path)`` -> ``(file, rn, value)``: rn 1 is a file's last line.

    ``path`` is a folder (with its folders) or a file; names that begin with ``_`` or ``.`` are not data. Bytes that are no
    UTF-8 become the replacement character. Up to ``tasks`` (256) files have a task each; more are dealt evenly.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tail"

    def schema(self) -> str:
        return "file string, rn int, value string"

    def reader(self, schema) -> "TailReader":
        return TailReader(self.options)


class TailReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.lines, self.block = options["path"], int(options.get("lines", 30)), int(options.get("block", BLOCK))
        self.tasks = int(options.get("tasks", 256))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = open_store(self.path)
        base = _scheme(self.path, at)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        paths = [base + f.path for f in found if f.is_file and f.base_name[:1] not in ("_", ".")]
        return [Files(paths[i::self.tasks]) for i in range(min(self.tasks, len(paths)))] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            store, at = open_store(path)
            with store.open_input_file(at) as f:
                lines, _ = last_lines(f, f.size(), self.lines, self.block)
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines)), pa.array(range(len(lines), 0, -1), pa.int32()),
                     pa.array([x.decode("utf-8", "replace") for x in lines])], names=["file", "rn", "value"])


# --------------------------------------------------------------------------- named files
@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary, final)


class LogSink(DataSource):
    """Rows ``(name, value, modified)`` become the lines of files of those names in the folder ``path``.

    Rows of one name must come to one task, together (``operators.logs.write_logs`` sees to that). A task writes under a
    temporary name; files move into place only when all tasks have succeeded, so a task that runs again or a failed job
    leaves nothing there. On a local or mounted file system a file gets its last row's ``modified`` as its time.
    """

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def writer(self, schema, overwrite: bool) -> "LogWriter":
        return LogWriter(self.options["path"])


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, base = open_store(self.path)
        temporary = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        out = name = modified = None

        def close() -> None:
            if out is not None:
                out.close()
                if modified is not None and isinstance(store, fs.LocalFileSystem):
                    os.utime(files[-1][0], (modified, modified))

        for b in batches:
            if not b.num_rows:
                continue
            names, values = b.column("name"), b.column("value")
            times = b.column("modified").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            for n, v, t in zip(names.to_pylist(), values.to_pylist(), times):
                if n != name:
                    close()
                    if not files:
                        store.create_dir(temporary, recursive=True)
                    name = n
                    files.append((f"{temporary}/{n}", f"{base}/{n}"))
                    out = store.open_output_stream(files[-1][0])
                out.write((v or "").encode() + b"\n")
                modified = None if t is None else t / 1_000_000
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = open_store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        store.create_dir(base, recursive=True)
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one file name came to several tasks")
        for temporary, final in files:
            store.move(temporary, final)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, base = open_store(self.path)
        try:
            store.delete_dir(f"{base}/_temporary-{self.job}")
        except FileNotFoundError:
            pass


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.dataSource.register(ListingSource)
    spark.dataSource.register(TailSource)
    spark.dataSource.register(LogSink)
