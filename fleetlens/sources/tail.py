"""A streaming source of lines that are appended to files: every line once and in order, over restarts and rotation.

Each batch takes at most a number of rows; what exceeds it waits. The driver looks at sizes and finds how far a batch
goes, which opens no more bytes than the batch has; executors read the ranges. A file is known by what the file system
calls it (device and inode where there are any, else its path), so one that is renamed goes on where it was, and one
that got shorter, as after copying and truncation, begins anew. The last line of a file waits for its end of line.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "host string, path string, seq long, value string"
#: Rows of a batch, and bytes after which a line without an end is taken as it is.
ROWS, LONGEST = 1000, 1 << 20
#: Bytes of a task: ranges of files are read together up to it, so a batch of a few lines from many files is one task, and one file.
TASK_BYTES = 4 << 20
_BLOCK = 1 << 16


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def _found(folder: str) -> dict[str, tuple[str, int]]:
    """Path and size of the files below a folder, by identity."""
    system, base = _opened(folder)
    out = {}
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        if f.is_file and not f.base_name.startswith((".", "_")):
            out[_identity(system, f.path)] = (f.path, f.size)
    return out


def _identity(system: fs.FileSystem, path: str) -> str:
    if isinstance(system, fs.LocalFileSystem):
        try:
            s = os.stat(path)
        except OSError:
            return path
        return f"{s.st_dev}:{s.st_ino}"
    return path


def lines_from(stream: pa.NativeFile, at: int, upto: int | None = None, longest: int = LONGEST) -> Iterator[tuple[bytes, int]]:
    """Whole lines from a place on, each with the place behind it."""
    stream.seek(at)
    kept, ended = b"", False
    while not ended:
        block = stream.read(_BLOCK if upto is None else min(_BLOCK, upto - at - len(kept)))
        ended = not block
        kept += block
        begin = 0
        while True:
            end = kept.find(b"\n", begin)
            if end < 0 and len(kept) - begin < longest:
                break
            stop = begin + longest if end < 0 or end - begin > longest else end + 1
            yield kept[begin:stop], at + stop
            begin = stop
        at, kept = at + begin, kept[begin:]


class _Range:
    def __init__(self, path: str, identity: str, begin: int, end: int, seq: int) -> None:
        self.path, self.identity, self.begin, self.end, self.seq = path, identity, begin, end, seq


class _Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[_Range]) -> None:
        self.ranges = ranges


def _together(ranges: list[_Range]) -> list[_Ranges]:
    out, size = [], TASK_BYTES
    for r in ranges:
        if size + r.end - r.begin > TASK_BYTES:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.end - r.begin
    return [_Ranges(x) for x in out]


class GrowingLinesReader(DataSourceStreamReader):
    """An offset is self-contained: seq of the next line, and for each file its path, the range of the last batch and its first seq."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.rows, self.longest = int(options.get("rows", ROWS)), int(options.get("longest", LONGEST))
        self.start, self.state = options.get("start", "end"), options["state"]
        self.end: dict[str, Any] | None = None

    def initialOffset(self) -> dict:
        """Files that are there already begin at their end, or at their beginning if so asked for; later ones at their beginning.

        Spark asks a new query for its latest offset first, so what counts is what the state says.
        """
        return self._last()

    def _planned(self, end: dict[str, Any]) -> None:
        """Remembers where the last batch that was planned ends: Spark does not tell a source that after a restart."""
        self.end = end
        system, base = _opened(self.state)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/.position") as f:
            f.write(json.dumps(end).encode())
        system.move(f"{base}/.position", f"{base}/position")

    def _last(self) -> dict[str, Any]:
        if self.end is None:
            system, base = _opened(self.state)
            if system.get_file_info(f"{base}/position").is_file:
                with system.open_input_stream(f"{base}/position") as f:
                    self.end = json.loads(f.read())
            else:
                at = lambda size: 0 if self.start == "beginning" else size
                self._planned({"seq": 0, "files": {k: [path, at(size), at(size), 0] for k, (path, size) in _found(self.folder).items()}})
        return self.end

    def latestOffset(self) -> dict:
        last = self._last()
        system, _ = _opened(self.folder)
        files = {}
        for k, (path, size) in sorted(_found(self.folder).items(), key=lambda x: x[1][0]):
            at = last["files"].get(k, [path, 0, 0, 0])[2]
            files[k] = [path, at if size >= at else 0, size]
        behind = [k for k, (_, at, size) in files.items() if size > at]
        left, seq, taken = self.rows, last["seq"], {k: [path, at, at, 0] for k, (path, at, _) in files.items()}
        # every file its share at first, then what is left in order of the paths
        for share in (max(1, self.rows // max(len(behind), 1)), self.rows):
            for k in behind:
                if left <= 0:
                    break
                path, begin, end, n = taken[k]
                with system.open_input_file(path) as f:
                    for _, end in lines_from(f, end, longest=self.longest):
                        n, left = n + 1, left - 1
                        taken[k][2:] = [end, n]
                        if left <= 0 or n >= share:
                            break
        out = {}
        for k, (path, begin, end, n) in taken.items():
            out[k] = [path, begin, end, seq]
            seq += n
        if seq == last["seq"]:
            # nothing new: the same offset, so that Spark plans no batch
            return last
        return {"seq": seq, "files": out}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._planned(end)
        return _together([_Range(path, k, begin, to, seq) for k, (path, begin, to, seq) in end["files"].items() if to > begin]) if end["seq"] > start["seq"] else []

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self._read(r)

    def _read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        path = partition.path
        if isinstance(system, fs.LocalFileSystem) and _identity(system, path) != partition.identity:
            # it was renamed after the batch was planned
            path = _found(self.folder)[partition.identity][0]
        host = re.search(r"([^/]+)/[^/]+$", partition.path)
        seq, values = partition.seq, []

        def batch() -> pa.RecordBatch:
            n = len(values)
            return pa.record_batch({"host": pa.array([host[1] if host else ""] * n), "path": pa.array([partition.path] * n), "seq": pa.array(range(seq, seq + n), pa.int64()), "value": pa.array(values, pa.string())})

        with system.open_input_file(path) as f:
            for line, _ in lines_from(f, partition.begin, partition.end, self.longest):
                values.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                if len(values) == 10_000:
                    yield batch()
                    seq, values = seq + len(values), []
        if values:
            yield batch()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))


def growing_lines(spark: SparkSession, folder: str, state: str, rows: int = ROWS, start: str = "end") -> DataFrame:
    """host (the folder that a file is in), path, seq and value of lines as they are appended to files below `folder`.

    At most `rows` lines come in a batch. seq counts all lines of the source. `state` is a folder that belongs to the query's
    checkpoint. Files must be readable under one path from all executors, and stay until they are read.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("rows", rows).option("start", start).option("state", state).load(folder)


def grown(spark: SparkSession, source: str, folder: str, share: float = 1.0) -> None:
    """Lets copies of the files below `source` grow below `folder` up to a share of their bytes, each in a task, as something that still writes would.

    What is there stays, and what is missing comes to its end; a share mostly ends within a line. A task that runs again goes on.
    """
    system, base = _opened(source)
    files = [(path[len(base) + 1 :], int(size * share)) for path, size in _found(source).values()]

    def write(file: tuple[str, int]) -> None:
        (system, base), (to, there) = _opened(source), _opened(folder)
        name, upto = file
        to.create_dir(os.path.dirname(f"{there}/{name}"), recursive=True)
        at = to.get_file_info(f"{there}/{name}").size or 0
        with system.open_input_file(f"{base}/{name}") as f, (to.open_append_stream if at else to.open_output_stream)(f"{there}/{name}") as out:
            f.seek(at)
            while block := f.read(min(_BLOCK, max(0, upto - at))):
                at += out.write(block)

    spark.sparkContext.parallelize(files, max(1, len(files))).foreach(write)
