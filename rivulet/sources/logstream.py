"""Files of log text as a stream: a Python data source with offsets (file, position), one scan window to a run.

An offset is a place between two lines: a file's name and a byte position in it. What a run reads goes from where the last
one ended to the end of its scan window: at most so many files and so many bytes on, moved forward to the end of a line.
The stream's checkpoint holds the offsets, so a run that starts again reads on without a gap or a repeat. Since Spark asks
for the next offset before it tells the last one, the reader also notes each range that it is given in `progress`, a
small file in a folder of the run's choice.

Files are ordered by the number at the end of their name (without .txt or .log), then by name; they may grow at the end,
and new ones may come. Ranges are cut into parts of `part_bytes`, which tasks read side by side; a line belongs to the part
in which it begins. Paths are URIs of any file system that pyarrow knows, or local ones that all workers see.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, position long, line string"
_BUFFER = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _number(name: str) -> int:
    found = re.search(r"\.([0-9]+)$", re.sub(r"\.(txt|log)$", "", name))
    return int(found[1]) if found else -1


def files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the log files under a path, in order."""
    system, root = _opened(path)
    there = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and not i.base_name.startswith((".", "_"))]
    return sorted(there, key=lambda f: (_number(f[0]), f[0]))


def _line_end(stream: pa.NativeFile, at: int, size: int) -> int:
    """The place after the first line feed from at on; the file's size if there is none."""
    stream.seek(at)
    while at < size and (block := stream.read(min(_BUFFER, size - at))):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return size


def window_end(path: str, start: tuple[str, int], max_files: int, max_bytes: int) -> tuple[str, int]:
    """Where a scan window that begins at start ends: after whole lines, at most max_files and max_bytes on (a line that is
    longer is read whole). A last line without a line feed waits until it has one, unless a later file is there."""
    there = files(path)
    order = {name: i for i, (name, _) in enumerate(there)}
    if not there:
        return start
    first = order.get(start[0], 0)
    file, at, left = there[first][0], start[1] if start[0] in order else 0, max_bytes
    if at >= there[first][1] and first + 1 < len(there):  # that file is done
        first += 1
    system, root = _opened(path)
    for i in range(first, min(len(there), first + max(1, max_files))):
        name, size = there[i]
        begin = at if name == file else 0
        with system.open_input_file(f"{root}/{name}") as stream:
            if size - begin > left:
                return name, _line_end(stream, begin + max(1, left) - 1, size)
            if i == len(there) - 1 and size > begin:
                size = _last_line_end(stream, begin, size)
        left -= size - begin
        file, at = name, size
    return file, at


def _last_line_end(stream: pa.NativeFile, begin: int, size: int) -> int:
    """The place after the last line feed between begin and size; begin if there is none."""
    at = size
    while at > begin:
        low = max(begin, at - _BUFFER)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return begin


def noted(progress: str) -> tuple[str, int] | None:
    """The end of the last range that was given to a reader."""
    system, path = _opened(progress)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        at = json.loads(f.read())
    return at["file"], at["position"]


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int, whole: int):
        self.file, self.start, self.end, self.whole = file, start, end, whole


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.progress = options["path"].rstrip("/"), options.get("progress")
        self.max_files, self.max_bytes = int(options.get("max_files", 1 << 30)), int(options.get("max_bytes", 1 << 62))
        self.part_bytes = int(options.get("part_bytes", 8 << 20))

    def initialOffset(self) -> dict:
        return {"file": "", "position": 0}

    def latestOffset(self) -> dict:
        start = (self.progress and noted(self.progress)) or ("", 0)
        file, position = window_end(self.path, start, self.max_files, self.max_bytes)
        return {"file": file, "position": position}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if self.progress:
            system, path = _opened(self.progress)
            with system.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())
        there = files(self.path)
        order = {name: i for i, (name, _) in enumerate(there)}
        if end["file"] not in order:
            return []
        out = []
        for name, size in there[order.get(start["file"], 0) : order[end["file"]] + 1]:
            low = start["position"] if name == start["file"] else 0
            high = end["position"] if name == end["file"] else size
            out += [Part(name, a, min(a + self.part_bytes, high), high) for a in range(low, high, self.part_bytes)]
        return out

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        system, root = _opened(self.path)
        with system.open_input_file(f"{root}/{partition.file}") as raw:
            at = partition.start
            if at:  # begin after the line that the part before has begun
                at = _line_end(raw, at - 1, partition.whole)
            raw.seek(at)
            rest = b""
            while at < partition.end:
                more = raw.read(min(_BUFFER, partition.whole - raw.tell()))
                rest, begin = rest + more, 0
                while at < partition.end and begin < len(rest):
                    cut = rest.find(b"\n", begin)
                    if cut < 0:
                        if more:  # the line may go on in the next block
                            break
                        cut = len(rest)
                    yield partition.file, at, rest[begin:cut].decode("utf-8", "replace").removesuffix("\r")
                    at, begin = at + cut + 1 - begin, cut + 1
                rest = rest[begin:]
                if not more:
                    return


class LogSource(DataSource):
    """format("rivulet_log"), options path, progress, max_files, max_bytes, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "rivulet_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))
