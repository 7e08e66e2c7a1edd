"""Log files that grow, line by line, as a source for batches and streams.

An offset is the number of bytes of each file that have been read, always behind a line's end.  A stream that is
started again goes on from the offsets of its checkpoint; a line is given once it is complete.  Byte ranges are shared
out among tasks: a line belongs to the range in which it begins, and is read to its end by that task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, and bytes that are read at once.
RANGE, BLOCK = 32 << 20, 1 << 20
SCHEMA = "path string, at long, line string"


class _Range(InputPartition):
    """The lines of a file that begin at ``start`` or after it and before ``end``; ``base`` is known to be a line's beginning."""

    def __init__(self, path: str, base: int, start: int, end: int):
        self.path, self.base, self.start, self.end = path, base, start, end


def _files(root: str, suffix: str) -> tuple[pafs.FileSystem, dict[str, int]]:
    fs, at = pafs.FileSystem.from_uri(root)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)) if fs.get_file_info(at).type != pafs.FileType.File else [fs.get_file_info(at)]
    names = {f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))}
    return fs, dict(sorted(names.items()))


def complete(fs: pafs.FileSystem, path: str, size: int, block: int = BLOCK) -> int:
    """The bytes of a file up to its last line's end."""
    with fs.open_input_file(path) as f:
        while size:
            begin = max(0, size - block)
            f.seek(begin)
            found = f.read(size - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return 0


def ranges(start: dict[str, int], end: dict[str, int], size: int = RANGE) -> list[_Range]:
    """What lies between two offsets.  A file that has become shorter is read from its beginning."""
    found = []
    for path, to in end.items():
        base = start.get(path, 0)
        base = base if base <= to else 0
        found += [_Range(path, base, a, min(a + size, to)) for a in range(base, to, size)]
    return found


def lines_of(fs: pafs.FileSystem, r: _Range, block: int = BLOCK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Where the lines of a range begin, and the lines without their ends."""
    with fs.open_input_file(r.path) as f:
        at, held = r.start, b""
        f.seek(at)
        if at > r.base:  # the line that goes on here belongs to the range before, unless one ends right before it
            f.seek(at - 1)
            at -= 1
            while True:
                piece = f.read(block)
                if not piece:
                    return
                found = piece.find(b"\n")
                if found >= 0:
                    at += found + 1
                    held = piece[found + 1:]
                    break
                at += len(piece)
                if at >= r.end:
                    return
        while at < r.end:
            piece = f.read(block)
            held += piece
            cut = len(held) if not piece else held.rfind(b"\n") + 1
            if cut:
                places, texts = [], []
                for text in held[:cut].split(b"\n")[: None if not piece and not held.endswith(b"\n") else -1]:
                    if at >= r.end:
                        break
                    places.append(at)
                    at += len(text) + 1
                    texts.append(text[:-1] if text.endswith(b"\r") else text)
                if places:
                    yield places, texts
                held = held[cut:]
            if not piece:
                return


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.size, self.block = int(options.get("rangeBytes", RANGE)), int(options.get("blockBytes", BLOCK))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        for places, texts in lines_of(fs, partition, self.block):
            shown = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(places), pa.string()), pa.array(places, pa.int64()), shown], ["path", "at", "line"])


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return ranges({}, _files(self.root, self.suffix)[1], self.size) or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.end else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, files = _files(self.root, self.suffix)
        return {"files": json.dumps({path: complete(fs, path, size, self.block) for path, size in files.items()})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(json.loads(start["files"]), json.loads(end["files"]), self.size)

    def commit(self, end: dict) -> None:
        """Offsets are kept by the stream's checkpoint; the files are left as they are."""


class Tailed(DataSource):
    """The lines of a file, or of all files under a folder: path, at (the byte where the line begins) and line.

    Options: ``path`` (a URI that pyarrow opens), ``suffix`` of the files, ``rangeBytes`` and ``blockBytes``.  Files whose name
    begins with a dot or an underscore are left out.  Bytes that are not UTF-8 become U+FFFD, and a carriage return at a line's
    end goes.  A batch gives an unfinished last line too; a stream gives it when it is finished.  Of a file that has
    become shorter than what was read, all is read again.  Register with ``spark.dataSource.register(Tailed)``, format ``tailed``."""

    @classmethod
    def name(cls) -> str:
        return "tailed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
