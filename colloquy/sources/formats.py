"""Two formats for ``spark.read.format`` and ``df.write.format``: ``rttm`` lines, and ``files`` with one file for each row.

``register(spark)`` makes them known.  Paths are those that pyarrow's file systems open (local or mounted folders,
``s3://``, ``gs://``, ``hdfs://``); ``readers.rttm`` reads any path that Spark's own text reader does.

A writing task puts its files into a folder of its own below ``_try-<id>``.  Only when all tasks are done does the
driver rename what the counted attempts wrote; if a task fails for good the folder goes and the target is as before.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads, and lines in one batch.
SPLIT, LINES = 64 << 20, 20_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[fs.FileInfo]:
    """Files at or below a path, but for hidden ones."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda f: not any(part[0] in "_." for part in posixpath.relpath(f.path, info.path).split("/"))
    return sorted((f for f in below if f.type == fs.FileType.File and shown(f)), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    """The lines of a file that begin at bytes ``first`` to ``end``."""

    file: str
    first: int
    end: int


class RttmReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.meeting = path, split, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("meeting_id",) and self.meeting in (None, f.value):
                self.meeting = f.value
            else:
                yield f

    def partitions(self):
        parts = [Part(f.path, a, min(a + self.split, f.size)) for f in _files(self.path) for a in range(0, f.size, self.split)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.end <= part.first:
            return
        system, _ = _opened(self.path)
        schema = pa.schema([("meeting_id", pa.string()), ("speaker_id", pa.string()), ("start", pa.float64()), ("end", pa.float64())])
        rows: list[tuple] = []
        with system.open_input_file(part.file) as raw:
            # a line that began in the split before belongs to that one: go back a byte and skip to the next line
            raw.seek(max(0, part.first - 1))
            with pa.PythonFile(raw, mode="r") as f:
                at = raw.tell()
                lines = _lines(f)
                if part.first:
                    at += len(next(lines, b""))
                for line in lines:
                    if at >= part.end:
                        break
                    at += len(line)
                    if row := _spoken(line, self.meeting):
                        rows.append(row)
                    if len(rows) == LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _lines(f, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, from blocks of ``size`` bytes."""
    rest = b""
    while block := f.read(size):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


def _spoken(line: bytes, meeting: str | None) -> tuple[str, str, float, float] | None:
    """A SPEAKER line of at least eight fields with two numbers; anything else is None."""
    p = line.decode("utf-8", "replace").split()
    if len(p) < 8 or p[0] != "SPEAKER" or (meeting is not None and p[1] != meeting):
        return None
    try:
        start = float(p[3])
        return p[1], p[7], start, start + float(p[4])
    except ValueError:
        return None


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Staged(DataSourceWriter):
    """Writes below ``_try-<id>`` and renames in ``commit``."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.trial = path, overwrite, f"_try-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, root = _opened(self.path)
        own = posixpath.join(root, self.trial, uuid.uuid4().hex)
        system.create_dir(own, recursive=True)
        return system, root, own

    def commit(self, messages):
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(old.path) != self.trial:
                    system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
        for m in done:
            for name in m.names:
                target = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(posixpath.join(m.folder, name), target)
        self.abort(messages)

    def abort(self, messages):
        system, root = _opened(self.path)
        trial = posixpath.join(root, self.trial)
        if system.get_file_info(trial).type == fs.FileType.Directory:
            system.delete_dir(trial)


class RttmWriter(_Staged):
    def __init__(self, path: str, overwrite: bool, places: int, names: list[str]):
        super().__init__(path, overwrite)
        self.places, self.names = places, names

    def write(self, rows):
        system, _, own = self._place()
        name = f"part-{uuid.uuid4().hex}.rttm"
        k = self.places
        meeting, speaker, start, end = (self.names.index(n) for n in ("meeting_id", "speaker_id", "start", "end"))
        with system.open_output_stream(posixpath.join(own, name)) as f:
            for r in rows:
                f.write(f"SPEAKER {r[meeting]} 1 {r[start]:.{k}f} {r[end] - r[start]:.{k}f} <NA> <NA> {r[speaker]} <NA> <NA>\n".encode())
        return Written(own, [name])


class FilesWriter(_Staged):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        super().__init__(path, overwrite)
        self.names = names

    def write(self, rows):
        system, _, own = self._place()
        name, content = self.names.index("name"), self.names.index("content")
        made: list[str] = []
        for r in rows:
            clean = posixpath.normpath(str(r[name]))
            if clean.startswith(("/", "..", "_", ".")):
                raise ValueError(f"not a file name: {r[name]}")
            target = posixpath.join(own, clean)
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as f:
                f.write(r[content].encode() if isinstance(r[content], str) else bytes(r[content] or b""))
            made.append(clean)
        return Written(own, made)


class RttmSource(DataSource):
    """meeting_id, speaker_id, start, end of SPEAKER lines; large files are split by bytes, ``meeting_id = x`` is applied while reading.

    Options: ``splitBytes`` (64 MB), ``places`` of written times (3).
    """

    @classmethod
    def name(cls):
        return "rttm"

    def schema(self):
        return "meeting_id string, speaker_id string, start double, end double"

    def reader(self, schema):
        return RttmReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite):
        return RttmWriter(self.options["path"], overwrite, int(self.options.get("places", 3)), schema.names)


class FilesSource(DataSource):
    """Writes ``content`` (bytes or text) of each row to the file ``name`` below the path."""

    @classmethod
    def name(cls):
        return "files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RttmSource, FilesSource):
        spark.dataSource.register(source)
