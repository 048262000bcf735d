"""A saved dataset on disk: a directory of Arrow IPC stream files, read and written as a Spark data source.

``state.json`` names the data files in order; without it all ``*.arrow`` files
are taken, by name. A file of more than ``split_bytes`` becomes several partitions, cut where record batches end: what this module
writes notes those places in ``state.json``; in files of others they are found by reading the headers of the messages, not their bodies.
With the option ``columns`` (a JSON list) only those columns are decoded.
Files are opened with Hadoop-independent Arrow file systems: the path must be
reachable by all executors. Each task writes a file of its own, and ``state.json`` is
written last, so a folder without it was not finished.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


#: Files up to this size are one partition.
SPLIT_BYTES = 128 << 20
#: Batches beyond this are written as several, so a reader never holds more of a file of ours (but for a single row).
BATCH_BYTES = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def splits(path: str) -> list[str] | None:
    """The split names of a saved dict of tables, or None for a single table."""
    system, base = opened(path)
    named = posixpath.join(base, "dataset_dict.json")
    if system.get_file_info(named).type == fs.FileType.File:
        with system.open_input_stream(named) as f:
            return json.loads(f.read())["splits"]
    return None


def _state(path: str) -> list[dict] | None:
    system, base = opened(path)
    state = posixpath.join(base, "state.json")
    if system.get_file_info(state).type != fs.FileType.File:
        return None
    with system.open_input_stream(state) as f:
        return json.loads(f.read()).get("_data_files", [])


def noted_ends(path: str) -> dict[str, list[int]]:
    """Ends of batches, by file, that the writer has noted."""
    return {x["filename"]: x["batch_ends"] for x in _state(path) or [] if x.get("batch_ends")}


def files(path: str) -> list[str]:
    system, base = opened(path)
    if (named := _state(path)) is not None:
        return [posixpath.join(base, x["filename"]) for x in named]
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = [i.path for i in system.get_file_info(fs.FileSelector(base)) if i.path.endswith(".arrow")]
    if not found:
        raise FileNotFoundError(f"no .arrow files in {path}")
    return sorted(found)


#: Numbers of the format: the mark before a message's length, and the kinds of message.
_MARK, _DICTIONARY, _BATCH = b"\xff\xff\xff\xff", 2, 3


def _header(message: bytes) -> tuple[int, int]:
    """Kind and length of the body from a message's metadata (a flatbuffer table, of which they are fields 1 and 3)."""
    at = struct.unpack_from("<I", message)[0]
    fields = at - struct.unpack_from("<i", message, at)[0]
    places = [struct.unpack_from("<H", message, fields + 4 + 2 * i)[0] if 4 + 2 * i < struct.unpack_from("<H", message, fields)[0] else 0 for i in range(4)]
    return (message[at + places[1]] if places[1] else 0), (struct.unpack_from("<q", message, at + places[3])[0] if places[3] else 0)


def batch_ends(f: pa.NativeFile) -> list[int] | None:
    """Where each record batch of a stream ends. None if batches depend on dictionaries before them."""
    ends, at, size = [], 0, f.size()
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        skip, n = (8, struct.unpack("<i", head[4:])[0]) if head[:4] == _MARK else (4, struct.unpack("<i", head[:4])[0])
        if not n:
            break
        f.seek(at + skip)
        kind, body = _header(f.read(n))
        at += skip + n + body
        if kind == _DICTIONARY:
            return None
        if kind == _BATCH:
            ends.append(at)
    return ends


class _Piece(io.RawIOBase):
    """A stream of a schema and the record batches in one part of a file."""

    def __init__(self, schema: bytes, f: pa.NativeFile, start: int, end: int):
        self.head, self.f, self.left = schema, f, end - start
        f.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if self.head:
            got, self.head = self.head[: len(buffer)], self.head[len(buffer) :]
        else:
            got = self.f.read(min(len(buffer), self.left))
            self.left -= len(got)
        buffer[: len(got)] = got
        return len(got)


class _Part(InputPartition):
    """Bytes of a file; ``start`` 0 means from the schema on, ``end`` None to the end."""

    def __init__(self, name: str, start: int = 0, end: int | None = None):
        super().__init__((name, start))
        self.name, self.start, self.end = name, start, end


def _parts(name: str, ends: list[int] | None, split_bytes: int) -> list[_Part]:
    out, start = [], 0
    for end in ends or []:
        if end - start >= split_bytes:
            out.append(_Part(name, start, end))
            start = end
    if not ends or start < ends[-1]:
        out.append(_Part(name, start, ends[-1] if ends and start else None))
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.columns, self.split_bytes = path, schema.names, split_bytes

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.path)
        known = noted_ends(self.path)

        def cut(name: str) -> list[_Part]:
            if system.get_file_info(name).size <= self.split_bytes:
                return [_Part(name)]
            ends = known.get(posixpath.basename(name))
            if ends is None:
                with system.open_input_file(name) as f:
                    ends = batch_ends(f)
            return _parts(name, ends, self.split_bytes)

        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(cut, files(self.path)) for p in parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.name) as f:
            with pa.ipc.open_stream(f) as whole:
                schema = whole.schema
            places = [schema.get_field_index(c) for c in self.columns]
            options = pa.ipc.IpcReadOptions(included_fields=sorted(places) if len(places) < len(schema) else None)
            if partition.start:
                source = pa.PythonFile(io.BufferedReader(_Piece(schema.serialize().to_pybytes(), f, partition.start, partition.end), 1 << 20), "r")
            else:
                f.seek(0)
                source = f if partition.end is None else pa.PythonFile(io.BufferedReader(_Piece(b"", f, 0, partition.end), 1 << 20), "r")
            with pa.ipc.open_stream(source, options=options) as stream:
                for batch in small(b.select(self.columns) for b in stream):
                    yield batch


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    ends: list[int] = field(default_factory=list)


def small(batches: Iterator[pa.RecordBatch], most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes``, without copies."""
    most_bytes = most_bytes or BATCH_BYTES
    for batch in batches:
        rows = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.fields, self.overwrite = path, schema, overwrite

    def _stream(self, name: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch], note_each: int = 8 << 20) -> list[int]:
        """Where batches end, about every ``note_each`` bytes."""
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        ends: list[int] = []
        with system.open_output_stream(posixpath.join(base, name)) as f, pa.ipc.new_stream(f, schema) as out:
            last = 0
            for batch in small(batches):
                out.write_batch(batch)
                last = f.tell()
                if last - (ends[-1] if ends else 0) >= note_each:
                    ends.append(last)
            if last and (not ends or ends[-1] < last):
                ends.append(last)
        return ends

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        first = next(iterator, None)
        if first is None:
            return _Written(number, "")
        schema, head = first.schema, [first]
        del first

        def batches():
            yield head.pop()  # not kept while the others are written
            yield from iterator

        name = f"data-{number:05d}-{uuid.uuid4().hex[:8]}.arrow"  # another try of the task takes another name
        return _Written(number, name, self._stream(name, schema, batches()))

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = opened(self.path)
        made = [m for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.name] or [_Written(0, "data-00000-empty.arrow")]
        names = [m.name for m in made]
        if not made[0].ends:
            self._stream(names[0], to_arrow_schema(self.fields), iter(()))
        # files of tries that weren't committed, and, if they are to be replaced, of what was there before
        for info in system.get_file_info(fs.FileSelector(base)):
            if info.base_name.endswith(".arrow") and info.base_name not in names:
                system.delete_file(info.path)
        with system.open_output_stream(posixpath.join(base, "state.json")) as f:
            f.write(json.dumps({"_data_files": [{"filename": m.name, "batch_ends": m.ends} for m in made], "_split": None}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = opened(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(posixpath.join(base, m.name))


def write(table, path: str) -> None:
    """A table as a saved dataset, in place of what is there."""
    table.sparkSession.dataSource.register(ArrowDir)
    system, base = opened(path)
    state = posixpath.join(base, "state.json")
    if system.get_file_info(state).type == fs.FileType.File:
        system.delete_file(state)
    table.write.format("arrow_dir").option("path", path).mode("append").save()


def write_splits(tables: dict, path: str) -> None:
    system, base = opened(path)
    for name, table in tables.items():
        write(table, f"{path}/{name}")
    with system.open_output_stream(posixpath.join(base, "dataset_dict.json")) as f:
        f.write(json.dumps({"splits": list(tables)}).encode())


class ArrowDir(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_dir"

    def schema(self) -> StructType:
        system, _ = opened(self.options["path"])
        first = files(self.options["path"])[:1]
        if not first:
            raise FileNotFoundError(self.options["path"])
        with system.open_input_stream(first[0]) as f, pa.ipc.open_stream(f) as stream:
            whole = from_arrow_schema(stream.schema)
        wanted = json.loads(self.options.get("columns") or "null")
        return whole if wanted is None else StructType([f for f in whole.fields if f.name in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("split_bytes") or SPLIT_BYTES))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)
