"""Datasets saved as shards of Arrow batches: a data source that reads them by byte range, and writes them by bytes.

A dataset is a folder of .arrow files (IPC streams, or IPC files, which are streams between a magic word and a footer), with
a state.json that lists those that count; a folder of such folders has splits. A task reads the batches that begin in its
range of a file. To find them it goes from message to message by the sizes in their headers; of bodies it touches only the
columns asked for, where the file can be mapped.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "arrow_shards"
RANGE_BYTES, SHARD_BYTES = 128 << 20, 2 << 30
# Fixed values of the Arrow format: the magic word of files, the mark before a message's size, the kinds of messages.
MAGIC, CONTINUED = b"ARROW1\x00\x00", b"\xff\xff\xff\xff"
SCHEMA, DICTIONARY, BATCH = 1, 2, 3

#: Conditions: (column, operator, value).
OPERATORS = {"=": pc.equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}


@dataclass
class Message:
    kind: int
    start: int
    body: int
    end: int
    rows: int


@dataclass
class Range(InputPartition):
    """The batches of a file that begin in [start, end); of these only so many rows, if given."""

    path: str
    start: int
    end: int
    rows: int | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    else:
        system, inner = pafs.LocalFileSystem(), path
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(system, pafs.LocalFileSystem) else system), inner


def _field(data: bytes, table: int, number: int) -> int | None:
    """Where a field of a flat table lies; None where it is left out."""
    slots = table - struct.unpack_from("<i", data, table)[0]
    at = 4 + 2 * number
    found = struct.unpack_from("<H", data, slots + at)[0] if at < struct.unpack_from("<H", data, slots)[0] else 0
    return table + found if found else None


def _number(data: bytes, table: int, number: int, form: str) -> int:
    at = _field(data, table, number)
    return struct.unpack_from(form, data, at)[0] if at is not None else 0


def messages(file: pa.NativeFile, upto: int) -> Iterator[Message]:
    """The messages that begin before upto, by their headers alone."""
    at = 8 if file.size() >= 8 and file.read_at(8, 0)[: len(MAGIC)] == MAGIC else 0
    while at < upto:
        head = file.read_at(8, at)
        if len(head) < 8:
            return
        mark = 8 if head[:4] == CONTINUED else 4
        size = struct.unpack_from("<i", head, mark - 4)[0]
        if size == 0:
            return
        data = file.read_at(size, at + mark)
        table = struct.unpack_from("<I", data)[0]
        kind, body = _number(data, table, 1, "<B"), _number(data, table, 3, "<q")
        rows, own = 0, _field(data, table, 2)
        if kind == BATCH and own is not None:
            rows = _number(data, own + struct.unpack_from("<I", data, own)[0], 0, "<q")
        yield Message(kind, at, at + mark + size, at + mark + size + body, rows)
        at += mark + size + body


def batches(part: Range, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of a range, of these columns in their order."""
    system, path = opened(part.path)
    with system.open_input_file(path) as file:
        schema_bytes, left = None, part.rows
        # The task that begins a file looks at its first message in any case.
        for m in messages(file, part.end if part.start else file.size()):
            if m.kind == SCHEMA:
                schema_bytes = file.read_at(m.end - m.start, m.start)
                schema = pa.ipc.read_schema(pa.py_buffer(schema_bytes))
                lacking = [c for c in columns if c not in schema.names]
                if lacking:
                    raise ValueError(f"{part.path}: columns are missing: {', '.join(lacking)}")
                wanted = pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns])
            elif m.kind == DICTIONARY:
                # Batches that share dictionaries are read in order, by the task that begins the file.
                if part.start == 0:
                    yield from _whole(file, columns, part.rows)
                return
            elif m.start >= part.end:
                return
            elif m.kind == BATCH and m.start >= part.start and (left is None or left > 0):
                file.seek(m.start)
                pieces = [pa.py_buffer(schema_bytes), file.read_buffer(m.end - m.start)]
                batch = _decoded(pieces, wanted).select(columns)
                if left is not None:
                    batch, left = batch.slice(0, left), left - min(left, batch.num_rows)
                yield batch


def _decoded(pieces: list[pa.Buffer], wanted: pa.ipc.IpcReadOptions) -> pa.RecordBatch:
    schema = pa.ipc.read_schema(pieces[0])
    if not wanted.included_fields:
        # No column is asked for (a count): the header has the number of rows.
        return pa.RecordBatch.from_struct_array(pa.array([{}] * pa.ipc.read_record_batch(pa.ipc.read_message(pieces[1]), schema).num_rows, pa.struct([])))
    source = _Chained(pieces)
    return pa.ipc.open_stream(pa.PythonFile(source, mode="r"), options=wanted).read_next_batch()


class _Chained:
    """Buffers one after the other as a file, without a copy of what isn't read."""

    closed = False

    def __init__(self, pieces: list[pa.Buffer]) -> None:
        self.pieces, self.at = pieces, 0

    def read(self, n: int = -1) -> bytes | pa.Buffer:
        at = self.at
        for p in self.pieces:
            if at < p.size:
                take = p.size - at if n < 0 else min(n, p.size - at)
                self.at += take
                return p.slice(at, take).to_pybytes()
            at -= p.size
        return b""

    def read_buffer(self, n: int = -1) -> pa.Buffer:
        return pa.py_buffer(self.read(n))

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.closed = True


def _whole(file: pa.NativeFile, columns: list[str], rows: int | None) -> Iterator[pa.RecordBatch]:
    magic = file.read_at(8, 0)[: len(MAGIC)] == MAGIC
    file.seek(0)
    found = pa.ipc.open_file(file) if magic else pa.ipc.open_stream(file)
    for i in range(found.num_record_batches) if magic else found:
        batch = (found.get_batch(i) if magic else i).select(columns)
        batch = pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns], names=columns)
        if rows is not None:
            batch, rows = batch.slice(0, rows), rows - min(rows, batch.num_rows)
        yield batch


def holds(batch: pa.RecordBatch, where: list[tuple]) -> pa.RecordBatch:
    """The rows that meet all conditions; a null meets none but its own."""
    for column, operator, value in where:
        x = batch.column(column)
        if operator == "in":
            mask = pc.is_in(x, value_set=pa.array(value, x.type), skip_nulls=True)
        elif operator in ("null", "not null"):
            mask = x.is_null() if operator == "null" else x.is_valid()
        elif operator == "starts":
            mask = pc.starts_with(x, value)
        else:
            mask = OPERATORS[operator](x, pa.scalar(value, x.type))
        batch = batch.filter(mask, null_selection_behavior="drop")
    return batch


def split_folder(path: str, split: str | None, config: str | None = None) -> str:
    """Where a split lies: the folder of that name; where there is none, the first split there is, or the folder itself. With
    configurations (folders of folders), one must be named; the error tells which there are."""
    system, inner = opened(path)
    listed = lambda p: system.get_file_info(pafs.FileSelector(p))
    folders = lambda p: sorted(f.base_name for f in listed(p) if f.type == pafs.FileType.Directory and not f.base_name.startswith((".", "_")))
    holds_shards = lambda p: any(x.base_name.endswith(".arrow") for x in listed(p))
    if config:
        path, inner = posixpath.join(path, config), posixpath.join(inner, config)
    if holds_shards(inner):
        return path
    own = folders(inner)
    have = [f for f in own if holds_shards(posixpath.join(inner, f))]
    if not have:
        configs = [f for f in own if any(holds_shards(posixpath.join(inner, f, g)) for g in folders(posixpath.join(inner, f)))]
        if configs:
            raise ValueError(f"{path} has configurations, of which one must be named: {', '.join(configs)}")
    named = split if split in have else have[0] if have else None
    return posixpath.join(path, named) if named else path


def shards(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that count, in order: those that state.json lists, or, without one, all .arrow files."""
    system, inner = opened(path)
    found = {f.base_name: f.size for f in system.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File}
    names = sorted(n for n in found if n.endswith(".arrow"))
    if "state.json" in found:
        with system.open_input_stream(posixpath.join(inner, "state.json")) as f:
            names = [x["filename"] for x in json.loads(f.read())["_data_files"]]
    return [(posixpath.join(path, n), found[n]) for n in names]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, where: list[tuple], range_bytes: int, samples: int | None) -> None:
        self.path, self.columns, self.where, self.range_bytes, self.samples = path, schema.names, list(where), range_bytes, samples

    def partitions(self) -> list[Range]:
        out, left = [], self.samples
        for path, size in shards(self.path):
            if left is not None:
                # As many batches as the first rows take, by their headers.
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    for m in messages(file, size):
                        if m.kind == DICTIONARY:
                            raise ValueError("a limit of samples needs shards without dictionaries")
                        if m.kind == BATCH and left > 0:
                            out.append(Range(path, m.start, m.start + 1, min(left, m.rows)))
                            left -= min(left, m.rows)
                if left <= 0:
                    break
            else:
                out += [Range(path, at, min(at + self.range_bytes, size)) for at in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            extra = [c for c, _, _ in self.where if c not in self.columns]
            for batch in batches(partition, self.columns + list(dict.fromkeys(extra))):
                yield holds(batch, self.where).select(self.columns)


class PushingReader(ShardReader):
    """The same with filters from Catalyst, for sessions that allow them (spark.sql.python.filterPushdown.enabled)."""

    _COMPARED = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None if hasattr(f, "attribute") else None
            plain = lambda v: isinstance(v, (str, int)) and not isinstance(v, bool)
            if name not in self.columns:
                yield f
            elif type(f) in self._COMPARED and plain(f.value):
                self.where.append((name, self._COMPARED[type(f)], f.value))
            elif isinstance(f, In) and all(map(plain, f.value)):
                self.where.append((name, "in", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append((name, "null" if isinstance(f, IsNull) else "not null", None))
            elif isinstance(f, StringStartsWith):
                self.where.append((name, "starts", f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]
    task: int


class ShardWriter(DataSourceArrowWriter):
    """Each task writes files of its own, a new one where the next batch would pass the limit. They count once the driver has
    listed them in state.json, so attempts that were lost or repeated leave nothing behind that is read."""

    def __init__(self, path: str, most: int, overwrite: bool) -> None:
        self.path, self.most, self.overwrite, self.job = path, most, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context, (system, inner) = TaskContext.get(), opened(self.path)
        system.create_dir(inner, recursive=True)
        files: list[tuple[str, int]] = []
        out = sink = None
        for batch in iterator:
            for piece in cut(batch, self.most):
                if out is not None and sink.tell() + piece.nbytes > self.most:
                    out.close()
                    sink.close()
                    out = None
                if out is None:
                    name = f"data-{context.partitionId():05d}-{len(files):05d}-{self.job}-{context.taskAttemptId()}.arrow"
                    sink = system.open_output_stream(posixpath.join(inner, name))
                    out = pa.ipc.new_stream(sink, piece.schema)
                    files.append((name, 0))
                out.write_batch(piece)
                files[-1] = files[-1][0], files[-1][1] + piece.num_rows
        if out is not None:
            out.close()
            sink.close()
        return Written(files, context.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        names = [n for m in sorted((m for m in messages if m), key=lambda m: m.task) for n, _ in m.files]
        if not self.overwrite:
            names = [posixpath.basename(p) for p, _ in shards(self.path) if p.endswith(".arrow") and self.job not in p] + names
        with system.open_output_stream(posixpath.join(inner, "state.json.new")) as f:
            f.write(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": None}).encode())
        system.move(posixpath.join(inner, "state.json.new"), posixpath.join(inner, "state.json"))

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(posixpath.join(inner, name))


def cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many bytes, but of one row at least."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), most)
        yield from cut(batch.slice(half), most)


class ArrowShards(DataSource):
    """Options: path; config; split; where (conditions as JSON); max_samples; range_bytes; shard_bytes; pushdown."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        folder = split_folder(self.options["path"], self.options.get("split"), self.options.get("config"))
        for path, size in shards(folder):
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                for m in messages(file, size):
                    found = pa.ipc.read_schema(pa.py_buffer(file.read_at(m.end - m.start, m.start)))
                    plain = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in found]
                    return from_arrow_schema(pa.schema(plain))
        raise ValueError(f"{folder} has no shards")

    def reader(self, schema: StructType) -> ShardReader:
        o = self.options
        kind = PushingReader if o.get("pushdown") == "true" else ShardReader
        samples = o.get("max_samples")
        where = [tuple(x) for x in json.loads(o.get("where") or "[]")]
        return kind(split_folder(o["path"], o.get("split"), o.get("config")), schema, where, int(o.get("range_bytes") or RANGE_BYTES), int(samples) if samples else None)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("shard_bytes") or SHARD_BYTES), overwrite)


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[tuple] = (), split: str | None = "train", config: str | None = None, max_samples: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A dataset's rows: these columns (all without a list), of the rows that meet all conditions (column, operator, value).

    What is not asked for is not read: the scan's schema has the columns only, conditions are met before rows reach the JVM,
    and with max_samples (counted before conditions) no batch beyond the first ones is opened. Where the session allows
    filters to be pushed into such sources, those of later where() calls are, too.
    """
    spark.dataSource.register(ArrowShards)
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": path, "where": json.dumps(list(where)), "split": split or "", "config": config or "", "range_bytes": str(range_bytes), "max_samples": str(max_samples or ""), "pushdown": pushing}
    reader = spark.read.format(FORMAT).options(**options)
    if columns is not None:
        whole = reader.load().schema
        lacking = [c for c in columns if c not in whole.names]
        if lacking:
            raise ValueError(f"columns are missing: {', '.join(lacking)}")
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load()


def write_shards(df: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, mode: str = "overwrite") -> None:
    """The rows as shards of at most so many bytes of data (a larger row has one to itself)."""
    df.sparkSession.dataSource.register(ArrowShards)
    df.write.format(FORMAT).mode(mode).options(path=path, shard_bytes=str(shard_bytes)).save()
