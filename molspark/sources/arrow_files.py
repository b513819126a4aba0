"""Arrow IPC files as a Spark data source: a reader of runs of record batches, and a writer that commits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
#: Fixed value: the first bytes of a file that has a footer; a stream has none.
_MAGIC = b"ARROW1"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[fs.FileInfo]:
    """The files of a path or folder by name, without hidden ones and what stands in hidden folders."""
    system, base = _place(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    return sorted((f for f in found if f is info or not any(p.startswith(("_", ".")) for p in f.path[len(base.rstrip("/")) + 1 :].split("/"))), key=lambda f: f.path)


def _readable(kind: pa.DataType) -> pa.DataType:
    """The type that Spark has for an Arrow type: views, dictionaries and unsigned integers become what holds their values."""
    if pa.types.is_dictionary(kind):
        return _readable(kind.value_type)
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _readable(f.type), f.nullable) for f in kind])
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_readable(kind.value_type))
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_large_binary(kind) or pa.types.is_binary_view(kind) or pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.null(): pa.string()}
    return wider.get(kind, kind)


def _open(system: fs.FileSystem, path: str, columns: list[str] | None = None) -> ipc.RecordBatchFileReader | ipc.RecordBatchStreamReader:
    """A reader of a file or a stream; of a file only the bytes of ``columns`` are read."""
    file = system.open_input_file(path)
    magic = file.read(len(_MAGIC))
    file.seek(0)
    if magic != _MAGIC:
        return ipc.open_stream(file)
    if columns is None:
        return ipc.open_file(file)
    names = ipc.open_file(file).schema.names
    return ipc.open_file(file, options=ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns if c in names]))


@dataclass
class _Run(InputPartition):
    """The ``no``-th of ``of`` equal runs of a file's record batches."""

    path: str
    no: int
    of: int


class ArrowFileReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[_Run]:
        """By the files' sizes alone: the driver opens no file."""
        files = [(f.path, max(1, -(-f.size // self.range_bytes))) for f in _files(self.path)]
        return [_Run(path, no, of) for path, of in files for no in range(of)]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        reader = _open(_place(self.path)[0], partition.path, want.names)
        if isinstance(reader, ipc.RecordBatchFileReader):
            n = reader.num_record_batches
            batches = map(reader.get_batch, range(n * partition.no // partition.of, n * (partition.no + 1) // partition.of))
        else:
            batches = reader if partition.no == 0 else ()  # a stream can't be entered in its middle
        for batch in batches:
            columns = [batch.column(f.name).cast(_readable(batch.schema.field(f.name).type)).cast(f.type) if f.name in batch.schema.names else pa.nulls(len(batch), f.type) for f in want]
            yield pa.RecordBatch.from_arrays(columns, schema=want)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class ArrowFileWriter(DataSourceArrowWriter):
    """Tasks write into a hidden folder; the commit moves the files of the attempts that count, so an ended or killed task shows nothing."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"].rstrip("/"), schema, overwrite
        codec = options.get("compression", "zstd")
        self.codec = None if codec == "none" else codec
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def _file(self, base: str, name: str) -> str:
        return f"{base}/{self.hidden}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, base = _place(self.path)
        context, sink, name = TaskContext.get(), None, None
        for batch in iterator:
            if sink is None:
                name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.arrow"
                system.create_dir(f"{base}/{self.hidden}", recursive=True)
                stream = system.open_output_stream(self._file(base, name))
                sink = ipc.new_file(stream, batch.schema, options=ipc.IpcWriteOptions(compression=self.codec))
            sink.write_batch(batch)
        if sink is not None:
            sink.close()
            stream.close()
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        before = [f.path for f in _files(self.path)] if self.overwrite else []
        names = [m.name for m in messages if m and m.name]
        if not names:  # a table without rows still has its columns
            names = [f"part-00000-{uuid.uuid4().hex}.arrow"]
            system.create_dir(f"{base}/{self.hidden}", recursive=True)
            with system.open_output_stream(self._file(base, names[0])) as stream, ipc.new_file(stream, to_arrow_schema(self.schema)):
                pass
        for name in names:
            system.move(self._file(base, name), f"{base}/{name}")
        for path in before:
            system.delete_file(path)
        system.delete_dir(f"{base}/{self.hidden}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.hidden}")


class ArrowFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        """That of the first file."""
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no file in {self.options['path']}")
        found = _open(_place(self.options["path"])[0], files[0].path).schema
        return from_arrow_schema(pa.schema([pa.field(f.name, _readable(f.type), f.nullable) for f in found]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> ArrowFileReader:
        return ArrowFileReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowFileWriter:
        return ArrowFileWriter(self.options, schema, overwrite)


def arrow_scan(spark: SparkSession, path: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The tables of Arrow IPC files or streams under a path, columns by name; a column that a file lacks is null there.

    ``columns``: only these are read.  Files are read in runs of record batches of some ``range_bytes``, a stream in one task.
    """
    spark.dataSource.register(ArrowFileSource)
    reader = spark.read.format("arrow_ipc").option("rangeBytes", range_bytes)
    if columns is not None:
        fields = reader.load(path).schema
        reader = reader.schema(StructType([fields[c] for c in columns]))
    return reader.load(path)


def arrow_sink(df: DataFrame, path: str, mode: str = "append", compression: str = "zstd") -> None:
    """Write Arrow IPC files, one a task with rows; ``mode`` append or overwrite, ``compression`` zstd, lz4 or none.

    Files show up at the commit alone.  Attempts that failed or were killed leave nothing behind it.
    """
    df.sparkSession.dataSource.register(ArrowFileSource)
    df.write.format("arrow_ipc").option("compression", compression).mode(mode).save(path)
