"""FASTQ and FASTA files as Spark data sources."""

from __future__ import annotations

import io
import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequence import reverse_complement
from .shared import session_folder

ROWS = 4096


def _files(path: str) -> list[str]:
    """The files of a path or folder, in the order of their names, without hidden ones."""
    system, base = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    info = system.get_file_info(base)
    found = [base] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    return sorted(f for f in found if not f.rsplit("/", 1)[-1].startswith(("_", ".")))


def _lines(path: str, system_path: str) -> Iterator[str]:
    system, _ = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    stream = system.open_input_stream(system_path, compression="detect", buffer_size=1 << 20)
    with io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", newline="\n") as text:
        for line in text:
            yield line.rstrip("\r\n")


def _fastq(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    for head in lines:
        if head:
            seq = next(lines, "")
            next(lines, "")
            yield head.removeprefix("@"), seq, next(lines, "")


def _system(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")[0]


#: Bytes of a plain file that one task reads.
RANGE_BYTES = 64 << 20
_PACKED = (".gz", ".bgz", ".bz2", ".zst", ".lz4", ".xz")


def _ranges(path: str, files: list[str], size: int) -> list[tuple[str, int, int]]:
    """(file, begin, end) of each part of the files; a packed file is one part, which ends at -1."""
    out, system = [], _system(path)
    for info in system.get_file_info(files):
        if info.path.endswith(_PACKED):
            out.append((info.path, 0, -1))
        else:
            out += [(info.path, a, min(a + size, info.size)) for a in range(0, max(info.size, 1), size)]
    return out


def _records(path: str, file: str, begin: int, end: int) -> Iterator[tuple[str, str, str]]:
    """Records whose first line begins at ``begin`` .. ``end`` of a plain file; all of a packed one (``end`` -1).

    The first record at or behind ``begin`` starts at the first line that begins with @ while the next but one begins with +: a line of
    qualities may begin with @, but the next but one is then letters.
    """
    if end < 0:
        yield from _fastq(_lines(path, file))
        return
    with _system(path).open_input_file(file) as raw:
        raw.seek(max(0, begin - 1))
        lines, at = io.BufferedReader(raw, 1 << 20), max(0, begin - 1)

        def line() -> bytes:
            nonlocal at
            out = lines.readline()
            at += len(out)
            return out

        if begin:  # the rest of a line that began before
            line()
        ahead: list[tuple[int, bytes]] = []

        def next_line() -> tuple[int, bytes]:
            if ahead:
                return ahead.pop(0)
            place = at
            return place, line()

        if begin:
            while True:
                while len(ahead) < 3:
                    place = at
                    ahead.append((place, line()))
                if not ahead[2][1] or ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+"):
                    break
                ahead.pop(0)
            if not ahead[2][1]:  # no whole record is left
                return
        while True:
            place, head = next_line()
            if not head or place >= end:
                return
            head = head.rstrip(b"\r\n")
            if head:
                seq, _, qual = (next_line()[1].rstrip(b"\r\n") for _ in range(3))
                yield head.decode().removeprefix("@"), seq.decode(), qual.decode()


class _Part(InputPartition):
    """A part of a file and, of a pair, the part of the other file where the same records begin, and how many there stand before them."""

    def __init__(self, first: tuple[str, int, int], second: list[tuple[str, int, int]] = (), skip: int = 0):
        super().__init__(first)
        self.first, self.second, self.skip = first, list(second), skip


def _paired_files(path: str, path2: str | None) -> list[tuple[str, str]]:
    first = _files(path)
    second = _files(path2) if path2 else [f.replace("_R1_", "_R2_") for f in first if "_R1_" in f]
    first = first if path2 else [f for f in first if "_R1_" in f]
    if len(first) != len(second):
        raise ValueError(f"{len(first)} files of read 1 and {len(second)} of read 2")
    return list(zip(first, second, strict=True))


class FastqReader(DataSourceReader):
    """Plain files by ranges of bytes, packed ones whole; read in batches, so memory doesn't follow a file's size.

    ``paired``: records are paired by their places in two files.  With a ``plan`` (a JSON file of the numbers of records in each part) a part of
    the first file is met by the parts of the other that hold the same places; without one a pair of files is one task.
    """

    def __init__(self, options: dict[str, str], paired: bool, count: bool = False):
        self.path, self.path2, self.paired, self.count = options["path"], options.get("path2"), paired, count
        self.limit, self.size, self.plan = int(options.get("limit", "0")), int(options.get("rangebytes", RANGE_BYTES)), options.get("plan")

    def partitions(self) -> list[_Part]:
        size = 1 << 62 if self.limit else self.size  # the first records of a file stand in one part
        if not self.paired:
            return [_Part(r) for r in _ranges(self.path, _files(self.path), size)]
        other = self.path2 or self.path
        pairs = _paired_files(self.path, self.path2)
        if self.limit or not self.plan:
            return [_Part(r, _ranges(other, [b], 1 << 62)) for a, b in pairs for r in _ranges(self.path, [a], 1 << 62)]
        system, at = fs.FileSystem.from_uri(self.plan if "://" in self.plan else f"file://{self.plan}")
        with system.open_input_stream(at) as f:
            counts = {(file, begin): n for file, begin, n in json.loads(f.read())}
        out = []
        for a, b in pairs:
            ones, twos = _ranges(self.path, [a], self.size), _ranges(other, [b], self.size)
            ends = list(accumulate(counts.get((f, begin), 0) for f, begin, _ in twos))
            place = 0
            if sum(counts.get((f, begin), 0) for f, begin, _ in ones) != (ends[-1] if ends else 0):
                raise ValueError(f"{a} and {b} have different numbers of records")
            for part in ones:
                n = counts.get((part[0], part[1]), 0)
                if n:
                    k = bisect_right(ends, place)
                    out.append(_Part(part, twos[k:], place - (ends[k - 1] if k else 0)))
                place += n
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows = _records(self.path, *partition.first)
        names = ["rid", "seq", "qual"]
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array([partition.first[0]]), pa.array([partition.first[1]]), pa.array([sum(1 for _ in rows)])], ["file", "begin", "n"])
            return
        if self.paired:
            other = chain.from_iterable(_records(self.path2 or self.path, *p) for p in partition.second)
            rows = _zipped(rows, islice(other, partition.skip, None), whole=not self.plan)
            names = ["read_id", "r1_seq", "r1_qual", "r2_seq", "r2_qual"]
        if self.limit:
            rows = islice(rows, self.limit)
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)


def _zipped(one: Iterator[tuple], two: Iterator[tuple], whole: bool) -> Iterator[tuple]:
    """Pairs by place; both sides must end together if they are ``whole`` files."""
    for a, b in zip(one, two, strict=whole):
        yield a[0].split(" ")[0], a[1], a[2], b[1], b[2]


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "rid string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options, False)


class FastqCountSource(DataSource):
    """``file, begin, n``: how many records begin in each part of the files."""

    @classmethod
    def name(cls) -> str:
        return "fastq_counts"

    def schema(self) -> str:
        return "file string, begin long, n long"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options, False, count=True)


class PairedFastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paired_fastq"

    def schema(self) -> str:
        return "read_id string, r1_seq string, r1_qual string, r2_seq string, r2_qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options, True)


def fastq_scan(spark: SparkSession, path: str, rc: bool = False, limit: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rid, seq, qual`` of each record; ``limit`` records a file; optionally reverse-complemented.

    A plain file is read by a task for each ``range_bytes``; gzip can't be split, so a packed file is one task.
    """
    spark.dataSource.register(FastqSource)
    df = spark.read.format("fastq").option("limit", limit).option("rangeBytes", range_bytes).load(path)
    return df.select("rid", reverse_complement("seq").alias("seq"), F.reverse("qual").alias("qual")) if rc else df


def paired_fastq_scan(spark: SparkSession, r1_path: str, r2_path: str | None = None, rc: bool = False, limit: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Both reads of each pair, zipped by place in files that are paired by name order (or ``_R1_`` / ``_R2_``).

    Where a file is plain and longer than ``range_bytes``, a first pass counts the records of each part of all files; the sums of the counts tell
    where in the other file a part's records stand, so parts are read by many tasks and nothing is shuffled.  The driver gets one number a part.
    """
    spark.dataSource.register(PairedFastqSource)
    reader = spark.read.format("paired_fastq").option("limit", limit).option("rangeBytes", range_bytes)
    if r2_path:
        reader = reader.option("path2", r2_path)
    pairs = _paired_files(r1_path, r2_path)
    parts = [*_ranges(r1_path, [a for a, _ in pairs], range_bytes), *_ranges(r2_path or r1_path, [b for _, b in pairs], range_bytes)]
    if not limit and len(parts) > 2 * len(pairs):
        reader = reader.option("plan", _count_parts(spark, [r1_path, r2_path] if r2_path else [r1_path], range_bytes))
    df = reader.load(r1_path)
    return df.withColumns({"r2_seq": reverse_complement("r2_seq"), "r2_qual": F.reverse("r2_qual")}) if rc else df


def _count_parts(spark: SparkSession, paths: list[str], range_bytes: int) -> str:
    """A JSON file in the shared folder with the number of records in each part of the files."""
    spark.dataSource.register(FastqCountSource)
    rows = [tuple(r) for p in paths for r in spark.read.format("fastq_counts").option("rangeBytes", range_bytes).load(p).collect()]
    folder = session_folder(spark)
    system, at = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")
    system.create_dir(at, recursive=True)
    name = f"fastq-plan-{uuid.uuid4().hex}.json"
    with system.open_output_stream(f"{at}/{name}") as f:
        f.write(json.dumps(rows).encode())
    return f"{folder}/{name}".replace("file:", "", 1) if folder.startswith("file:/") and "://" not in folder else f"{folder}/{name}"


class FastaPairReader(DataSourceReader):
    """Reads a file's entries two by two: read, then reference."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[_Part]:
        return [_Part((f, 0, -1)) for f in _files(self.path)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        name, seq, held = None, [], None
        for line in _chain_end(_lines(self.path, partition.first[0])):
            if line.startswith(">"):
                if name is not None:
                    entry = (name, "".join(seq).upper())
                    if held:
                        yield (held[0], entry[1], held[1])
                    held = None if held else entry
                name, seq = line[1:], []
            else:
                seq.append(line.strip())


def _chain_end(lines: Iterator[str]) -> Iterator[str]:
    yield from lines
    yield ">"  # ends the last entry


class FastaPairSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pairs"

    def schema(self) -> str:
        return "name string, ref_seq string, read_seq string"

    def reader(self, schema) -> FastaPairReader:
        return FastaPairReader(self.options)


def aligned_fasta_pairs(spark: SparkSession, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """One row an alignment of alternating read and reference entries, upper-cased; name parts ``mm_hash_umi_count`` as columns."""
    spark.dataSource.register(FastaPairSource)
    df = spark.read.format("fasta_pairs").load(path)
    parts = F.split("name", "_")
    cut = {c: F.expr(f"substr({c}, {start}{'' if end is None else f', {end - start + 1}'})") for c in ("ref_seq", "read_seq")}
    return df.withColumns({**cut, "umi": F.get(parts, F.lit(2)), "count": F.get(parts, F.lit(3)).try_cast("int")})
