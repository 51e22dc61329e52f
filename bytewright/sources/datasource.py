"""A Spark data source of records: spark.read.format("bytewright").option("machine", "fasta").load(path).

register(spark) makes it known. Each file is a partition and is read in pieces: the machine resumes where the last piece
left it, so a task holds one piece and the record under way, however large the file is. Paths are what Arrow's file
systems read (local paths, hdfs://, s3://, gs://); compressed files are decompressed by their extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from bytewright import formats
from bytewright.functions.runtime import ERROR, OK, Program
from bytewright.operators.records import InputError, RecordParser

#: Bytes of a piece.
PIECE = 4 << 20
MACHINES = {"fasta": formats.fasta, "bed3": formats.bed3, "numbers": formats.numbers}


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def records_of(pieces: Iterator[bytes], parser: RecordParser, what: str = "input") -> Iterator[tuple]:
    """Rows of a stream of pieces; raises where the stream isn't accepted."""
    program = Program(parser.machine)
    state, position, mark, carry, now = 1, 1, -1, b"", {}
    piece = next(pieces, b"")
    while True:
        after = next(pieces, None)
        before = position - 1 - len(carry)
        data = carry + piece
        found = program.run(data, state, len(carry) + 1, is_eof=after is None)
        made, now, mark = parser.build(data, found, now, mark, before)
        for r in made:
            yield tuple(r.values())
        state, position = found.state, before + found.position
        carry = data[mark - before :] if mark >= 0 else b""
        if found.status == ERROR or after is None:
            if found.status != OK:
                raise InputError(f"{what} isn't accepted: {found.status} at position {position}")
            return
        piece = after


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[File]:
        system, path = fs.FileSystem.from_uri(_uri(self.options["path"]))
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(_uri(self.options["path"]))
        size = int(self.options.get("piece", PIECE))
        with system.open_input_stream(partition.path, compression="detect") as stream:
            yield from records_of(iter(lambda: stream.read(size), b""), MACHINES[self.options["machine"].lower()](), partition.path)


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:")


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytewright"

    def schema(self) -> StructType:
        machine = self.options.get("machine", "").lower()
        if machine not in MACHINES:
            raise ValueError(f"the option machine is one of {', '.join(MACHINES)}")
        return MACHINES[machine]().schema

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
