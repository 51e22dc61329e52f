"""Files as inputs of machines: whole files, compressed ones too, and a Spark data source of records."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.operators.records import RecordParser, parse_records


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()


#: Extensions of compressed files.
CODECS = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress, ".zst": _zstd}


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content): whole files on any file system that Spark reads, decompressed by their extensions."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = [next((f(r) for e, f in CODECS.items() if n.endswith(e)), r) for n, r in zip(names, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["path", "content"])

    return found.mapInArrow(plain, "path string, content binary")


def read_records(spark: SparkSession, path: str, parser: RecordParser, mode: str = "PERMISSIVE", glob: str | None = None) -> DataFrame:
    """Records of whole files, with the file's path."""
    return parse_records(read_files(spark, path, glob), "content", parser, ["path"], mode)


def write_pieces(df: DataFrame, path: str, column: str, codec: str | None = None) -> None:
    """Write a string column as text files."""
    writer = df.select(F.col(column).alias("value")).write
    (writer.option("compression", codec) if codec else writer).text(path)
