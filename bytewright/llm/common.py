"""Shared pieces: reading tables, shared-folder checkpoints, Arrow batches bounded by bytes, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

import bytewright

# executors need not have the package installed
register_pickle_by_value(bytewright)

#: Bytes of text that a Python operator looks at together. One text is never divided.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that materialize() has written, by session; sweep() removes them.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in local mode (one machine, as in tests) gets a folder of its own; a cluster's is
    refused, as a folder of one machine would not do there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILES_GO, "false")
    spark.conf.set(FILES_GO, "true")  # nothing reads the write's shuffle files once the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILES_GO, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete all tables that materialize() has written in this session, but for what keep reads.

    To be called when results have been read or written: lazy results read these tables.
    """
    stay = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path.rpartition("/")[2] in stay:
            _written.setdefault(spark.sparkContext.applicationId, []).append(path)
        else:
            _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are written: it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lean() -> None:
    """Let this process give large arrays back as soon as they are freed.

    The C library otherwise keeps ever larger ones for later, up to 32 MB each, and Arrow's pool keeps its own.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if tune:
        tune(-3, 1 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Return memory that a task has freed to the system: Python workers live on and serve other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch in runs whose texts have limit bytes together at most, or are a single row."""
    sizes = batch.column(column)
    start = size = 0
    for i in range(batch.num_rows):
        n = len(sizes[i].as_buffer() or b"") if sizes[i].is_valid else 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[str], make: Callable, schema: str) -> DataFrame:
    """Map the columns of df (the last one being the text) through make() in Arrow batches.

    make() runs once in each task and returns a function from a list of column lists (texts as bytes, null where
    null) to a list of column lists in the order of schema.
    """
    fields = _parse_datatype_string(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, len(columns) - 1):
                out = step([part.column(i).to_pylist() for i in range(len(columns))])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                del out
        del step
        give_back()

    picked = df.select(*[F.col(c) for c in columns[:-1]], F.col(columns[-1]).cast("binary").alias("text"))
    return picked.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long); root is the smallest node reachable.

    Alternating large and small stars (Kiveris et al., SoCC 2014) over edges that point from a larger node to a
    smaller one. A node's smallest neighbour is an aggregate that each task combines before the shuffle, and it comes
    back to the node's edges by a join, which adaptive execution splits for a hub of any size. Each round ends in the
    shared folder; the number of rounds grows with the logarithm of the graph's size. Null ends and loops are ignored;
    no edges give no rows.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = materialize(edges.where("a <> b").select(hi, lo).distinct(), "stars")
    sums = None
    while True:
        up = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("parent"))
        large = materialize(now.join(up, "lo", "left").select("hi", F.coalesce("parent", "lo").alias("lo")).distinct(), "stars")
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi")
        pairs = F.array(F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))
        after = small.select(F.explode(pairs).alias("e")).select("e.*").where("hi <> lo").distinct()
        after = materialize(after, "stars")
        remove(now)
        remove(large)
        now, before = after, sums
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.union(now.select("lo", "lo").distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links i, j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        for ends in (label[i], label[j], i, j):
            np.minimum.at(label, ends, low)
        label = label[label]
        if (label == before).all():
            return label


def filter_texts(df: DataFrame, make: Callable) -> DataFrame:
    """The rows of df for which make()'s function is true, all columns kept as they are.

    make() runs once in each task and returns a function from a list of texts (bytes or None) to a list of booleans.
    """
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))
        del keep
        give_back()

    return df.mapInArrow(run, df.schema)
