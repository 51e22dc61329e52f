"""Streams that arrive in chunks: resuming a machine where the last chunk left it.

In a streaming query each stream id has its state (machine state, position, the record under way, the bytes from its
mark on) in Spark's state store. Tables of chunks can be run in parallel instead: each chunk becomes the map from the
state before it to the state behind it, maps are composed, and no chunk waits for another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from bytewright.functions.columns import compiled, plain
from bytewright.functions.runtime import ERROR, Program
from bytewright.operators.records import RecordParser
from bytewright.plans.regex import Regex

STATE = "state int, position bigint, mark bigint, carry binary, record string, seq int"


def read_stream(chunks: DataFrame, parser: RecordParser) -> DataFrame:
    """(stream_id, seq, fields..., status, position), a row for each record as soon as it is complete.

    chunks: stream_id string, chunk_no long, bytes binary, is_last boolean; of a stream in order of chunk_no. When it
    ends (is_last) or goes wrong, a row without fields gives its status: ok, error or incomplete, and the position.
    Chunks behind the end are ignored.
    """
    schema = StructType.fromDDL("stream_id string, seq int")
    for f in parser.schema.fields:
        schema = schema.add(f.name, f.dataType)
    schema = schema.add("status", "string").add("position", "long")
    names = [f.name for f in parser.schema.fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state, position, mark, carry, record, seq = store.get if store.exists else (1, 1, -1, b"", "{}", 0)
        now = {k: v.encode("latin-1") for k, v in json.loads(record).items()}
        program = Program(parser.machine)
        out = []
        rows = pd.concat(list(frames)).sort_values("chunk_no")
        for chunk, last in zip(rows["bytes"], rows["is_last"], strict=True):
            if state <= 0:
                break
            before = position - 1 - len(carry)  # bytes of the stream that are gone
            data = bytes(carry) + bytes(chunk or b"")
            found = program.run(data, state, len(carry) + 1, is_eof=bool(last))
            made, now, mark = parser.build(data, found, now, mark, before)
            state, position = found.state, before + found.position
            carry = data[mark - before :] if mark >= 0 else b""
            for r in made:
                seq += 1
                out.append({"stream_id": key[0], "seq": seq, **r})
            if last or found.status == ERROR:
                out.append({"stream_id": key[0], "status": found.status, "position": position})
                state = min(state, 0)
        store.update((state, position, mark, bytes(carry), json.dumps({k: v.decode("latin-1") for k, v in now.items() if isinstance(v, bytes)}), seq))
        frame = pd.DataFrame(out, columns=["stream_id", "seq", *names, "status", "position"])
        for name in ("seq", "position", *(f.name for f in parser.schema.fields if f.dataType.typeName() in ("integer", "long", "short"))):
            frame[name] = frame[name].astype("Int64")
        yield frame

    return chunks.groupBy("stream_id").applyInPandasWithState(step, schema, StructType.fromDDL(STATE), "append", GroupStateTimeout.NoTimeout)


def final_states(chunks: DataFrame, x: Regex | str) -> DataFrame:
    """(stream_id, state, accepted) of whole streams whose chunks are rows of a table.

    state is where the machine stands behind the last chunk, 0 if some byte fitted nowhere. The maps of a stream's
    chunks are composed in their order; a map has a number for each state, however large the chunk is.
    """
    finals = sorted(compiled(plain(x)).finals)
    state = F.aggregate("maps", F.lit(1), lambda s, m: F.element_at(m["map"], s + 1))
    return _ordered_maps(chunks, x).select("stream_id", state.alias("state")).withColumn("accepted", F.col("state").isin(finals))


def _ordered_maps(chunks: DataFrame, x: Regex | str) -> DataFrame:
    """(stream_id, maps): struct(chunk_no, map) of a stream's chunks in their order."""
    machine = compiled(plain(x))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(machine)
        for batch in batches:
            found = [program.state_map(b or b"") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["stream_id", "chunk_no", "map"])

    mapped = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "bytes").mapInArrow(maps, "stream_id string, chunk_no long, map array<int>")
    return mapped.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "map"))).alias("maps"))


def start_states(chunks: DataFrame, x: Regex | str) -> DataFrame:
    """(stream_id, chunk_no, state): where the machine stands before each chunk, 0 behind a byte that fitted nowhere.

    With them every chunk can be run by itself, so one long stream is read by as many tasks as it has chunks.
    """
    ordered = _ordered_maps(chunks, x)
    states = F.aggregate("maps", F.array(F.lit(1)), lambda s, m: F.array_append(s, F.element_at(m["map"], F.element_at(s, -1) + 1)))
    pairs = F.arrays_zip(F.col("maps.chunk_no").alias("chunk_no"), states.alias("state"))
    return ordered.select("stream_id", F.explode(pairs).alias("p")).select("stream_id", F.col("p.chunk_no").alias("chunk_no"), F.col("p.state").alias("state")).where("chunk_no is not null")


def first_errors(chunks: DataFrame, x: Regex | str) -> DataFrame:
    """(stream_id, position): of whole streams in chunks what first_error() says of them: null, 0 or a position."""
    machine = compiled(plain(x))
    before = start_states(chunks, x)
    sizes = Window.partitionBy("stream_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "bytes")
    lengths = numbered.select("stream_id", "chunk_no", F.coalesce(F.octet_length("bytes"), F.lit(0)).alias("n"))
    offsets = lengths.withColumn("offset", F.coalesce(F.sum("n").over(sizes), F.lit(0))).drop("n")
    work = numbered.join(before.join(offsets, ["stream_id", "chunk_no"]), ["stream_id", "chunk_no"]).select("stream_id", "state", "offset", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(machine)
        for batch in batches:
            out = []
            for state, offset, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = program.run(data or b"", state, is_eof=False) if state else None
                out.append(offset + found.position if found and found.status == ERROR else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["stream_id", "position"])

    errors = work.mapInArrow(run, "stream_id string, position long").groupBy("stream_id").agg(F.min("position").alias("position"))
    ends = final_states(chunks, x)
    return ends.join(errors, "stream_id").select("stream_id", F.when(F.col("state") == 0, F.col("position")).when(~F.col("accepted"), 0).alias("position"))


def chunked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(stream_id, chunk_no, bytes, is_last): texts cut into chunks of size bytes; an empty text is one empty chunk."""
    data = F.col(text).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    cut = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("stream_id"), data.alias("data"), n.alias("n"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("chunk_no"))
    return cut.select("stream_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.substring("data", (F.col("chunk_no") - 1) * size + 1, F.lit(size)).alias("bytes"), (F.col("chunk_no") == F.col("n")).alias("is_last"))


