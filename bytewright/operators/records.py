"""Record parsers: a machine whose actions build rows of a declared schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from bytewright.functions.columns import compiled, expression
from bytewright.functions.runtime import ERROR, OK, Outcome, Program
from bytewright.plans.regex import Regex, RegexError

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


@dataclass(frozen=True)
class Mark:
    """Remember the position of this byte."""


@dataclass(frozen=True)
class Capture:
    """Set a field to the bytes from the mark up to this byte, which isn't included. The mark is used up."""

    field: str


@dataclass(frozen=True)
class Append:
    """Add the bytes from the mark up to this byte to a field. The mark is used up."""

    field: str


@dataclass(frozen=True)
class Put:
    """Set a field to a value."""

    field: str
    value: Any


@dataclass(frozen=True)
class Emit:
    """Finish a record; its fields become null for the next."""


Step = Mark | Capture | Append | Put | Emit


class InputError(ValueError):
    """Input that a machine doesn't accept, where it must."""


class RecordParser:
    """An expression with actions, what each action does, and the schema of the records.

    actions: name to a step or several. The names have to be exactly those of the expression.
    """

    def __init__(self, x: Regex | str, actions: Mapping[str, Step | Sequence[Step]], schema: str | StructType) -> None:
        self.expression = expression(x)
        self.machine = compiled(self.expression)
        if self.machine.guards:
            raise RegexError("a record parser has nothing to evaluate preconditions with")
        self.actions = {n: tuple(s) if isinstance(s, (list, tuple)) else (s,) for n, s in actions.items()}
        if set(self.actions) != self.machine.actions:
            raise RegexError(f"the expression has the actions {sorted(self.machine.actions)}, and those given are {sorted(self.actions)}")
        self.schema = _schema(schema) if isinstance(schema, str) else schema
        self.convert = {f.name: _converter(f.dataType.typeName()) for f in self.schema.fields}
        unknown = {s.field for steps in self.actions.values() for s in steps if hasattr(s, "field")} - set(self.convert)
        if unknown:
            raise RegexError(f"the schema lacks {sorted(unknown)}")

    def build(self, data: bytes, found: Outcome, record: dict | None = None, mark: int = -1, offset: int = 0) -> tuple[list[dict], dict, int]:
        """Records that the events of a run complete, the record under way, and the mark.

        offset: how many bytes of the stream lie before data.
        """
        now = dict(record or {})
        out = []
        for position, name in found.events:
            at = position - 1
            for step in self.actions[name]:
                if isinstance(step, Mark):
                    mark = at + offset
                elif isinstance(step, (Capture, Append)):
                    if mark < 0:
                        raise RegexError(f"the action {name!r} captures, and nothing has marked where")
                    piece = data[mark - offset : at]
                    mark = -1
                    now[step.field] = now.get(step.field, b"") + piece if isinstance(step, Append) else piece
                elif isinstance(step, Put):
                    now[step.field] = step.value
                else:
                    out.append({n: _made(now.get(n), make) for n, make in self.convert.items()})
                    now = {}
        return out, now, mark


FIELD = re.compile(r"\s*(?:`([^`]+)`|(\w+))\s*:?\s+(\w+)\s*(?:,|$)")
#: Names of the field types in a schema's text.
TYPES = {"tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long", "real": "float"}


def _schema(text: str) -> StructType:
    """Fields from 'name type, ...'; unlike Spark's own parser this needs no session, so executors can use it."""
    out, at = StructType(), 0
    while at < len(text):
        found = FIELD.match(text, at)
        if not found:
            raise RegexError(f"a schema is 'name type, ...': {text[at:]!r}")
        kind = found[3].lower()
        out = out.add(found[1] or found[2], TYPES.get(kind, kind))
        at = found.end()
    return out


def _made(value: Any, make: Callable) -> Any:
    return make(value) if isinstance(value, bytes) else value


def _converter(kind: str) -> Callable[[bytes], Any]:
    if kind in ("byte", "short", "integer", "long"):
        return int
    if kind in ("float", "double"):
        return float
    if kind == "binary":
        return bytes
    if kind == "string":
        return lambda raw: raw.decode("utf-8", "replace")
    raise RegexError(f"records have no fields of type {kind}: parse a string and cast it")


def describe(data: bytes, found: Outcome, parser: RecordParser) -> str:
    """What was wrong: where, the last bytes read, and what would have been accepted."""
    from bytewright.plans.dot import edge_text

    at = found.position - 1
    read = data[max(0, at - 100) : at]
    state = abs(found.state)
    what = f"byte {data[at]:#04x}" if found.status == ERROR else "the end"
    wanted = ", ".join(edge_text(e.labels, e.guards, e.actions) for e in parser.machine.edges if e.source == state)
    return f"at position {found.position}, {what} isn't accepted in state {state} after {read!r}; accepted: {wanted or 'nothing'}"


def parse_records(df: DataFrame, text: str, parser: RecordParser, keys: Iterable[str] = (), mode: str = "PERMISSIVE") -> DataFrame:
    """(keys..., seq, fields...[, _status, _error]), a row for each record of each text; null texts have none.

    PERMISSIVE: the records before an error stay, with _status and _error (null when ok) on each row, and a text
    without any has one row of nulls. DROPMALFORMED: texts that aren't accepted have no rows. FAILFAST: they raise.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: there are {', '.join(MODES)}")
    kept = list(keys)
    if taken := {k.lower() for k in kept} & {"seq", "_status", "_error", *(f.name.lower() for f in parser.schema.fields)}:
        raise ValueError(f"rename the keys {sorted(taken)}: records have columns of those names")
    source = df.where(F.col(text).isNotNull()).select(*kept, F.col(text).cast("binary").alias("text"))
    schema = source.select(*kept).schema.add("seq", "integer")
    for f in parser.schema.fields:
        schema = schema.add(f.name, f.dataType)
    if mode == "PERMISSIVE":
        schema = schema.add("_status", "string").add("_error", "string")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    names = [f.name for f in parser.schema.fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(parser.machine)
        for batch in batches:
            owner: list[int] = []
            seq: list[int | None] = []
            out: dict[str, list] = {n: [] for n in names}
            notes: list[tuple[str, str | None]] = []
            for i in range(batch.num_rows):
                data = batch.column(len(kept))[i].as_py()
                found = program.run(data)
                fine = found.status == OK
                if not fine and mode == "DROPMALFORMED":
                    continue
                if not fine and mode == "FAILFAST":
                    raise InputError(describe(data, found, parser))
                made, _, _ = parser.build(data, found)
                note = (found.status, None if fine else describe(data, found, parser))
                if not made and not fine:
                    made, numbers = [dict.fromkeys(names)], [None]
                else:
                    numbers = list(range(1, len(made) + 1))
                owner += [i] * len(made)
                seq += numbers
                notes += [note] * len(made)
                for n in names:
                    out[n] += [r[n] for r in made]
            columns = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(len(kept))]
            columns.append(pa.array(seq, pa.int32()))
            columns += [pa.array(out[n], arrow.field(n).type) for n in names]
            if mode == "PERMISSIVE":
                columns += [pa.array([s for s, _ in notes], pa.string()), pa.array([e for _, e in notes], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(rows, schema)
