"""Column expressions over text or binary columns: matches, errors, runs and traces.

Each takes an expression (or pattern) that is compiled once on the driver. A match is decided in Catalyst where the
expression can be written without backtracking, otherwise by a machine over Arrow batches. Null inputs give nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytewright.functions.runtime import Program, location
from bytewright.plans.automata import Machine, compile_regex
from bytewright.plans.native import is_deterministic, is_regular, java_pattern, predicate
from bytewright.plans.regex import Regex, RegexError, rx


def expression(x: Regex | str) -> Regex:
    return rx(x) if isinstance(x, str) else x


@lru_cache(maxsize=256)
def compiled(x: Regex, unambiguous: bool = True) -> Machine:
    return compile_regex(x, unambiguous=unambiguous)


def plain(x: Regex | str) -> Regex:
    """An expression whose language alone matters."""
    found = expression(x)
    if found.has_guards():
        raise RegexError("preconditions have no meaning here: nothing binds them")
    return found.without_actions()


def as_bytes(text: Column | str, binary: bool = False) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return column.cast("binary")  # not F.encode, which mends bytes that are no UTF-8


def _over(data: Column, make: Callable[[], Callable], kind: str, arrow: pa.DataType) -> Column:
    """A function of bytes over Arrow batches; make() runs once in each task."""
    ready: list[Callable] = []

    def run(batch: pa.Array) -> pa.Array:
        if not ready:
            ready.append(make())
        one = ready[0]
        return pa.array([None if x is None else one(x) for x in batch.to_pylist()], arrow)

    return F.arrow_udf(run, kind)(data)


def _checker(x: Regex) -> Callable[[], Callable[[bytes], int | None]]:
    """What makes first_error() in a task. Where the expression is deterministic, Python's own matcher accepts at C
    speed, and the machine only runs over inputs that it rejects, to say where."""
    machine = compiled(x)
    quick = java_pattern(x).encode("ascii") if is_regular(x) and is_deterministic(x) else None

    def make() -> Callable[[bytes], int | None]:
        program = Program(machine)
        if quick is None:
            return program.first_error
        accepts = re.compile(quick, re.S).fullmatch
        return lambda data: None if accepts(data) else program.first_error(data)

    return make


def matches(text: Column | str, x: Regex | str, *, engine: str = "auto", binary: bool = False) -> Column:
    """Whether the whole text is in the language.

    engine: native (Catalyst, an error where there is no safe pattern), arrow (the machine) or auto.
    """
    if engine not in ("auto", "native", "arrow"):
        raise ValueError(f"unknown engine {engine!r}: there are auto, native and arrow")
    column, wanted = F.col(text) if isinstance(text, str) else text, plain(x)
    if engine != "arrow":
        found = predicate(column, wanted, binary)
        if found is not None:
            return found
        if engine == "native":
            raise RegexError("no pattern decides this expression without backtracking")
    checker = _checker(wanted)

    def make() -> Callable:
        check = checker()
        return lambda data: check(data) is None

    return _over(as_bytes(column, binary), make, "boolean", pa.bool_())


def first_error(text: Column | str, x: Regex | str, *, binary: bool = False) -> Column:
    """Null for a match, 0 for an unexpected end, else the position of the first byte that fits nowhere."""
    return _over(as_bytes(text, binary), _checker(plain(x)), "int", pa.int32())


def error_location(text: Column | str, x: Regex | str, *, binary: bool = False) -> Column:
    """Null for a match, else struct(byte, line, col) in bytes; the byte is null at an unexpected end."""
    checker = _checker(plain(x))

    def make() -> Callable:
        check = checker()

        def one(data: bytes) -> dict | None:
            found = location(data, check(data))
            return found and dict(zip(("byte", "line", "col"), found, strict=True))

        return one

    kind = pa.struct([("byte", pa.int16()), ("line", pa.int64()), ("col", pa.int64())])
    return _over(as_bytes(text, binary), make, "struct<byte: smallint, line: bigint, col: bigint>", kind)


def run(text: Column | str, x: Regex | str, *, state: int = 1, start: int = 1, is_eof: bool = True, guards: Mapping[str, Callable] | None = None, escape: Iterable[str] = (), binary: bool = False, unambiguous: bool = True) -> Column:
    """struct(status, state, position, events) of a run; events are struct(pos, action) in the order they ran."""
    machine = compiled(expression(x), unambiguous)
    given = dict(guards or {})
    if machine.guards != set(given):
        raise RegexError(f"preconditions {sorted(machine.guards)} need functions, and those given are {sorted(given)}")
    stops = frozenset(escape)
    if not stops <= machine.actions:
        raise RegexError(f"{sorted(stops - machine.actions)} are no actions of the expression")

    def make() -> Callable:
        program = Program(machine)

        def one(data: bytes) -> dict:
            found = program.run(data, state, start, is_eof=is_eof, guards=given, escape=stops)
            return {"status": found.status, "state": found.state, "position": found.position, "events": [{"pos": p, "action": a} for p, a in found.events]}

        return one

    kind = pa.struct([("status", pa.string()), ("state", pa.int32()), ("position", pa.int64()), ("events", pa.list_(pa.struct([("pos", pa.int64()), ("action", pa.string())])))])
    return _over(as_bytes(text, binary), make, "struct<status: string, state: int, position: bigint, events: array<struct<pos: bigint, action: string>>>", kind)


def status(text: Column | str, x: Regex | str, **options) -> Column:
    """ok, error or incomplete."""
    return run(text, x, **options)["status"]


def trace(text: Column | str, x: Regex | str, *, binary: bool = False) -> Column:
    """Array of struct(byte, state, actions), a row for each byte that fits, and one with a null byte at an accepted end."""
    machine = compiled(expression(x))
    if machine.guards:
        raise RegexError("a trace has nothing to evaluate preconditions with")

    def make() -> Callable:
        program = Program(machine)
        return lambda data: [{"byte": b, "state": s, "actions": a} for b, s, a in program.trace(data)]

    kind = pa.list_(pa.struct([("byte", pa.int16()), ("state", pa.int32()), ("actions", pa.list_(pa.string()))]))
    return _over(as_bytes(text, binary), make, "array<struct<byte: smallint, state: int, actions: array<string>>>", kind)


def translate_bytes(data: Column, table: bytes) -> Column:
    """Each byte replaced by table[byte]: what a machine is to read in its place."""
    if len(table) != 256:
        raise ValueError("a table has 256 bytes")
    return _over(data, lambda: lambda raw: raw.translate(table), "binary", pa.binary())


def part(data: Column, start: int, length: int | None = None) -> Column:
    """A window of a binary column, with 1-based start; it has to lie within the data."""
    end = F.lit(start + length - 1) if length is not None else F.octet_length(data)
    inside = (F.lit(start) >= 1) & (end <= F.octet_length(data))
    return F.when(inside, F.substring(data, start, length if length is not None else 2147483647)).otherwise(F.raise_error(F.lit("a window outside the data")))
