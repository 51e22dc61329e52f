"""The engine in SQL: functions and a table function, registered in a session.

    SELECT fsm_match(p_name, '[a-z]+ [a-z]+'), fsm_first_error(p_name, '[a-z]*') FROM part
    SELECT p_partkey, t.* FROM part, LATERAL fsm_tokens(p_name, array('[a-z]+', ' ')) t

Patterns are compiled once in each task. Null texts or patterns give nulls, and no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytewright.functions.runtime import Program, TokenProgram
from bytewright.plans.automata import compile_regex
from bytewright.plans.regex import alt, rx


def _by_pattern(one: Callable, arrow: pa.DataType) -> Callable:
    programs: dict[str, Program] = {}

    def run(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        out = []
        for text, pattern in zip(texts.to_pylist(), patterns.to_pylist(), strict=True):
            if text is None or pattern is None:
                out.append(None)
                continue
            if pattern not in programs:
                programs[pattern] = Program(compile_regex(rx(pattern)))
            out.append(one(programs[pattern], text.encode()))
        return pa.array(out, arrow)

    return run


class Tokens:
    """Rows (seq, start, len, token) of a text."""

    def __init__(self) -> None:
        self.programs: dict[tuple, TokenProgram] = {}

    def eval(self, text: str | None, patterns: list[str] | None) -> Iterator[tuple[int, int, int, int]]:
        if text is None or patterns is None:
            return
        key = tuple(patterns)
        if key not in self.programs:
            marks = [f"token {i}" for i in range(1, len(key) + 1)]
            marked = [rx(p).on_final(m) for p, m in zip(key, marks, strict=True)]
            machine = compile_regex(alt(*marked), unambiguous=False, orders={m: 1000 + i for i, m in enumerate(marks)}, may_loop=frozenset(marks))
            self.programs[key] = TokenProgram(machine, "token ")
        for seq, (start, n, token) in enumerate(self.programs[key].tokens(text.encode()), 1):
            yield seq, start, n, token


def register(spark: SparkSession) -> None:
    """fsm_match, fsm_first_error, fsm_status and fsm_tokens for SQL of this session."""
    spark.udf.register("fsm_match", F.arrow_udf(_by_pattern(lambda p, data: p.first_error(data) is None, pa.bool_()), "boolean"))
    spark.udf.register("fsm_first_error", F.arrow_udf(_by_pattern(lambda p, data: p.first_error(data), pa.int32()), "int"))
    spark.udf.register("fsm_status", F.arrow_udf(_by_pattern(lambda p, data: p.run(data).status, pa.string()), "string"))
    spark.udtf.register("fsm_tokens", F.udtf(Tokens, returnType="seq int, start bigint, len int, token int"))
