"""Tokenizers: one row for each token of a text."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bytewright.functions.columns import expression, plain
from bytewright.functions.runtime import TokenProgram
from bytewright.plans.automata import Machine, compile_regex
from bytewright.plans.native import is_deterministic, is_regular, java_pattern, nullable
from bytewright.plans.regex import Regex, alt

_PREFIX = "token "
#: Tokens, and about how many bytes of text, that a task holds at a time beside the batch that it reads.
BLOCK, BLOCK_BYTES = 20_000, 1 << 20


class Tokenizer:
    """Longest match; of equally long tokens the last one listed. Number 0 is the error token.

    tokens: expressions, or (name, expression) pairs. unambiguous: refuse tokens that match the same input.
    """

    def __init__(self, tokens: Sequence[Regex | str] | Sequence[tuple[str, Regex | str]], error: str = "error", *, unambiguous: bool = False) -> None:
        pairs = [t if isinstance(t, tuple) else (None, t) for t in tokens]
        if not pairs:
            raise ValueError("a tokenizer needs a token")
        self.names = None if all(n is None for n, _ in pairs) else [error, *(n for n, _ in pairs)]
        if self.names and (None in self.names or len(set(self.names)) < len(self.names)):
            raise ValueError("each token, the error included, needs a name of its own")
        self.expressions = [plain(expression(x)) for _, x in pairs]
        self.unambiguous = unambiguous

    @cached_property
    def machine(self) -> Machine:
        marks = [f"{_PREFIX}{i}" for i in range(1, len(self.expressions) + 1)]
        marked = [x.on_final(m) for x, m in zip(self.expressions, marks, strict=True)]
        return compile_regex(alt(*marked), unambiguous=self.unambiguous, orders={m: 1000 + i for i, m in enumerate(marks)}, may_loop=frozenset(marks))

    @cached_property
    def quick(self) -> bytes | None:
        """A pattern with a group for each token, where tokens begin with different bytes and are deterministic."""
        seen = 0
        for x in self.expressions:
            if not is_regular(x) or not is_deterministic(x) or nullable(x):
                return None
            first = 0
            for e in compile_regex(x).edges:
                if e.source == 1:
                    first |= e.labels.mask
            if seen & first:
                return None
            seen |= first
        return "|".join(f"({java_pattern(x)})" for x in self.expressions).encode("ascii")

    def program(self) -> TokenProgram:
        return TokenProgram(self.machine, _PREFIX, self.quick)

    def tokens(self, data: bytes | str) -> list[tuple[int, int, int | str]]:
        found = self.program().tokens(data.encode() if isinstance(data, str) else data)
        return [(s, n, self.names[t] if self.names else t) for s, n, t in found]


def tokenize(df: DataFrame, text: str, tokenizer: Tokenizer, keys: Iterable[str] = (), *, texts: bool = False) -> DataFrame:
    """(keys..., seq, start, len, token[, piece]), a row for each token; null and empty texts have none.

    Positions and lengths are in bytes; seq numbers a text's tokens from 1. piece is the token's bytes as text, with a
    replacement character where a token cuts a character in two.
    """
    kept, machine, names, quick = list(keys), tokenizer.machine, tokenizer.names, tokenizer.quick
    if taken := {k.lower() for k in kept} & {"seq", "start", "len", "token", "piece"}:
        raise ValueError(f"rename the keys {sorted(taken)}: tokens have columns of those names")
    source = df.select(*kept, F.col(text).cast("binary").alias("text"))
    schema = source.select(*kept).schema.add("seq", "integer").add("start", "long").add("len", "integer").add("token", "string" if names else "integer")
    if texts:
        schema = schema.add("piece", "string")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = TokenProgram(machine, _PREFIX, quick)
        label = pa.array(names) if names else None
        while (batch := next(batches, None)) is not None:
            for owner, *found, piece in _blocks(program, batch.column(len(kept)), texts):
                seq, start, n, token = map(pa.array, found)
                columns = [batch.column(i).take(pa.array(owner)) for i in range(len(kept))]
                columns += [seq, start, n, label.take(token) if names else token]
                if texts:
                    columns.append(piece)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                del owner, found, piece, seq, start, n, token, columns
            del batch  # before the next one comes

    return source.mapInArrow(rows, schema)


def _blocks(program: TokenProgram, column: pa.Array, texts: bool) -> Iterator[tuple]:
    """(owner, seq, start, len, token, piece) of the tokens of a column, at most BLOCK of them at a time.

    A long text is cut between tokens, and a block ends with the text that takes it to BLOCK_BYTES.
    """
    ends, tokens = array("q"), array("i")
    parts: list[tuple[int, int, int, int]] = []  # row, its first token in the block, seq and end of the token before
    held: list[bytes] = []
    size = 0

    def made() -> tuple:
        nonlocal size
        end, token = np.array(ends, np.int64), np.array(tokens, np.int32)
        row, first, before, at = np.array(parts, np.int64).T
        n = np.diff(first, append=len(end))
        start = np.empty_like(end)
        start[1:] = end[:-1]
        some = n > 0  # a text that took up a whole block leaves none to the next
        start[first[some]] = at[some]
        seq = np.arange(1, len(end) + 1) - np.repeat(first - before, n)
        piece = None
        if texts:
            offsets = np.zeros(len(end) + 1, np.int32)
            np.cumsum(end - start, out=offsets[1:])
            piece = _decoded(pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(held))]))
        out = np.repeat(row, n), seq.astype(np.int32), start + 1, (end - start).astype(np.int32), token, piece
        del ends[:], tokens[:], parts[:], held[:]
        size = 0
        return out

    for i in range(len(column)):
        data = column[i].as_py()
        if not data:
            continue
        cut = seq = 0  # end and number of the token that ended the last block
        parts.append((i, len(ends), seq, cut))
        for end, token in program.ends(data):
            ends.append(end)
            tokens.append(token)
            if len(ends) == BLOCK:
                seq += BLOCK - parts[-1][1]
                held.append(data[cut:end])
                cut = end
                yield made()
                parts.append((i, 0, seq, cut))
        if cut < len(data):
            held.append(data[cut:])
            size += len(data) - cut
        if size >= BLOCK_BYTES:
            yield made()
    if ends:
        yield made()


def _decoded(pieces: pa.Array) -> pa.Array:
    try:
        return pieces.cast(pa.string())
    except pa.ArrowInvalid:  # a token cuts a character in two, or the bytes are no text
        return pa.array([x.decode("utf-8", "replace") for x in pieces.to_pylist()], pa.string())
