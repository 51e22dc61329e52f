"""Running machines over bytes in executors. Nothing here needs Spark.

Positions are 1-based bytes. A run ends ok (state 0), in an error (minus the state, at the byte that fits nowhere) or
incomplete (the state, beyond the last byte).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator, Iterable, Iterator, Mapping
from typing import NamedTuple

from bytewright.plans.automata import Machine

OK, ERROR, INCOMPLETE = "ok", "error", "incomplete"


class Outcome(NamedTuple):
    status: str
    state: int
    position: int
    events: list[tuple[int, str]]


def class_pattern(mask: int) -> bytes:
    """A Python byte class for the members of a mask."""
    return b"[" + b"".join(b"\\x%02x" % b for b in range(256) if mask >> b & 1) + b"]"


class Program:
    """Tables of a machine. Bytes on which a state stays where it is without doing anything are skipped at C speed."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        n = machine.n_states
        self.guarded = bool(machine.guards)
        self.moves: list[list] = [[None] * 256 for _ in range(n + 1)]
        self.skip: list[Callable | None] = [None] * (n + 1)
        still = [0] * (n + 1)
        for e in machine.edges:
            for b in e.labels:
                row = self.moves[e.source]
                if self.guarded:
                    row[b] = (row[b] or ()) + ((e.guards, e.target, e.actions),)
                else:
                    row[b] = (e.target, e.actions)
            if e.source == e.target and not e.actions and not e.guards:
                still[e.source] |= e.labels.mask
        for s, mask in enumerate(still):
            if mask:
                self.skip[s] = re.compile(class_pattern(mask) + b"*+").match
        self.finals, self.eof = machine.finals, machine.eof_actions

    def run(self, data: bytes, state: int = 1, start: int = 1, *, is_eof: bool = True, guards: Mapping[str, Callable] | None = None, row=None, escape: frozenset[str] = frozenset()) -> Outcome:
        """Run from a state and a position. guards: name to a function of (position, byte, row).

        escape: actions behind whose byte the run stops, as if more input were to come.
        """
        events: list[tuple[int, str]] = []
        p, end, moves, skips = start - 1, len(data), self.moves, self.skip
        while p < end:
            skip = skips[state]
            if skip:
                p = skip(data, p).end()
                if p == end:
                    break
            move = moves[state][data[p]]
            if self.guarded and move is not None:
                move = next(((t, a) for g, t, a in move if all(bool(guards[name](p + 1, data[p], row)) == value for name, value in g)), None)
            if move is None:
                return Outcome(ERROR, -state, p + 1, events)
            state, actions = move
            p += 1
            if actions:
                events += [(p, a) for a in actions]
                if escape and not escape.isdisjoint(actions):
                    return Outcome(INCOMPLETE, state, p + 1, events)
        if is_eof and state in self.finals:
            events += [(p + 1, a) for a in self.eof.get(state, ())]
            return Outcome(OK, 0, p + 1, events)
        return Outcome(INCOMPLETE, state, p + 1, events)

    def first_error(self, data: bytes) -> int | None:
        """None for a match, 0 for an unexpected end, else the position of the first byte that fits nowhere."""
        found = self.run(data)
        return None if found.status == OK else 0 if found.status == INCOMPLETE else found.position

    def trace(self, data: bytes) -> list[tuple[int | None, int, list[str]]]:
        """(byte, state after it, actions) for each byte that fits; at an accepted end (None, 0, actions)."""
        out: list[tuple[int | None, int, list[str]]] = []
        state = 1
        for b in data:
            move = self.moves[state][b]
            if move is None:
                return out
            state, actions = move
            out.append((b, state, list(actions)))
        if state in self.finals:
            out.append((None, 0, list(self.eof.get(state, ()))))
        return out

    def state_map(self, data: bytes) -> list[int]:
        """Where each state 0..n ends after data (0 is the failed state): maps of chunks compose in any grouping."""
        return [0, *(max(0, self._blind(data, s)) for s in range(1, self.machine.n_states + 1))]

    def _blind(self, data: bytes, state: int) -> int:
        found = self.run(data, state, is_eof=False)
        return found.state


def location(data: bytes, error: int | None) -> tuple[int | None, int, int] | None:
    """(byte, line, column) of what first_error() gave, in bytes. At the end of input the byte is None and the column
    is the bytes behind the last newline. The column of a newline that fits nowhere is 0, on the line that it begins."""
    if error is None:
        return None
    p = error - 1 if error else len(data)
    byte = data[p] if error else None
    if byte == 0x0A:
        return byte, data.count(b"\n", 0, p + 1) + 1, 0
    last = data.rfind(b"\n", 0, p)
    column = p - last if error else p - last - 1
    return byte, data.count(b"\n", 0, p) + 1, column


class TokenProgram:
    """A tokenizer: at each place the longest token, of equally long ones the last one listed.

    Bytes that begin no token are one error token together; so is all that is left if a token that began there isn't
    complete at the end.
    """

    def __init__(self, machine: Machine, prefix: str, quick: bytes | None = None) -> None:
        """quick: a pattern with a group for each token, if tokens begin with different bytes and never have to give
        back what they read; it finds tokens at C speed."""
        self.quick = re.compile(quick, re.S).finditer if quick else None
        self.moves: list[list] = [[None] * 256 for _ in range(machine.n_states + 1)]
        still: dict[int, dict[int, int]] = {}
        for e in machine.edges:
            token = max((int(a[len(prefix) :]) for a in e.actions if a.startswith(prefix)), default=0)
            for b in e.labels:
                self.moves[e.source][b] = (e.target, token)
            if e.source == e.target:
                by = still.setdefault(e.source, {})
                by[token] = by.get(token, 0) | e.labels.mask
        self.skip: list[tuple[Callable, int] | None] = [None] * (machine.n_states + 1)
        for s, by in still.items():
            token, mask = max(by.items(), key=lambda x: x[1].bit_count())
            self.skip[s] = re.compile(class_pattern(mask) + b"++").match, token
        starts = 0
        for b in range(256):
            if self.moves[1][b] is not None:
                starts |= 1 << b
        self.nowhere = re.compile(class_pattern(~starts & ((1 << 256) - 1)) + b"*+").match if starts != (1 << 256) - 1 else None

    def tokens(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, length, token) with the number of the token from 1 on, 0 for errors."""
        return _spans(self.ends(data))

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(end, token) of one token after the other, each of which begins where the last one ended; nothing is kept."""
        at = (yield from self._by_pattern(data)) if self.quick else 0
        if at < len(data):
            yield from self._by_machine(data, at)

    def _quickly(self, data: bytes) -> list[tuple[int, int, int]] | None:
        """Tokens by the pattern alone, or None where it doesn't reach the end."""
        out = list(_spans(self._by_pattern(data)))
        return out if sum(n for _, n, _ in out) == len(data) else None

    def _stepwise(self, data: bytes) -> list[tuple[int, int, int]]:
        """Tokens by the machine alone."""
        return list(_spans(self._by_machine(data, 0)))

    def _by_pattern(self, data: bytes) -> Generator[tuple[int, int], None, int]:
        """Returns the end of the last token before one begins that doesn't end: what is an error from there on, the machine says."""
        at = 0
        for m in self.quick(data):
            start, end = m.span()
            if start > at:
                if self.nowhere is None or self.nowhere(data, at, start).end() < start:
                    return at
                yield start, 0
            yield end, m.lastindex
            at = end
        if at < len(data):
            if self.nowhere is None or self.nowhere(data, at).end() < len(data):
                return at
            yield len(data), 0
        return len(data)

    def _by_machine(self, data: bytes, begin: int) -> Iterator[tuple[int, int]]:
        moves, skips, end = self.moves, self.skip, len(data)
        at = begin  # where a token is tried; begin is where an error began
        while at < end:
            state, p, token, stop = 1, at, 0, 0
            while p < end:
                skip = skips[state]
                if skip:
                    found = skip[0](data, p)
                    if found:
                        p = found.end()
                        if skip[1]:
                            token, stop = skip[1], p
                        continue
                move = moves[state][data[p]]
                if move is None:
                    break
                state = move[0]
                p += 1
                if move[1]:
                    token, stop = move[1], p
            if token:
                if begin < at:
                    yield at, 0
                yield stop, token
                begin = at = stop
            elif p >= end:
                at = end
            else:
                at += 1
                if self.nowhere:
                    at = self.nowhere(data, at).end()
        if begin < end:
            yield end, 0


def _spans(ends: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    start = 0
    for end, token in ends:
        yield start + 1, end - start, token
        start = end
