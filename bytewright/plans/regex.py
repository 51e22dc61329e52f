"""Regular expressions over bytes: an immutable syntax tree, its parser and its algebra.

The dialect: literals (a character beyond ASCII is the sequence of its UTF-8 bytes), ``.`` (any byte), classes
``[a-z]`` and ``[^a-z]``, groups, ``|`` alternation and ``* + ?`` repetition. Intersection, difference and negation are
written with the algebra: ``a & b``, ``a - b``, ``~a``. A match is always of the whole input. ``^ $ { }`` are literals
outside classes. There are no captures, lazy quantifiers, look-arounds or flags. Stricter than a lenient reading:
classes that aren't closed, ranges that run backwards, classes without bytes and empty branches are errors.

Nodes carry actions (on entering, leaving, each byte, the last byte) and preconditions. Every method returns a new
node, so expressions can be shared freely.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from .byteset import ByteSet

#: Escapes of single control bytes.
ESCAPES = {"a": 0x07, "b": 0x08, "t": 0x09, "n": 0x0A, "v": 0x0B, "r": 0x0D, "f": 0x0C, "0": 0x00}
#: Characters that a backslash makes literal.
META = frozenset(".*+?()[]\\|-^")
ACTION_KINDS = ("enter", "exit", "final", "all")


class RegexError(ValueError):
    """A pattern that isn't in the dialect, or a use of one that has no meaning."""


@dataclass(frozen=True)
class Regex:
    """kind: set, cat, alt, rep, rep1, opt, isec, diff or neg. args: the operands; of a set, its ByteSet."""

    kind: str
    args: tuple = ()
    actions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    guards_enter: tuple[tuple[str, bool], ...] = ()
    guards_all: tuple[tuple[str, bool], ...] = ()

    def __mul__(self, other: Regex | str) -> Regex:
        return cat(self, other)

    def __rmul__(self, other: str) -> Regex:
        return cat(other, self)

    def __or__(self, other: Regex | str) -> Regex:
        return alt(self, other)

    def __and__(self, other: Regex | str) -> Regex:
        return Regex("isec", (self, as_regex(other)))

    def __sub__(self, other: Regex | str) -> Regex:
        return Regex("diff", (self, as_regex(other)))

    def __invert__(self) -> Regex:
        return Regex("neg", (self,))

    def on(self, kind: str, *names: str) -> Regex:
        """Add actions: kind is enter, exit, final or all. A kind that is there already is replaced."""
        if kind not in ACTION_KINDS:
            raise RegexError(f"unknown action kind {kind!r}; there are {', '.join(ACTION_KINDS)}")
        return replace(self, actions=(*[a for a in self.actions if a[0] != kind], (kind, tuple(names))))

    def on_enter(self, *names: str) -> Regex:
        """Run with the first byte."""
        return self.on("enter", *names)

    def on_exit(self, *names: str) -> Regex:
        """Run with the first byte behind, or at an accepted end of input."""
        return self.on("exit", *names)

    def on_final(self, *names: str) -> Regex:
        """Run with the last byte; an error if it can't be known to be the last."""
        return self.on("final", *names)

    def on_all(self, *names: str) -> Regex:
        """Run with every byte inside."""
        return self.on("all", *names)

    def guard(self, name: str, *, when: str = "enter", value: bool = True) -> Regex:
        """A precondition for entering, or for every byte (when="all"). Each name has one value."""
        if when not in ("enter", "all"):
            raise RegexError("a precondition holds when='enter' or when='all'")
        field = "guards_enter" if when == "enter" else "guards_all"
        if dict(self.guards_enter + self.guards_all).get(name, value) != value:
            raise RegexError(f"the precondition {name!r} is wanted both true and false")
        return replace(self, **{field: (*getattr(self, field), (name, value))})

    def without_actions(self) -> Regex:
        return replace(self, args=tuple(a.without_actions() if isinstance(a, Regex) else a for a in self.args), actions=())

    def has_guards(self) -> bool:
        return bool(self.guards_enter or self.guards_all) or any(isinstance(a, Regex) and a.has_guards() for a in self.args)

    def has_actions(self) -> bool:
        return bool(self.actions) or any(isinstance(a, Regex) and a.has_actions() for a in self.args)

    def with_newline_action(self, name: str = "newline") -> Regex:
        """The same language, in which every byte \\n runs the action."""
        if self.kind == "set":
            newline, rest = self.args[0] & ByteSet([0x0A]), self.args[0] - ByteSet([0x0A])
            if not newline:
                return self
            marked = Regex("set", (newline,)).on_enter(name)
            inner = Regex("alt", (Regex("set", (rest,)), marked)) if rest else marked
            return replace(self, kind="cat", args=(inner,))
        return replace(self, args=tuple(a.with_newline_action(name) for a in self.args))


def byte_set(members: ByteSet | Iterable[int]) -> Regex:
    found = members if isinstance(members, ByteSet) else ByteSet(members)
    if not found:
        raise RegexError("a set without bytes matches nothing")
    return Regex("set", (found,))


def byte(value: int) -> Regex:
    return byte_set([value])


def byte_range(low: int, high: int) -> Regex:
    return byte_set(ByteSet.span(low, high))


def literal(value: str | bytes) -> Regex:
    """The bytes of a string one after the other."""
    data = value.encode() if isinstance(value, str) else bytes(value)
    return Regex("cat", tuple(byte(b) for b in data))


def as_regex(value: Regex | str | bytes) -> Regex:
    return value if isinstance(value, Regex) else literal(value)


def cat(*parts: Regex | str) -> Regex:
    return Regex("cat", tuple(map(as_regex, parts)))


def alt(first: Regex | str, *others: Regex | str) -> Regex:
    return Regex("alt", (as_regex(first), *map(as_regex, others)))


def rep(x: Regex | str) -> Regex:
    return Regex("rep", (as_regex(x),))


def rep1(x: Regex | str) -> Regex:
    return Regex("rep1", (as_regex(x),))


def opt(x: Regex | str) -> Regex:
    return Regex("opt", (as_regex(x),))


def isec(a: Regex | str, b: Regex | str) -> Regex:
    return as_regex(a) & b


def diff(a: Regex | str, b: Regex | str) -> Regex:
    return as_regex(a) - b


def neg(a: Regex | str) -> Regex:
    return ~as_regex(a)


def any_byte() -> Regex:
    return Regex("set", (ByteSet.all(),))


def ascii_byte() -> Regex:
    return byte_range(0x00, 0x7F)


def space() -> Regex:
    """Tab, newline, vertical tab, form feed, carriage return or blank."""
    return byte_set([*range(0x09, 0x0E), 0x20])


EMPTY = Regex("cat")


class _Parser:
    """Recursive descent over the characters of a pattern.

    Loosest first: alternation, concatenation, and repetitions, which bind to the item in front and may be stacked.
    """

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def fail(self, why: str) -> RegexError:
        return RegexError(f"{why} at {self.at} in {self.text!r}")

    def parse(self) -> Regex:
        if not self.text:
            return EMPTY
        found = self.alternation()
        if self.at < len(self.text):
            raise self.fail("an unmatched parenthesis")
        return found

    def alternation(self) -> Regex:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Regex("alt", tuple(parts))

    def sequence(self) -> Regex:
        parts = []
        while self.at < len(self.text) and self.peek() not in "|)":
            parts.append(self.item())
        if not parts:
            raise self.fail("an operand is missing")
        return parts[0] if len(parts) == 1 else Regex("cat", tuple(parts))

    def item(self) -> Regex:
        found = self.atom()
        while self.peek() and self.peek() in "*+?":
            found = {"*": rep, "+": rep1, "?": opt}[self.peek()](found)
            self.at += 1
        return found

    def atom(self) -> Regex:
        c = self.peek()
        if c == "(":
            self.at += 1
            found = self.alternation()
            if self.peek() != ")":
                raise self.fail("a parenthesis isn't closed")
            self.at += 1
            return found
        if c == "[":
            return self.char_class()
        if c in "*+?":
            raise self.fail("nothing to repeat")
        self.at += 1
        if c == ".":
            return any_byte()
        if c == "\\" and self.at < len(self.text):
            return byte(self.escape())
        data = c.encode()
        return byte(data[0]) if len(data) == 1 else literal(data)

    def escape(self) -> int:
        """The byte of an escape whose backslash has been read."""
        c = self.peek()
        self.at += 1
        if c == "x":
            digits = self.text[self.at : self.at + 2]
            if len(digits) < 2 or any(d not in "0123456789abcdefABCDEF" for d in digits):
                raise self.fail("two hexadecimal digits are missing")
            self.at += 2
            return int(digits, 16)
        if c in ESCAPES:
            return ESCAPES[c]
        if c in META:
            return ord(c)
        raise self.fail(f"unknown escape \\{c}")

    def char_class(self) -> Regex:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        if self.peek() == "]":
            raise self.fail("an empty class")
        found = ByteSet()
        while self.peek() != "]":
            low = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self.at += 1
                high = self.member()
                if low > high:
                    raise self.fail("a range that runs backwards")
                found = found | ByteSet.span(low, high)
            else:
                found = found | ByteSet([low])
        self.at += 1
        if negated:
            found = ~found
        if not found:
            raise self.fail("a class without bytes")
        return Regex("set", (found,))

    def member(self) -> int:
        c = self.peek()
        if not c:
            raise self.fail("a class isn't closed")
        self.at += 1
        if c == "\\":
            if not self.peek():
                raise self.fail("a class isn't closed")
            return self.escape()
        if ord(c) > 0x7F:
            raise self.fail(f"{c!r} is more than one byte and can't be in a class")
        return ord(c)


def rx(pattern: str) -> Regex:
    """Parse a pattern."""
    return _Parser(pattern).parse()
