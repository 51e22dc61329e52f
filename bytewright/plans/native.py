"""Expressions that the JVM's regular expressions can decide without backtracking.

An expression is deterministic if after any input the next byte says which of its positions is next (it is
one-unambiguous; Brüggemann-Klein and Wood 1998). Then a loop need never give back what it took, possessive
quantifiers keep the language, and the JVM neither backtracks nor recurses with the length of the input. Boolean
operators at the top become boolean columns, as matches are of the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .byteset import ByteSet
from .regex import Regex

HIGH = ByteSet.span(0x80, 0xFF)


class _Facts:
    """nullable, first and last positions of an expression; follow sets are gathered aside."""

    def __init__(self, nullable: bool, first: frozenset[int], last: frozenset[int]) -> None:
        self.nullable, self.first, self.last = nullable, first, last


def is_deterministic(x: Regex) -> bool:
    """Whether x, which has no intersection, difference or negation, is one-unambiguous.

    Loops over what may be empty, and alternatives of which several may be, are refused: matchers end a loop at an
    empty turn, and which alternative takes nothing would matter.
    """
    if not _settled(x):
        return False
    labels: list[int] = []
    follow: dict[int, set[int]] = {}
    none: frozenset[int] = frozenset()

    def after(ends: frozenset[int], begins: frozenset[int]) -> None:
        for p in ends:
            follow[p] |= begins

    def facts(y: Regex) -> _Facts:
        if y.kind == "set":
            p = len(labels)
            labels.append(y.args[0].mask)
            follow[p] = set()
            return _Facts(False, frozenset([p]), frozenset([p]))
        if y.kind == "cat":
            out = _Facts(True, none, none)
            for part in map(facts, y.args):
                after(out.last, part.first)
                out = _Facts(out.nullable and part.nullable, out.first | part.first if out.nullable else out.first, out.last | part.last if part.nullable else part.last)
            return out
        if y.kind == "alt":
            parts = list(map(facts, y.args))
            return _Facts(any(p.nullable for p in parts), none.union(*(p.first for p in parts)), none.union(*(p.last for p in parts)))
        part = facts(y.args[0])
        if y.kind in ("rep", "rep1"):
            after(part.last, part.first)
        return _Facts(part.nullable or y.kind != "rep1", part.first, part.last)

    whole = facts(x)

    def disjoint(positions) -> bool:
        seen = 0
        for p in positions:
            if seen & labels[p]:
                return False
            seen |= labels[p]
        return True

    return disjoint(whole.first) and all(map(disjoint, follow.values()))


def _settled(x: Regex) -> bool:
    parts = [a for a in x.args if isinstance(a, Regex)]
    if x.kind in ("rep", "rep1") and nullable(parts[0]) or x.kind == "alt" and sum(map(nullable, parts)) > 1:
        return False
    return all(map(_settled, parts))


def is_regular(x: Regex) -> bool:
    return x.kind in ("set", "cat", "alt", "rep", "rep1", "opt") and all(is_regular(a) for a in x.args if isinstance(a, Regex))


def sets_of(x: Regex) -> list[ByteSet]:
    return [x.args[0]] if x.kind == "set" else [s for a in x.args for s in sets_of(a)]


def java_pattern(x: Regex) -> str:
    """A pattern for texts that have a character for each byte."""
    if x.kind == "set":
        return "[" + "".join(f"\\x{a:02x}" if a == b else f"\\x{a:02x}-\\x{b:02x}" for a, b in x.args[0].ranges()) + "]"
    if x.kind == "cat":
        return "".join(map(java_pattern, x.args))
    if x.kind == "alt":
        # an alternative that takes nothing has to come last
        empty_last = sorted(x.args, key=nullable)
        return "(?:" + "|".join(map(java_pattern, empty_last)) + ")"
    inner = x.args[0]
    quantifier = {"rep": "*+", "rep1": "++", "opt": "?+"}[x.kind]
    return (java_pattern(inner) if inner.kind == "set" else f"(?:{java_pattern(inner)})") + quantifier


def nullable(x: Regex) -> bool:
    if x.kind == "set":
        return False
    if x.kind == "cat":
        return all(map(nullable, x.args))
    if x.kind == "alt":
        return any(map(nullable, x.args))
    return x.kind in ("rep", "opt") or nullable(x.args[0])


def predicate(text: Column, x: Regex, is_binary: bool = False) -> Column | None:
    """A Catalyst predicate for a match of the whole text, or None if there is none."""
    if x.kind in ("isec", "diff", "alt"):
        parts = [predicate(text, a, is_binary) for a in x.args]
        if all(p is not None for p in parts) and (x.kind != "alt" or not (is_regular(x) and is_deterministic(x))):
            out = parts[0]
            for p in parts[1:]:
                out = out & p if x.kind == "isec" else out & ~p if x.kind == "diff" else out | p
            return out
        if x.kind != "alt":
            return None
    if x.kind == "neg":
        part = predicate(text, x.args[0], is_binary)
        return None if part is None else ~part
    if not is_regular(x) or not is_deterministic(x):
        return None
    # characters stand for bytes where no set has bytes beyond ASCII
    plain = not is_binary and all(s.isdisjoint(HIGH) for s in sets_of(x))
    subject = text if plain else F.decode(text.cast("binary"), "ISO-8859-1")
    return subject.rlike(f"\\A{java_pattern(x)}\\z")
