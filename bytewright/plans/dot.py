"""Pictures of automata in the DOT language, and labels of transitions as text."""

from __future__ import annotations

from typing import TYPE_CHECKING

from .byteset import ByteSet

if TYPE_CHECKING:
    from .automata import Machine, Nfa

#: How control bytes are written.
CONTROL = {0x00: "\\0", 0x07: "\\a", 0x08: "\\b", 0x09: "\\t", 0x0A: "\\n", 0x0B: "\\v", 0x0C: "\\f", 0x0D: "\\r"}


def byte_text(b: int) -> str:
    return CONTROL.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\x{b:02x}")


def set_text(labels: ByteSet) -> str:
    """'a' for one byte, [A-Za-z] for several."""
    if len(labels) == 1:
        return f"'{byte_text(labels.min())}'"
    out = ""
    for low, high in labels.ranges():
        out += byte_text(low) + ("-" if high > low + 1 else "") + (byte_text(high) if high > low else "")
    return f"[{out}]"


def edge_text(labels: ByteSet | None, guards: tuple = (), actions: tuple = ()) -> str:
    """The label, then (cond,!cond), then /act1,act2."""
    text = "ϵ" if labels is None else set_text(labels)
    if guards:
        text += "(" + ",".join(("" if value else "!") + name for name, value in guards) + ")"
    return text + ("/" + ",".join(actions) if actions else "")


def eof_text(actions: tuple[str, ...]) -> str:
    return "EOF" + ("/" + ",".join(actions) if actions else "")


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def machine_dot(machine: Machine) -> str:
    lines = ["digraph {", "  graph [ rankdir = LR ];", "  0 [ shape = point ];"]
    lines += [f"  {s} [ shape = {'doublecircle' if s in machine.finals else 'circle'} ];" for s in range(1, machine.n_states + 1)]
    lines.append("  0 -> 1;")
    lines += [f"  {e.source} -> {e.target} [ label = {_quoted(edge_text(e.labels, e.guards, e.actions))} ];" for e in machine.edges]
    if machine.eof_actions:
        lines.append("  eof [ shape = point ];")
        lines += [f"  {s} -> eof [ label = {_quoted(eof_text(a))}, style = dashed ];" for s, a in sorted(machine.eof_actions.items())]
    return "\n".join([*lines, "}"]) + "\n"


def nfa_dot(nfa: Nfa) -> str:
    lines = ["digraph {", "  graph [ rankdir = LR ];", "  s [ shape = point ];"]
    lines += [f"  {n} [ shape = {'doublecircle' if n == nfa.final else 'circle'} ];" for n in range(nfa.size)]
    lines.append(f"  s -> {nfa.start};")

    def ordered(actions: dict[str, int]) -> tuple[str, ...]:
        return tuple(sorted(actions, key=actions.get))

    lines += [f"  {a} -> {b} [ label = {_quoted(edge_text(None, (), ordered(x)))} ];" for a, b, x in nfa.free]
    lines += [f"  {m.source} -> {m.target} [ label = {_quoted(edge_text(ByteSet(mask=m.mask), tuple(m.guards.items()), ordered(m.actions)))} ];" for m in nfa.moves]
    return "\n".join([*lines, "}"]) + "\n"
