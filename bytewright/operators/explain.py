"""Machines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytewright.plans.automata import Machine


def states(spark: SparkSession, machine: Machine) -> DataFrame:
    """(state, is_start, is_final, eof_actions)."""
    rows = [(s, s == 1, s in machine.finals, list(machine.eof_actions.get(s, ()))) for s in range(1, machine.n_states + 1)]
    return spark.createDataFrame(rows, "state int, is_start boolean, is_final boolean, eof_actions array<string>")


def edges(spark: SparkSession, machine: Machine) -> DataFrame:
    """(src, dst, labels, guards, actions, text)."""
    from bytewright.plans.dot import edge_text

    rows = [(e.source, e.target, [[a, b] for a, b in e.labels.ranges()], dict(e.guards), list(e.actions), edge_text(e.labels, e.guards, e.actions)) for e in machine.edges]
    return spark.createDataFrame(rows, "src int, dst int, labels array<array<smallint>>, guards map<string, boolean>, actions array<string>, text string")
