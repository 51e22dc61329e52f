"""Mixing documents to target weights by iterative proportional fitting.

Tokens are added up by cell, a combination of the values of all dimensions (source, language, topic). Raking scales
the cells until the marginal of every dimension has its target shares. A cell's scale times the wanted share of tokens
is its weight, the expected number of times its documents are wanted. A document is drawn at most once, so the
probabilities are raked by themselves, with a bound of 1: the same fitting, in which cells count what they give at a
probability of 1 at most, until the marginals of the *probabilities* have the target shares. Where a value has too few
tokens for its share, all of them are taken and the other values of its dimension share the rest; marginals() tells what
was wanted and what is reached, so targets that contradict each other show. A document is drawn by a hash of its id, so
that a draw can be repeated and does not depend on partitions.

Cells are added up before anything is shuffled. Up to ``LOCAL_CELLS`` of them are fitted on the driver and sent to the
documents; more are fitted by the same rule and joined as distributed tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, remove

#: Cells that are fitted on the driver and broadcast at most.
LOCAL_CELLS = 50_000


@dataclass(frozen=True)
class Target:
    """Wanted shares of a dimension. Values that shares doesn't name divide the rest by their mass to the power of temper.

    temper 1 leaves them as they are, 0 makes them equal.
    """

    shares: dict = field(default_factory=dict)
    temper: float = 1.0

    def of(self, masses: dict) -> dict:
        """Share of each value in masses. Named values that don't occur give their share to the others."""
        named = {v: s for v, s in self.shares.items() if masses.get(v)}
        rest = {v: m**self.temper for v, m in masses.items() if v not in named and m > 0}
        left = max(0.0, 1 - sum(named.values())) if rest else 0.0
        out = named | {v: left * x / sum(rest.values()) for v, x in rest.items()}
        total = sum(out.values())
        return {v: out.get(v, 0.0) / total if total else 0.0 for v in masses}


def n_tokens(text: Column) -> Column:
    """Words of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form; null texts are prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! "), "shouting")
        .when(text.rlike(r"[#$%&*]{3} "), "symbols")
        .when(text.contains("icensed under ") | text.contains("under the MIT License"), "legal")
        .otherwise("prose")
    )


#: Scales beyond this are of cells that targets contradicting each other ask too much of.
MOST = 1e9


def reachable(shares: dict, masses: dict, budget: float) -> dict:
    """Tokens wanted of each value: its share of the budget, or all that it has; the others make up for it."""
    wanted = {v: 0.0 for v in shares}
    open_ = {v for v, s in shares.items() if s > 0}
    left = min(budget, sum(masses[v] for v in open_))
    while open_:
        total = sum(shares[v] for v in open_)
        over = {v for v in open_ if left * shares[v] / total >= masses[v]}
        if not over:
            return wanted | {v: left * shares[v] / total for v in open_}
        for v in over:
            wanted[v] = float(masses[v])
            left -= masses[v]
        open_ -= over
    return wanted


def rake(values: list[np.ndarray], mass: np.ndarray, wanted: list[np.ndarray], rounds: int, tolerance: float, bound: float = math.inf) -> np.ndarray:
    """A scale of each cell, bound at most: values[d] numbers the cells' values of dimension d, wanted[d] has their tokens."""
    scale, total = np.ones(len(mass)), max(w.sum() for w in wanted) or 1.0
    for _ in range(rounds):
        worst = 0.0
        for codes, tokens in zip(values, wanted, strict=True):
            now = np.bincount(codes, mass * np.minimum(bound, scale), len(tokens))
            worst = max(worst, np.abs(now - tokens).max() / total)
            scale = np.minimum(MOST, scale * np.divide(tokens, now, out=np.zeros(len(now)), where=now > 0)[codes])
        if worst < tolerance:
            break
    return np.minimum(bound, scale)


def weights(docs: DataFrame, targets: dict[str, Target], share: float, rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """(dimensions, weight, probability) for each cell of docs, which has the dimensions and n_tokens as columns."""
    spark = docs.sparkSession
    dims = list(targets)
    cells = materialize(docs.groupBy(*dims).agg(F.sum("n_tokens").cast("double").alias("mass")), "cells")
    if cells.count() > LOCAL_CELLS:
        return _distributed(cells, targets, share, rounds, tolerance)
    rows = sorted((tuple(r) for r in cells.collect()), key=repr)
    mass = np.array([r[-1] for r in rows], float)
    schema = cells.select(*dims).schema.add("weight", "double").add("probability", "double")
    if not len(rows) or not mass.sum():
        return spark.createDataFrame([(*r[:-1], 0.0, 0.0) for r in rows], schema)
    values, free, bounded, budget = [], [], [], share * mass.sum()
    for d, name in enumerate(dims):
        number: dict = {}
        values.append(np.array([number.setdefault(r[d], len(number)) for r in rows]))
        masses = dict(zip(number, np.bincount(values[-1], mass).tolist(), strict=True))
        shares = targets[name].of(masses)
        most = reachable(shares, masses, budget)
        free.append(np.array([shares[v] * budget for v in number]))
        bounded.append(np.array([most[v] for v in number]))
    weight = rake(values, mass, free, rounds, tolerance)
    probability = weight if weight.max() <= 1 else rake(values, mass, bounded, rounds, tolerance, 1.0)
    return F.broadcast(spark.createDataFrame([(*r[:-1], float(w), float(p)) for r, w, p in zip(rows, weight, probability, strict=True)], schema))


def _distributed(cells: DataFrame, targets: dict[str, Target], share: float, rounds: int, tolerance: float) -> DataFrame:
    """weights() by joins of the cells with their marginals. A dimension's marginal may travel to the driver if it has LOCAL_CELLS values at most."""
    dims = list(targets)
    budget = share * (cells.agg(F.sum("mass")).first()[0] or 0.0)
    spark = cells.sparkSession
    tables: dict[str, tuple] = {}
    for d in dims:
        marginal = materialize(cells.groupBy(d).agg(F.sum("mass").alias("m")), "marginal")
        if marginal.count() <= LOCAL_CELLS:
            masses = dict(map(tuple, marginal.collect()))
            shares = targets[d].of(masses)
            most = reachable(shares, masses, budget)
            schema = marginal.select(F.col(d).alias("value")).schema.add("free", "double").add("bounded", "double")
            tables[d] = spark.createDataFrame([(v, shares[v] * budget, most[v]) for v in masses], schema)
        else:
            tables[d] = _wanted(marginal, d, targets[d], budget)
    start = cells.withColumn("scale", F.lit(1.0))
    weight = _raked(start, tables, "free", None, budget, rounds, tolerance)
    if (weight.agg(F.max("scale")).first()[0] or 0.0) <= 1:
        return weight.select(*dims, F.col("scale").alias("weight"), F.col("scale").alias("probability"))
    bounded = _raked(start, tables, "bounded", 1.0, budget, rounds, tolerance)
    joined = weight.alias("w").join(bounded.alias("b"), reduce(Column.__and__, [F.col(f"w.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dims]))
    return joined.select(*[F.col(f"w.{d}").alias(d) for d in dims], F.col("w.scale").alias("weight"), F.least(F.lit(1.0), "b.scale").alias("probability"))


def _wanted(marginal: DataFrame, d: str, target: Target, budget: float) -> DataFrame:
    """(value, free, bounded) of a dimension with more values than the driver is sent: reachable() by aggregates."""
    there = {r[0]: r[1] for r in marginal.where(F.col(d).isin([v for v in target.shares if v is not None]) | F.col(d).isNull()).collect() if r[0] in target.shares}
    named = {v: target.shares[v] for v, m in there.items() if m}
    own = F.lit(None).cast("double")
    for v, s in named.items():
        own = F.when(F.col(d).eqNullSafe(F.lit(v)), F.lit(float(s))).otherwise(own)
    rest = marginal.withColumn("own", own).withColumn("power", F.when(F.col("own").isNull() & (F.col("m") > 0), F.pow("m", F.lit(target.temper))).otherwise(0.0))
    powers = rest.agg(F.sum("power")).first()[0] or 0.0
    left = max(0.0, 1 - sum(named.values())) if powers else 0.0
    every = sum(named.values()) + left or 1.0
    shares = materialize(rest.select(F.col(d).alias("value"), "m", ((F.coalesce("own", F.lit(0.0)) + (F.col("power") * (left / powers) if powers else F.lit(0.0))) / every).alias("share"), F.lit(False).alias("over")), "shares")
    left = min(budget, shares.where("share > 0").agg(F.sum("m")).first()[0] or 0.0)
    while True:  # each time at least one value more is taken whole
        total, taken = shares.agg(F.sum(F.when(~F.col("over"), F.col("share"))), F.sum(F.when(F.col("over"), F.col("m")))).first()
        each = (left - (taken or 0.0)) / total if total else 0.0
        now = shares.withColumn("over", F.col("over") | ((F.col("share") > 0) & (F.col("share") * each >= F.col("m"))))
        if not now.where("over").count() > shares.where("over").count():
            return materialize(shares.select("value", (F.col("share") * budget).alias("free"), F.when(F.col("over"), F.col("m")).otherwise(F.col("share") * each).alias("bounded")), "wanted")
        shares = materialize(now, "shares")


def _raked(now: DataFrame, tables: dict[str, DataFrame], wanted: str, bound: float | None, budget: float, rounds: int, tolerance: float) -> DataFrame:
    """rake() of (dimensions, mass, scale)."""
    dims, before = list(tables), None
    scale = F.col("scale") if bound is None else F.least(F.lit(bound), F.col("scale"))
    for _ in range(rounds):
        worst = F.lit(0.0)
        for d in dims:
            given = tables[d].select(F.col("value").alias("value2"), F.col(wanted).alias("tokens"))
            marginal = now.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("mass") * scale).alias("now")).join(given, F.col("value").eqNullSafe(F.col("value2"))).drop("value2")
            joined = now.join(marginal, now[d].eqNullSafe(marginal["value"]))
            off = [c for c in now.columns if c.startswith("off_")]
            changed = F.when(F.col("now") > 0, F.least(F.lit(MOST), F.col("scale") * F.col("tokens") / F.col("now"))).otherwise(0.0)
            now = joined.select(*dims, "mass", changed.alias("scale"), *off, F.abs(F.col("now") - F.col("tokens")).alias(f"off_{d}"))
        now = materialize(now, "raked")
        worst = now.agg(F.max(F.greatest(*[F.col(f"off_{d}") for d in dims]) if len(dims) > 1 else F.max(f"off_{dims[0]}"))).first()[0]
        now = now.select(*dims, "mass", "scale")
        if before is not None:
            remove(before)
        before = now
        if (worst or 0.0) < tolerance * (budget or 1.0):
            break
    return now


def marginals(mixed: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """(dimension, value, tokens, expected, drawn) of what mix() gave: tokens there are, expected by the probabilities, and drawn."""
    parts = []
    for name in targets:
        sums = mixed.groupBy(F.col(f"mix_{name}").cast("string").alias("value")).agg(F.sum("mix_tokens").alias("tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("expected"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0)).alias("drawn"))
        parts.append(sums.select(F.lit(name).alias("dimension"), "value", "tokens", "expected", "drawn"))
    return reduce(DataFrame.union, parts)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, dims: dict[str, Callable | None], targets: dict[str, Target], share: float = 0.5, seed: int = 17) -> DataFrame:
    """docs with mix_tokens, mix_weight, mix_probability and mix_kept.

    dims: for each dimension None, if docs has a column of that name, or what makes it from the text. share: of all tokens that are expected in the sample. Documents without
    tokens (null or empty texts) have the weight of their cell, 0 where the cell has no tokens at all. Null values of
    a dimension are a value of their own. Rows that share an id are drawn together, those without an id too. The
    columns of docs stay as they are, but for columns of those names; an empty table gives no rows.
    """
    inner = {f"mix_{name}": make(F.col("text")) if make else F.col(name) for name, make in dims.items()}
    read = docs.withColumns(inner | {"mix_tokens": n_tokens(F.col("text"))})
    by_inner = {f"mix_{name}": target for name, target in targets.items()}
    found = weights(read.select(*by_inner, F.col("mix_tokens").alias("n_tokens")), by_inner, share)
    own = {c: fresh(f"cell_{c}", docs) for c in found.columns}
    renamed = found.toDF(*own.values())
    same = None
    for name in by_inner:
        one = F.col(name).eqNullSafe(F.col(own[name]))
        same = one if same is None else same & one
    joined = read.join(renamed, same, "left").withColumns({"mix_weight": F.coalesce(own["weight"], F.lit(0.0)), "mix_probability": F.coalesce(own["probability"], F.lit(0.0))})
    joined = joined.withColumn("mix_kept", uniform(F.col("doc_id"), seed) < F.col("mix_probability"))
    return joined.drop(*own.values())


#: The mix of the query and the pipeline. Dimensions: a column of that name, or what makes one from the text.
DIMENSIONS: dict[str, Callable | None] = {"source": None, "lang": None, "topic": topic}
#: What it is raked to: sources evened out, languages and topics by fixed shares. Both leave 0.04 to values that they
#: don't name, null included; where none occurs, the named ones divide it in proportion.
TARGETS = {
    "source": Target(temper=0.5),
    "lang": Target({"en": 0.48, "de": 0.192, "fr": 0.192, "es": 0.096}),
    "topic": Target({"prose": 0.8, "table": 0.08, "legal": 0.08}),
}
#: Share of the tokens that the sample keeps.
SHARE = 0.5
