"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose, exact sets decide.

A text is the set of its 5-word shingles (all its words if it has fewer). Texts with equal sets are one node. Each node
is keyed by its bands, runs of minhashes; two nodes whose similarity is 0.8 share none of them with a probability of
(1 - 0.8 ** ROWS) ** BANDS, less than one in ten thousand, and more similar ones more seldom. Nodes that share a key are
compared by their sets, and a link is returned only where the similarity is reached exactly.

Keys with the same nodes are compared once. Keys with many nodes are dealt into parts, and each pair of parts is
compared as one bounded group of work that returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, map_texts, materialize

WIDTH = 5
#: The least similarity, as a fraction.
LEAST = 4, 5
BANDS, ROWS = 24, 5
#: Nodes of a crowded key in a part; a group of work has two.
PART = 1024
#: Shingles that are hashed together.
RUN = 1 << 12

_draw = np.random.default_rng(11)
FLIPS, FACTORS = (_draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; none without words (null, empty, white space)."""
    words = text.lower().split() if text else ()
    n = max(1, len(words) - WIDTH + 1) if words else 0
    found = (xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH]), 42) for i in range(n))
    return np.unique(np.fromiter(found, np.uint64, n))


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes(), 42), "big", signed=True)


def bands(own: np.ndarray) -> list[int]:
    """The keys of a set, one for each band; none of the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), RUN):
        np.minimum(least, ((own[None, i : i + RUN] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return [int.from_bytes(xxhash.xxh64_digest(raw[b * width : (b + 1) * width], b), "big", signed=True) for b in range(BANDS)]


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: each edge is a pair that reaches the similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rest, edges, (num, den) = np.arange(len(sets)), [], LEAST
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = rest[(den * sizes[rest] >= num * sizes[i]) & (den * sizes[i] >= num * sizes[rest])]
            if not len(near):
                continue
            every = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            both = np.add.reduceat(sets[i][at] == every, np.concatenate(([0], np.cumsum(sizes[near])[:-1])), dtype=np.int64)
            hit = near[den * both >= num * (sizes[i] + sizes[near] - both)]
            edges += [(int(i), int(j)) for j in hit]
            frontier += hit.tolist()
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    return edges


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes: all pairs that share a key and reach the similarity are connected by them.

    nodes: (node, rep, keys). texts: (rep, text), at least for the nodes' reps.
    """
    keyed = materialize(nodes.select("node", F.explode("keys").alias("key")), "bands")
    members = met(keyed)
    return crowds(members, sets_of(members.select("node"), nodes, texts))


def met(keyed: DataFrame) -> DataFrame:
    """(key, node, n) of (node, key): the keys of several nodes and how many have them, keys with the same nodes once."""
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    chosen = met.groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key", "n")
    return materialize(keyed.join(chosen, "key"), "members")


def sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) for each distinct node of wanted, of which texts has that of its rep."""
    reps = wanted.distinct().join(nodes.select("node", "rep"), "node")
    read = texts.join(reps, "rep").select("node", "text")
    return materialize(map_texts(read, ["node", "text"], lambda: lambda c: [c[0], [shingles(t).tobytes() for t in c[1]]], "node long, shingles binary"), "shingles")


def crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between nodes that share a key, by pairs of parts."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # a part meets itself and every other part of its key
    rows = members.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node").join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        edges = np.array(linked([np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[edges[:, 0]]), "b": pa.array(node[edges[:, 1]])})

    return groups.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates, as keep_by() has it, proposed by bands of minhashes."""
    return keep_by(docs, lambda n: bands, "array<long>", lambda nodes, texts, n: links(nodes, texts))


def keep_by(docs: DataFrame, marker: Callable, kind: str, propose: Callable) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Of several rows with that id in a component one stays; rows with the same id in distinct components all do. Texts
    without words are copies of each other. Rows whose doc_id is null all stay.

    marker(number of rows): function from a set of shingles to its keys, of the type kind. propose(nodes, texts, number
    of rows): edges (a, b) between nodes, from (node, rep, keys) and (rep, text).
    """
    row = fresh("row_key", docs)
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    n = keyed.count()
    mark = marker(n)

    def step(columns: list[list]) -> list:
        sets = [shingles(t) for t in columns[2]]
        return [columns[0], columns[1], [node_of(s) for s in sets], [mark(s) for s in sets]]

    found = materialize(map_texts(keyed, ["doc_id", row, "text"], lambda: step, f"doc_id long, rep long, node long, keys {kind}"), "nodes")
    named = F.col("doc_id").isNotNull()
    nodes = found.groupBy("node").agg(F.min(F.when(named, F.struct("doc_id", "rep"))).alias("first"), F.min("rep").alias("rep"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "classes")
    roots = materialize(connected_components(propose(nodes, keyed.select(F.col(row).alias("rep"), "text"), n)), "roots")
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = rooted.where("first is not null").select(F.col("first.rep").alias(row)).union(found.where(~named).select(F.col("rep").alias(row)))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)
