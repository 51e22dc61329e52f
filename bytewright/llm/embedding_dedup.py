"""Near-duplicate embeddings: tiled comparison of PCA-ordered dimensions with early stops.

Equal vectors of a label are collapsed first. Unit vectors are rotated to the principal axes of all vectors, which
leaves cosines as they are and moves most of a vector's length to its leading dimensions. A pair of tiles then
accumulates products over a few leading dimensions; what the others can add is at most the product of the two suffix
norms, and pairs that cannot reach the threshold any more are dropped before the next dimensions. Survivors are
verified with the original components in double precision.

A label's vectors are cut into cells by their two leading coordinates. Unit vectors whose cosine reaches t are at most
sqrt(2 - 2 t) apart, in every coordinate, so cells of that width need their neighbours only; cells with more than
``block`` vectors are split, and each pair of blocks is one bounded group of work, however large a label is. A group
returns sums and a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize

#: Vectors in a block; a group of work has two.
BLOCK = 2048
#: Rows of a tile, which is compared with a whole block at once.
TILE = 256
#: Numbers in the rotations that are sent to executors at most (one has dimension squared). Dimensions beyond them
#: aren't rotated: their own coordinates are taken by falling share of the squares, which bounds and links as exactly.
BASIS_NUMBERS = 4 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: it isn't null, empty or zero, and all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: list) -> np.ndarray:
    rows = np.array(vectors, np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def rotated(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows in other coordinates: axes is a rotation, or an order of the coordinates."""
    return rows @ axes if axes.ndim == 2 else rows[:, axes]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension that occurs the axes (columns) of all its vectors, by falling share of their squares."""
    sizes = sorted(r[0] for r in vectors.select(F.size("vector").alias("d")).distinct().collect())
    whole, left = set(), BASIS_NUMBERS
    for d in sizes:
        left -= d * d
        if left >= 0:
            whole.add(d)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[int, list] = {}
            for v in batch.column(0).to_pylist():
                by.setdefault(len(v), []).append(v)
            for d, own in by.items():
                m = units(own)
                sums[d] = sums.get(d, 0) + (m.T @ m if d in whole else (m * m).sum(axis=0))
        for d, total in sums.items():
            i, j = np.indices(total.shape) if d in whole else (np.arange(d), np.arange(d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["d", "i", "j", "x"])

    found = vectors.select("vector").mapInArrow(run, "d long, i long, j long, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    d, i, j, x = (found.column(c).to_numpy() for c in range(4))
    out = {}
    for size in sizes:
        mine = d == size
        if size not in whole:
            squares = np.zeros(size)
            squares[i[mine]] = x[mine]
            out[size] = np.argsort(-squares, kind="stable")
            continue
        total = np.zeros((size, size))
        total[i[mine], j[mine]] = x[mine]
        out[size] = np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b whose cosine reaches the threshold; within one block those with i < j."""
    slack = 1e-9
    x, y = units(a), units(b)
    p, q = rotated(x, axes), rotated(y, axes)
    d = p.shape[1]
    cuts = [c for c in (4, 8, 16, 32, 64, 128, 256, 512) if c < d] + [d]
    # norms of what follows each cut
    rest = [(np.sqrt((p[:, c:] ** 2).sum(axis=1)), np.sqrt((q[:, c:] ** 2).sum(axis=1))) for c in cuts]
    found = []
    for t in range(0, len(p), TILE):
        rows = slice(t, t + TILE)
        dots = p[rows, : cuts[0]] @ q[:, : cuts[0]].T
        alive = dots + np.outer(rest[0][0][rows], rest[0][1]) >= threshold - slack
        if same:
            alive &= np.arange(t, min(t + TILE, len(p)))[:, None] < np.arange(len(q))[None, :]
        i, j = np.nonzero(alive)
        sums = dots[i, j]
        i = i + t
        for (low, high), (rp, rq) in zip(zip(cuts, cuts[1:]), rest[1:]):
            if not len(i):
                break
            sums = sums + _products(p[:, low:high], q[:, low:high], i, j)
            stays = sums + rp[i] * rq[j] >= threshold - slack
            i, j, sums = i[stays], j[stays], sums[stays]
        exact = _products(x, y, i, j) >= threshold
        found.append((i[exact], j[exact]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, run: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.einsum("nd,nd->n", a[i[k : k + run]], b[j[k : k + run]]) for k in range(0, len(i), run)] or [np.zeros(0)])


def class_links(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(kind, a, b): kind n: b vectors outside the class a are linked to it; kind e: an edge of the classes a and b.

    classes: cid, label, vector, members.
    """
    spark = classes.sparkSession
    send = spark.sparkContext.broadcast(principal_axes(classes))
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches):
        axes = send.value
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            cells = np.zeros((len(vectors), 2), np.int64)
            by: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by.setdefault(len(v), []).append(k)
            for d, own in by.items():
                lead = rotated(units([vectors[k] for k in own]), axes[d][:, :2] if axes[d].ndim == 2 else axes[d][:2])
                cells[own, : lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(v) for v in vectors], pa.int64()), pa.array(cells[:, 0]), pa.array(cells[:, 1])], ["cid", "label", "vector", "members", "d", "u", "v"])

    cell = ["label", "d", "u", "v"]
    placed = materialize(classes.select("cid", "label", "vector", "members").mapInArrow(place, "cid long, label string, vector array<double>, members long, d long, u long, v long"), "placed")
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*cell, "part")
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near = blocks.withColumn("s", F.explode(steps)).select("label", "d", (F.col("u") + F.col("s.x")).alias("u"), (F.col("v") + F.col("s.y")).alias("v"), F.col("u").alias("u1"), F.col("v").alias("v1"), F.col("part").alias("part1"))
    pairs = near.join(blocks, cell).where(F.struct("u1", "v1", "part1") <= F.struct("u", "v", "part"))
    pairs = pairs.withColumn("pair", F.concat_ws(" ", "d", "u1", "v1", "part1", "u", "v", "part", "label"))
    same = F.struct("u1", "v1", "part1") == F.struct("u", "v", "part")
    sides = F.when(same, F.array(F.struct(F.lit(2).alias("side"), "u", "v", "part"))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("u1").alias("u"), F.col("v1").alias("v"), F.col("part1").alias("part")), F.struct(F.lit(1).alias("side"), "u", "v", "part")))
    work = pairs.withColumn("e", F.explode(sides)).select("pair", "label", "d", "e.*")
    parted = placed.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")
    rows = parted.join(work, [*cell, "part"]).select("pair", "side", "cid", "members", "vector")

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        cids, members = group.column("cid").to_numpy(), group.column("members").to_numpy()
        vectors = np.array(group.column("vector").to_pylist(), np.float64)
        first, second = (np.nonzero(side == s)[0] for s in (0, 1)) if side[0] != 2 else (np.arange(len(side)),) * 2
        none = np.zeros(0, np.int64)
        i, j = linked_pairs(vectors[first], vectors[second], send.value[vectors.shape[1]], threshold, side[0] == 2) if len(first) and len(second) else (none, none)
        i, j = first[i], second[j]
        links = np.bincount(i, members[j], len(side)) + np.bincount(j, members[i], len(side))
        order = np.argsort(cids, kind="stable")  # the smallest cid is the root
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = forest(len(order), rank[i], rank[j])
        ends = np.nonzero(root != np.arange(len(root)))[0]
        some = np.nonzero(links)[0]
        kind = ["n"] * len(some) + ["e"] * len(ends)
        a = np.concatenate((cids[some], cids[order][ends]))
        b = np.concatenate((links[some].astype(np.int64), cids[order][root[ends]]))
        return pa.table({"kind": pa.array(kind, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("pair").applyInArrow(compare, "kind string, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null. Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, nor do vectors of different dimensions. Repeated rows are vectors of
    their own and link with each other. A null vec_id never is the smallest of a component unless it is alone there.
    Other columns are not read; an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    label = F.col("label") + F.lit(0.0) if dict(vectors.dtypes)["label"] in ("float", "double") else F.col("label")  # -0.0 equals 0.0
    read = vectors.select("vec_id", vector.alias("vector"), label.cast("string").alias("label"))
    able = usable(F.col("vector")) & F.col("label").isNotNull()
    keyed = read.where(able).withColumn("digest", F.xxhash64("vector"))
    own = ["label", "digest", "vector"]
    classes = keyed.groupBy(*own).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("members"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = materialize(class_links(classes, threshold, block), "class-links")
    counts = found.where("kind = 'n'").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("outside"))
    roots = materialize(connected_components(found.where("kind = 'e'").select("a", "b")), "roots").withColumnRenamed("node", "cid")
    rooted = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(*own, (F.col("members") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id")
    linked = keyed.join(named, own).select("vec_id", "n_links", "component_id")
    alone = read.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
