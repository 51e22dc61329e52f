"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks.

Fingerprints that differ in at most ``distance`` bits agree in at least ``blocks - distance`` of ``blocks`` blocks.
Each distinct fingerprint is therefore keyed by every choice of that many blocks, equal keys are joined and the Hamming
distance is verified inside the join. Equal fingerprints are collapsed first, so a group of copies of any size is one
row in the join. More blocks give longer keys: their number follows the number of fingerprints, so that by chance a
few share a key, however many there are.

A key that more than ``bucket`` distinct fingerprints share (a large group of near copies) is not joined, as that would
emit a quadratic number of pairs. Its fingerprints are linked exactly in another way. For two bits: fingerprints lie
within two bits of each other if and only if changing at most one bit of each leads to a common value, so each meets the
others at those values. For more bits: the bucket is dealt into parts, each pair of parts is compared as one bounded
group of work, and only a spanning forest of the links is returned.

Sets of 5-word shingles with a similarity of 0.8 differ in 0.15 of the bits of their SimHashes, too many for 64 bits: the
blocks that must agree would be of one or two bits. keep_similar() takes wide fingerprints instead, of a hundred and
more blocks. What differs in fewer bits than there are blocks agrees in one of them for certain; a pair of the least
similarity does with a probability of 1 - MISS. What agrees in a block is compared by the Hamming distance of the
first bits, and what is within that by its shingles. Blocks are read in passes, of which each has its shuffle files to
itself, and pairs are compared in groups to which a text travels once, not once for each of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import connected_components, forest, fresh, give_back, map_texts, materialize, remove, slices

BITS = 64
#: Choices of blocks up to which a pair that several of them find is emitted once only.
FEW = 12
#: Fingerprints of a crowded bucket in a part; a group of work has two.
PART = 4096
#: Shingles whose bits are counted together.
RUN = 1 << 15
#: Differing bits of sets with a similarity of 0.8, as a share: acos(8/9) / pi, and more for sets of few shingles.
SHARE = 0.157
#: The chance that such sets agree in no block.
MISS = 1e-4
#: By chance so many sets share a block's value, as a power of two; more than CROWD of them are compared by parts.
LOAD, CROWD = 3, 32
#: The first bits of a wide fingerprint that are compared (four longs), and how many may differ: 4.5 deviations above the
#: mean of the sets that differ most, those of 5 and 4 shingles (0.1875).
FIRST, NEAR = 256, 76
#: As columns of longs.
_PRINT = [f"x{i}" for i in range(FIRST // BITS)]
#: Blocks whose values are dealt out in one pass.
PASS = 64
#: Pairs that are compared together; they have twice as many sets at most.
PAIRS = 1024
#: Shingles whose bits are counted in bytes.
BYTES = 255

_draw = np.random.default_rng(23)
#: By 64 bits of a wide fingerprint: what a shingle's hash is mixed with.
_FLIPS, _FACTORS = (_draw.integers(0, 1 << 64, 512, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a text's shingles as a signed 64-bit number; 0 without words (null, empty, white space)."""
    words = text.lower().split() if text else ()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, RUN):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + RUN], stops[i : i + RUN], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs. Null ids stay null."""
    return map_texts(docs, ["doc_id", "text"], lambda: lambda c: [c[0], [fingerprint(t, width) for t in c[1]]], "doc_id long, fp long")


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks with keys so long that some 16 of n fingerprints share one by chance at most."""
    blocks = distance + 2
    while (blocks - distance) * BITS / blocks < math.log2(max(n, 2)) - 4 and blocks < 2 * distance + 2:
        blocks += 1
    return blocks


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(fps: DataFrame, distance: int = 2, blocks: int | None = None, bucket: int = 1000) -> DataFrame:
    """Edges (a, b) between distinct values of the column fp; every pair within distance is connected by them.

    blocks: None to choose by the number of fingerprints.
    """
    blocks = blocks or blocks_for(fps.count(), distance)
    if not distance < blocks <= BITS:
        raise ValueError("there must be more blocks than differing bits, and 64 at most")
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    kept = combinations(range(blocks), blocks - distance)
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen) for chosen in kept]
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    hot = materialize(keyed.groupBy("choice", "key").count().where(F.col("count") > bucket), "hot-buckets")
    crowded = bool(hot.take(1))
    normal = keyed.join(hot.select("choice", "key"), ["choice", "key"], "left_anti") if crowded else keyed
    x, y = normal.alias("x"), normal.alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(apart) <= distance)
    if not crowded and len(masks) <= FEW:
        for i, m in enumerate(masks):  # a pair is emitted at the first choice that it agrees on
            near = near & ~((F.col("x.choice") > i) & (apart.bitwiseAND(F.lit(signed(m))) == 0))
    found = x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if not crowded:
        return found
    rest = keyed.join(hot, ["choice", "key"])
    return found.union(_met(rest, masks) if distance <= 2 else _compared(rest, distance))


def _met(crowded: DataFrame, masks: list[int]) -> DataFrame:
    """Edges within two bits of each other among fingerprints that share a key, by the values they meet at."""
    free = [[0] + [1 << b for b in range(BITS) if not m >> b & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(signed(v)) for v in values]) for values in free]), F.col("choice") + 1)
    met = crowded.select("fp", "choice", F.explode(flips).alias("flip")).select("fp", "choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("meeting"))
    # at most 65 distinct fingerprints meet at a value
    group = met.groupBy("choice", "meeting").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("every")).where(F.size("every") > 1)
    return group.select("a", F.explode("every").alias("b")).where("a <> b")


def _compared(crowded: DataFrame, distance: int) -> DataFrame:
    """Edges of a spanning forest of the links among fingerprints that share a key, by pairs of parts."""
    parts = F.ceil(F.col("count") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # a part meets itself and every other part of its bucket
    rows = crowded.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")

    def compare(group: pa.Table) -> pa.Table:
        fp, own = (group.column(c).to_numpy() for c in ("fp", "own"))
        order = np.argsort(fp)
        fp, own = fp[order].astype(np.int64).view(np.uint64), own[order]
        first = np.nonzero(own == own.min())[0]
        second = np.nonzero(own == own.max())[0]
        i, j = [], []
        for k in range(0, len(first), 256):
            a, b = np.nonzero(np.bitwise_count(fp[first[k : k + 256], None] ^ fp[None, second]) <= distance)
            i.append(first[k + a])
            j.append(second[b])
        root = forest(len(fp), np.concatenate(i), np.concatenate(j))
        ends = np.nonzero(root != np.arange(len(fp)))[0]
        return pa.table({"a": pa.array(fp[root[ends]].view(np.int64)), "b": pa.array(fp[ends].view(np.int64))})

    return rows.select("choice", "key", low, high, "fp", "own").groupBy("choice", "key", "low", "high").applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int | None = None, bucket: int = 1000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that can be reached by links, the document's own included. Null texts, empty
    texts and texts of white space have fingerprint 0 and are linked like any other. Repeated rows and ids give as
    many rows; a null doc_id is returned and never is the smallest unless a component has no other. Other columns of
    docs are not read. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = materialize(connected_components(links(classes, distance, blocks, bucket)), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: F.col) -> F.col:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Of repeated rows with that id one stays. Rows whose doc_id is null can't be told apart and all stay.
    """
    kept_id, rank = fresh("kept_id", docs), fresh("kept_rank", docs)
    kept = components(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col(kept_id)).drop(kept_id)
    chosen = chosen.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where(F.col(rank) == 1).drop(rank)
    return chosen.union(docs.where("doc_id is null"))


def wide_blocks(n: int) -> tuple[int, int]:
    """For n sets the bits of a block, and how many blocks there are."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) - LOAD, 8), 24)
    return bits, math.ceil(math.log(MISS) / math.log(1 - (1 - SHARE) ** bits))


def wide(own: np.ndarray, longs: int) -> bytes:
    """The SimHash of a set of shingles' hashes in 64 * longs bits: 1 where over half of them have a 1; none of no shingles."""
    if not len(own):
        return b""
    ones = np.zeros((8, 8 * longs), np.int64)
    for i in range(0, len(own), BYTES):
        x = (own[i : i + BYTES, None] ^ _FLIPS[:longs]) * _FACTORS[:longs]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        for bit in range(8):
            ones[bit] += ((x >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones.T > len(own)).tobytes()


def sized(own: np.ndarray, longs: int) -> bytes:
    """wide() and, as the last long, how many shingles there are; none of no shingles."""
    return wide(own, longs) + len(own).to_bytes(8, "little") if len(own) else b""


def block_rows(nodes: DataFrame, bits: int, low: int, high: int) -> DataFrame:
    """(key, node, size, x0..) of (node, keys: sized()): a row for each block from low to high, x0.. being the first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, at = 1 << np.arange(bits)[::-1], np.arange(low, high)[None, :] << bits
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = [(n, k) for n, k in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True) if k]
                if not rows:
                    continue
                node, prints = np.array([n for n, _ in rows], np.int64), np.frombuffer(b"".join(k for _, k in rows), np.uint8).reshape(len(rows), -1)
                every = np.unpackbits(prints, axis=1)[:, bits * low : bits * high].reshape(-1, high - low, bits)
                size, first = (np.ascontiguousarray(c).view(np.int64) for c in (prints[:, -8:], prints[:, : FIRST // 8]))
                out = (every @ powers + at).ravel(), *(np.repeat(c, high - low) for c in (node, size[:, 0], *first.T))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in out], ["key", "node", "size", *_PRINT])

    return nodes.select("node", "keys").mapInArrow(run, ", ".join(f"{c} long" for c in ["key", "node", "size", *_PRINT]))


def first_blocks(bits: int) -> np.ndarray:
    """For each block of bits that lies in the first bits of a wide fingerprint, a mask of longs."""
    own = np.arange(FIRST)[None, :] // bits == np.arange(FIRST // bits)[:, None]
    return np.packbits(own, axis=1).view(np.int64)


def met(rows: DataFrame, bits: int) -> DataFrame:
    """(key, a, b) of block_rows(): pairs a, b of a key within NEAR; all a of keys that more than CROWD share, b being null.

    Sets that are too unlike in size to reach the similarity are no pair.

    Of the keys that a pair agrees on, those after one of first_blocks() leave it out: it is a pair or in a crowd there.
    """
    masks, (num, den) = first_blocks(bits), minhash.LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * (3 + len(_PRINT))
        left, crowd = none, None  # the rows of the last key, and the key of the crowd that goes on
        for batch in chain(batches, (None,)):
            own = none if batch is None else [c.to_numpy() for c in batch.columns]
            key, node, size, *first = rows = [np.concatenate(c) for c in zip(left, own, strict=True)]
            if not len(key):
                continue
            end = int(np.searchsorted(key, key[-1]))
            if batch is None or len(key) - end > CROWD:
                end = len(key)
            left = [c[end:] for c in rows]
            key, node, size, *first = (c[:end] for c in rows)
            if not end:
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(starts, append=end)
            crowded = (sizes > CROWD) | (key[starts] == crowd if crowd is not None else False)
            crowd = key[-1] if crowded[-1] else None
            if crowded.any():
                at = np.flatnonzero(np.repeat(crowded, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), pa.nulls(len(at), pa.int64())], ["key", "a", "b"])
            key, node, size, *first = (c[np.repeat(~crowded, sizes)] for c in (key, node, size, *first))
            for lag in range(1, min(CROWD, len(key))):
                at = np.flatnonzero(key[lag:] == key[:-lag])
                if not len(at):
                    break
                to = at + lag
                alike = (den * size[at] >= num * size[to]) & (den * size[to] >= num * size[at])
                at, to = at[alike], to[alike]
                apart = np.stack([c[at] ^ c[to] for c in first], axis=1)
                hit = np.bitwise_count(apart.view(np.uint64)).sum(axis=1) <= NEAR
                at, to, apart = at[hit], to[hit], apart[hit]
                new = np.ones(len(at), bool)
                for block, mask in enumerate(masks):
                    new &= (key[at] >> bits <= block) | (apart & mask).any(axis=1)
                at, to = at[new], to[new]
                if len(at):
                    pair = np.minimum(node[at], node[to]), np.maximum(node[at], node[to])
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), *map(pa.array, pair)], ["key", "a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def groups_of(pairs: DataFrame) -> DataFrame:
    """(key, part, node, to) of pairs (a, b): each pair is in one group (key, part), with b in the list to of a's row.

    A pair goes to the smallest partner of its b, so near copies of each other are one group, and a node is in one more
    group than it has larger partners at most. Groups have some PAIRS pairs at most: larger ones are dealt into parts.
    """
    keyed = pairs.join(pairs.groupBy("b").agg(F.min("a").alias("key")), "b")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    dealt = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("a", "b"), "parts"))
    ends = dealt.select("key", "part", F.col("a").alias("node"), F.col("b").alias("to")).union(dealt.select("key", "part", "b", F.lit(None).cast("long")))
    return ends.groupBy("key", "part", "node").agg(F.collect_list("to").alias("to"))


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs (a, b), no pair twice, whose sets of shingles reach the similarity exactly.

    nodes: (node, rep). texts: (rep, text).
    """
    grouped = materialize(groups_of(pairs).join(nodes.select("node", "rep"), "node"), "grouped")
    rows = texts.join(grouped, "rep").select("key", "part", "node", "to", F.col("text").cast("binary").alias("text"))

    def reached(held: dict) -> list[tuple[int, int]]:
        num, den = minhash.LEAST
        hit = []
        for a, (s, to) in held.items():
            for b in to:
                t = held[b][0]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    hit.append((a, b))
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None  # a group's sets by node, and what each is compared with
        for batch in chain(batches, (None,)):
            hit = []
            for some in slices(batch, 4) if batch is not None else ():
                for key, part, node, to, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if (key, part) != now:
                        hit += reached(held)
                        held, now = {}, (key, part)
                    held[node] = minhash.shingles(text), to
            if batch is None:
                hit += reached(held)
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hit, strict=True)], ["a", "b"])
        del held
        give_back()

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def similar_links(nodes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between nodes: all pairs that agree in a block and reach the similarity are connected by them.

    nodes: (node, rep, keys: sized() fingerprints for n sets). texts: (rep, text), at least for the nodes' reps.
    """
    bits, blocks = wide_blocks(n)
    ends = np.linspace(0, blocks, -(-blocks // PASS) + 1).astype(int).tolist()
    passes = [materialize(met(block_rows(nodes, bits, low, high), bits), "met") for low, high in pairwise(ends)]
    found = reduce(DataFrame.union, passes)
    pairs = materialize(found.where("b is not null").select("a", "b").distinct(), "pairs")
    members = minhash.met(found.where("b is null").select(F.col("a").alias("node"), "key"))
    for own in passes:
        remove(own)
    links = materialize(similar(pairs, nodes, texts), "links")
    if not members.take(1):
        return links
    return links.union(minhash.crowds(members, minhash.sets_of(members.select("node"), nodes, texts)))


def keep_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates (minhash.keep_by), proposed by blocks of wide SimHashes."""

    def marker(n: int):
        bits, blocks = wide_blocks(n)
        longs = -(-max(bits * blocks, FIRST) // BITS)
        return lambda own: sized(own, longs)

    return minhash.keep_by(docs, marker, "binary", similar_links)
