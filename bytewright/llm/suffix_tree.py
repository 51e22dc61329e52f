"""Language-model scoring by a probabilistic suffix tree that is kept in tables.

Symbols are words (by their 64-bit hashes), an end, and a start that only stands in contexts. The tree's states are
contexts of up to ``depth`` symbols. A context is tried if its suffix is a state and it is frequent enough, and it stays
if the distribution of what follows diverges enough from its suffix's (the gain in likelihood per stored successor).
Distributions are smoothed by absolute discounting towards the suffix, down to the root, whose distribution is the base
of counts plus a half. A text is scored by the longest suffix of each position that is a state. All levels are proper
distributions over the words that training saw and one unseen word.

The tree never gathers anywhere: words, states and successors are tables in the shared folder, made by aggregates and
joins, so words, contexts and successors grow with the corpus. Least counts are absolute. To read texts, tasks get a
cache of bounded size: the most frequent words, states and successors, and bit maps of the hashes of all states and
successors. A bit map has no false negatives, so what it denies needs no look-up; what the cache has is final. All else is
looked up exactly by joins with the tables. The caches' sizes change how much is joined, and never a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean, give_back, lean, materialize, remove, slices
from .toxicity import crc_mod

#: Words, states and successors in the caches, the most frequent ones.
WORDS, STATES, SUCCESSORS = 1 << 19, 1 << 19, 1 << 22
#: Bits of a bit map (a power of two); one travels as 16 MB at most.
BITS = 1 << 27
#: Counted keys that a task holds before it hands them on.
HELD = 1 << 21
#: Rows that a task hands on at once, and keys that are hashed together.
ROWS = 1 << 16
#: Bits of a frequent word's number, of which a long holds three.
CODE = 20
#: Bytes of text that are turned into symbols together; one text is never divided.
TOGETHER = 1 << 20
DISCOUNT = 0.6
#: Symbols that are no words. NONE stands where a context is shorter.
NONE, START, END = 0, 1, 2

# The constants of XXH64, by which Spark hashes longs.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of a long for each value, from a seed; chained, that of several columns. The first seed is 42."""
    seed = np.uint64(seed) if isinstance(seed, int) else seed.view(np.uint64)
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(value.view(np.uint64) * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def key_of_rows(columns: list[np.ndarray]) -> np.ndarray:
    """Spark's xxhash64 of each row, ROWS at a time; a single column is its own key."""
    if len(columns) == 1:
        return columns[0]
    out = np.empty(len(columns[0]), np.int64)
    for i in range(0, len(out), ROWS):
        own = [x[i : i + ROWS] for x in columns]
        out[i : i + ROWS] = reduce(lambda key, x: hashed(x, key), own, np.full(len(own[0]), 42, np.int64))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key stands, in the order of keys, and how often the key does."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    at = np.flatnonzero(new)
    del new
    first = order[at]
    del order
    return first, np.diff(at, append=len(keys))


def handed(held: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The distinct rows among held ones (lists of columns) and how often each occurs, in batches of ROWS.

    held is emptied. Missing columns before the count are NONE. Both sides of a worker's pipe have a batch in memory,
    and a batch of all that a task holds would be 80 MB on each.
    """
    columns = [np.concatenate([x.pop(0) for x in held]) for _ in range(len(held[0]))]
    held.clear()
    first, n = distinct(key_of_rows(columns))
    for i in range(0, len(first), ROWS):
        at = first[i : i + ROWS]
        none = np.zeros(len(at), np.int64)
        own = [x[at] for x in columns] + [none] * (len(names) - 1 - len(columns))
        yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(n[i : i + ROWS])], names)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def symbols(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts (a start, words, an end for each), and where each text starts."""
    parts, starts, at = [np.zeros(0, np.int64)], [], 0
    for text in texts:
        words = words_of(text)
        own = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)
        parts += [[START], own, [END]]
        starts.append(at)
        at += len(words) + 2
    return np.concatenate(parts), np.array(starts, np.int64)


def contexts(s: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By depth: the symbol that far before each position, the hash of the context, and whether there is one.

    Contexts don't reach beyond a start; nothing comes before one.
    """
    earlier, keys, there = [], [], []
    inside, key = s != START, np.full(len(s), 42, np.int64)
    for d in range(1, depth + 1):
        own = np.zeros(len(s), np.int64)
        own[d:] = s[:-d] if d < len(s) else []
        key = hashed(own, key)
        earlier.append(own)
        keys.append(key)
        there.append(inside)
        inside = inside & (own != START)
    return earlier, keys, there


@dataclass
class Cache:
    """What tasks look up by themselves: tables of keys with values, and bit maps of all keys."""

    words: Table
    all_words: bool  # whether these are all words
    states: Table | None = None
    successors: Table | None = None
    state_bits: np.ndarray | None = None
    successor_bits: np.ndarray | None = None

    def packed(self) -> dict:
        """As it travels: tables are laid out on the driver, so that a task copies none."""
        return {k: vars(x) if isinstance(x, Table) else x for k, x in vars(self).items()}

    @classmethod
    def opened(cls, packed: dict) -> Cache:
        return cls(**{k: Table.over(**x) if isinstance(x, dict) else x for k, x in packed.items()})


@dataclass
class Model:
    """words (h, n). By depth: states (w1.., left: log10 of what is left to the suffix) and successors (w1.., c, full:
    log10 probability, gain: what that has over the base's). w1 is the symbol next before c."""

    total: int  # training tokens
    distinct: int  # of them
    ends: int
    words: DataFrame
    states: list[DataFrame] = field(default_factory=list)
    successors: list[DataFrame] = field(default_factory=list)
    cache: Cache | None = None

    @property
    def depth(self) -> int:
        return len(self.states)

    @property
    def base_total(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


class Table:
    """Values by key. Keys are dealt to ranges by their first bits, so that a look-up reads few places of memory."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys = keys.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> self.shift).view(np.int64), minlength=1 << bits), out=self.first[1:])

    @classmethod
    def over(cls, **arrays: np.ndarray) -> Table:
        """The table whose vars() these are, with the same arrays."""
        table = cls.__new__(cls)
        vars(table).update(arrays)
        return table

    def find(self, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """The values of wanted keys, and whether there are any."""
        wanted = wanted.view(np.uint64)
        out, hit = np.full(len(wanted), missing, self.values.dtype), np.zeros(len(wanted), bool)
        ranges = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[ranges], self.first[ranges + 1]
        left = np.nonzero(at < end)[0]
        at, end = at[left], end[left]
        while len(left):
            same = self.keys[at] == wanted[left]
            out[left[same]], hit[left[same]] = self.values[at[same]], True
            more = ~same & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out, hit


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit map has the keys' bits."""
    at = keys & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bit_map(keys: list[DataFrame]) -> np.ndarray:
    """A bit for each key of tables with a column key, made in tasks; its size does not depend on the tables'."""
    out = np.zeros(BITS // 8, np.uint8)
    if not keys:
        return out
    page = min(BITS, 1 << 15)
    at = reduce(DataFrame.union, [k.select("key") for k in keys]).select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("at"))
    pages = at.groupBy(F.shiftright("at", page.bit_length() - 1).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(page - 1))).alias("bits"))
    for r in pages.toLocalIterator():
        own = np.frombuffer(bytes(r[1]), np.uint8)[: page // 8]
        out[r[0] * (page // 8) : r[0] * (page // 8) + len(own)] = own
    return out


def most_frequent(tables: list[DataFrame], value: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """key and value of the rows with the largest n, most of them at most, and an n from which all are in.

    tables: key, n, value. Rows are in or out by eighths of powers of two of n.
    """
    rows = reduce(DataFrame.union, [t.select("key", "n", value) for t in tables]) if tables else None
    bins = F.floor(F.log2("n") * 8)
    left, low = most, None
    for at, n in sorted(map(tuple, rows.groupBy(bins.alias("at")).count().collect()), reverse=True) if tables else ():
        left -= n
        if left < 0:
            break
        low = at
    if low is None:
        return np.zeros(0, np.int64), np.zeros(0), 1 << 62
    got = rows.where(bins >= low).select("key", value).toArrow()
    return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy(), math.ceil(2 ** ((low + 1) / 8))


def symbols_of(d: int) -> list[str]:
    return [f"w{i}" for i in range(1, d + 1)]


def key_of(names: list[str]) -> Column:
    return F.xxhash64(*names).alias("key")


def training(docs: DataFrame) -> DataFrame:
    """The texts to learn from: those whose crc32(doc_id as text) mod 5 is not 1. Rows without an id teach nothing."""
    return docs.where(crc_mod(F.col("doc_id"), 5) != 1).select(F.col("text").cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word, by its hash, and the end occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, 0, TOGETHER):
                s, _ = symbols(part.column(0).to_pylist())
                held.append([s[s != START]])
                size += len(held[-1][0])
                if size > HELD:
                    yield from handed(held, ["h", "n"])
                    size = 0
        if held:
            yield from handed(held, ["h", "n"])
        give_back()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of CODE bits for the most frequent words (by their hashes), which all tasks give alike; 0 is for none."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.concatenate((np.array([NONE, START], np.int64), words[: (1 << CODE) - 2]))
        self.table = Table(self.words[2:], np.arange(2, len(self.words)))

    def of(self, s: np.ndarray) -> np.ndarray:
        found, _ = self.table.find(s, 0)
        found[s == START] = 1
        return found


def pack(numbers: list[np.ndarray], longs: int) -> list[np.ndarray]:
    """Numbers of a key, three to a long."""
    out = [np.zeros(len(numbers[0]), np.int64) for _ in range(longs)]
    for i, x in enumerate(numbers):
        out[i // 3] |= x << (CODE * (i % 3))
    return out


def unpack(longs: list[np.ndarray], count: int) -> list[np.ndarray]:
    return [longs[i // 3] >> (CODE * (i % 3)) & ((1 << CODE) - 1) for i in range(count)]


def count_successors(texts: DataFrame, low: int, high: int, may: object, least: int, frequent: Broadcast) -> DataFrame:
    """(d, w1.., c, n): symbols c behind contexts of low to high symbols, which may() lets through, if least times there.

    may(): function of the symbols before, their context hashes and where there are any, by depth, to masks. frequent:
    words that have numbers. Keys are dealt out as numbers where all their symbols have one (the last column is NONE
    then), and else as w1.., c; the same key has the same form everywhere.
    """
    names, keys = symbols_of(high), [f"k{i}" for i in range(high + 1)]
    longs = -(-(high + 1) // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        short: list[list[np.ndarray]] = []
        wide: list[list[np.ndarray]] = []
        lets, numbers, size = may(), Numbers(frequent.value[0]), 0

        def all_handed() -> Iterator[pa.RecordBatch]:
            for held in filter(None, (short, wide)):
                yield from handed(held, [*keys, "n"])

        for batch in batches:
            for part in slices(batch, 0, TOGETHER):
                s, _ = symbols(part.column(0).to_pylist())
                number = numbers.of(s)
                for d, mask in lets(*contexts(s, high)):
                    at = np.nonzero(mask)[0]
                    own = [number[at - i] for i in range(d + 1)]
                    fits = np.logical_and.reduce([x > 0 for x in own])
                    short.append(pack([x[fits] for x in own], longs))
                    size += len(at)
                    at = at[~fits]
                    if len(at):
                        none = np.zeros(len(at), np.int64)
                        wide.append([*(s[at - i] for i in range(1, d + 1)), *[none] * (high - d), s[at]])
                if size > HELD:
                    yield from all_handed()
                    size = 0
        yield from all_handed()
        give_back()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words = Numbers(frequent.value[0]).words
        for batch in batches:
            *held, n = (x.to_numpy() for x in batch.columns)
            in_short = held[-1] == NONE
            own = [words[np.where(in_short, x, 0)] for x in unpack(held[:longs], high + 1)]
            c = np.where(in_short, own[0], held[-1])
            before = [np.where(in_short, x, y) for x, y in zip(own[1:], held[:-1], strict=True)]
            d = np.sum([x != NONE for x in before], axis=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (d, *before, c)), pa.array(n)], ["d", *names, "c", "n"])

    schema = ", ".join(f"{k} long" for k in [*keys, "n"])
    # tasks have counted what they have, so another aggregate before the shuffle would find little to add up
    counted = texts.mapInArrow(run, schema).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = counted.mapInArrow(named, ", ".join(["d int", *(f"{w} long" for w in [*names, "c", "n"])]))
    return out if high > low else out.drop("d")


def fit(docs: DataFrame, depth: int = 3, context_least: int = 8, deeper_least: int = 8, pair_least: int = 3, gain: float = 3.0) -> Model:
    """Learn a tree.

    context_least, deeper_least, pair_least: how often a context of one symbol, one of more, or a context with its
    successor, must occur in the training texts to be in the model, whatever their size. gain: nats of likelihood that a context must win over its suffix for each
    successor that it stores. Null and empty texts are an end alone; without training texts the base is all there is.
    """
    spark = docs.sparkSession
    texts = training(docs)
    words = materialize(count_words(texts), "words")
    sums = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("h") == END, F.col("n")))).first()
    total, distinct, ends = sums[0] or 0, sums[1], sums[2] or 0
    *top, least = most_frequent([words.select(F.col("h").alias("key"), "n")], "n", WORDS)
    model = Model(total, distinct, ends, words)
    cache = Cache(Table(*top), len(top[0]) == distinct)
    send = spark.sparkContext.broadcast(tuple(top))
    sure = least <= context_least  # words that are not in the cache are not frequent

    def first():
        known = Table(*send.value)

        def lets(earlier, hashes, there):
            times, _ = known.find(earlier[0], 0 if sure else context_least)
            yield 1, there[0] & ((times >= context_least) | (earlier[0] == START))

        return lets

    pairs = materialize(count_successors(texts, 1, 1, first, pair_least, send), "successors")
    clean(spark)
    base_total = model.base_total
    base = words.select(F.col("h").alias("c"), F.log10((F.col("n") + 0.5) / base_total).alias("base"))
    totals = words.where(F.col("n") >= context_least).select(F.col("h").alias("w1"), F.col("n").alias("total"))
    totals = totals.where(F.col("w1") != END).union(spark.createDataFrame([(START, ends)] if ends >= context_least else [], "w1 long, total long"))
    level = pairs.join(totals, "w1").join(base, "c").withColumn("lower", F.col("base"))
    _grow(model, level, 1, gain)
    if depth > 1:
        # contexts that may be frequent: all their pairs are
        often = bit_map([pairs.where((F.col("n") >= deeper_least) & (F.col("c") != END)).select(key_of(["c", "w1"]))])
        bits = spark.sparkContext.broadcast(often)

        def deeper():
            own = bits.value

            def lets(earlier, hashes, there):
                pair = there[1] & marked(own, hashes[1])
                mask = pair
                for d in range(2, depth + 1):
                    yield d, mask & there[d - 1]
                    mask = mask.copy()
                    mask[d - 1 :] &= pair[: -(d - 1)]
                    mask[: d - 1] = False

            return lets

        counted = materialize(count_successors(texts, 2, depth, deeper, pair_least, send), "successors")
        clean(spark)
        before = pairs
        for d in range(2, depth + 1):
            own = symbols_of(d)
            # a context's count: how often its last symbol stands behind the others
            renamed = before.select(F.col("c").alias("w1"), *(F.col(w).alias(f"w{i}") for i, w in enumerate(symbols_of(d - 1), 2)), F.col("n").alias("total"))
            lower = model.successors[-1].select(*symbols_of(d - 1), "c", F.col("full").alias("lower"), (F.col("full") - F.col("gain")).alias("base"))
            here = (counted.where(F.col("d") == d) if depth > 2 else counted).select(*own, "c", "n")
            level = here.join(renamed.where(F.col("total") >= deeper_least), own).join(lower, [*symbols_of(d - 1), "c"])
            _grow(model, level, d, gain)
            before = here
    send.destroy()
    if depth > 1:
        bits.destroy()
    cache.states = Table(*most_frequent([t.select(key_of(symbols_of(d)), "n", "left") for d, t in enumerate(model.states, 1)], "left", STATES)[:2])
    cache.successors = Table(*most_frequent([t.select(key_of([*symbols_of(d), "c"]), "n", "gain") for d, t in enumerate(model.successors, 1)], "gain", SUCCESSORS)[:2])
    cache.state_bits = bit_map([t.select(key_of(symbols_of(d))) for d, t in enumerate(model.states, 1)])
    cache.successor_bits = bit_map([t.select(key_of([*symbols_of(d), "c"])) for d, t in enumerate(model.successors, 1)])
    model.cache = cache
    return model


def _grow(model: Model, level: DataFrame, d: int, gain: float) -> None:
    """Add a level: those of its contexts whose successors diverge enough from what their suffixes give.

    level: (w1.., c, n, total, base, lower): lower is log10 of the suffix's probability of c, base that of the root's. A
    context's sums are aggregates that each task combines, joined back to its successors, so no context gathers in a task.
    """
    own = symbols_of(d)
    level = materialize(level.select(*own, "c", "n", "total", "base", "lower", ((F.col("n") - DISCOUNT) / F.col("total")).alias("kept")), "level")
    sums = level.groupBy(*own).agg((1 - F.sum("kept")).alias("left"), F.count("*").alias("stored"))
    full = F.log10(F.col("kept") + F.col("left") * F.pow(F.lit(10.0), "lower"))
    weighed = level.join(sums, own).groupBy(*own).agg(F.max("total").alias("n"), F.first("left").alias("rest"), F.max("stored").alias("stored"), F.sum(F.col("n") * (full - F.col("lower")) * float(np.log(10))).alias("won"))
    states = materialize(weighed.where(F.col("won") >= gain * F.col("stored")).select(*own, F.col("n"), F.log10("rest").alias("left")), "states")
    joined = level.join(states.select(*own, F.pow(F.lit(10.0), "left").alias("left")), own).withColumn("full", full)
    model.states.append(states)
    model.successors.append(materialize(joined.select(*own, "c", "n", "full", (F.col("full") - F.col("base")).cast("float").alias("gain")), "successors"))
    remove(level)
    clean(level.sparkSession)


def walk(s: np.ndarray, cache: Cache, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each symbol what its longest context adds to the base's log10 probability, as far as the cache can tell.

    Returns the sums, the depth from which tables have to tell (0: none), and the symbols before, by depth.
    """
    earlier, keys, there = contexts(s, depth) if depth else ([], [], [])
    out, ask, open_ = np.zeros(len(s)), np.zeros(len(s), np.int8), np.ones(len(s), bool)
    may = []
    for d in range(depth):
        at = np.nonzero(there[d] & (may[-1] if may else True))[0]  # a state's suffix is a state
        is_state = np.zeros(len(s), bool)
        is_state[at[marked(cache.state_bits, keys[d][at])]] = True
        may.append(is_state)
    for d in range(depth, 0, -1):
        at = np.nonzero(open_ & may[d - 1])[0]
        grams = hashed(s[at], keys[d - 1][at])
        added, hit = cache.successors.find(grams, 0.0)
        out[at[hit]] += added[hit]
        open_[at[hit]] = False
        at, grams = at[~hit], grams[~hit]
        left, known = cache.states.find(keys[d - 1][at], 0.0)
        known &= ~marked(cache.successor_bits, grams)  # surely not stored
        out[at[known]] += left[known]
        ask[at[~known]] = d
        open_[at[~known]] = False
    return out, ask, earlier


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, which may be any table.

    Null and empty texts are an end alone. Repeated rows and ids are scored row by row. Other columns are not read.
    """
    depth, names = model.depth, symbols_of(max(model.depth, 1))
    send = docs.sparkSession.sparkContext.broadcast(model.cache.packed())
    base_total = model.base_total
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    columns = ["d", "row", *names, "c", "n", "doc_id", "n_tokens", "base", "added"]
    schema = ", ".join(["d int", "row long", *(f"{w} long" for w in names), "c long", "n long", "doc_id long", "n_tokens long", "base double", "added double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        cache = Cache.opened(send.value)
        z = np.log10(base_total)

        def made(m: int, **own) -> pa.RecordBatch:
            kinds = {"d": pa.int32(), "base": pa.float64(), "added": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array(own[c], kinds.get(c, pa.int64())) if c in own else pa.nulls(m, kinds.get(c, pa.int64())) for c in columns], columns)

        for batch in batches:
            for part in slices(batch, 2, TOGETHER):
                ids, numbers = part.column(0).to_pylist(), part.column(1).to_numpy()
                s, starts = symbols(part.column(2).to_pylist())
                lengths = np.diff(np.concatenate((starts, [len(s)])))
                owner = np.repeat(np.arange(len(starts)), lengths)
                counts, hit = cache.words.find(s, 0)
                start = s == START
                asks = ~hit & ~start & (not cache.all_words)
                base = np.where(start | asks, 0.0, np.log10(counts + 0.5) - z)
                added, ask, earlier = walk(s, cache, depth)
                sums = [np.add.reduceat(x, starts) for x in (base, added, hit.astype(np.int64))]
                yield made(len(ids), d=np.full(len(ids), -1, np.int32), row=numbers, doc_id=ids, n=sums[2], n_tokens=lengths - 1, base=sums[0], added=sums[1])
                at = np.nonzero(asks)[0]
                if len(at):
                    _, first, n = np.unique(hashed(s[at], owner[at]), return_index=True, return_counts=True)
                    at = at[first]
                    yield made(len(at), d=np.zeros(len(at), np.int32), row=numbers[owner[at]], c=s[at], n=n)
                at = np.nonzero(ask)[0]
                if len(at):
                    yield made(len(at), d=ask[at].astype(np.int32), row=numbers[owner[at]], c=s[at], **{w: e[at] for w, e in zip(names, earlier, strict=True)})
        give_back()

    read = materialize(rows.mapInArrow(run, schema), "read")
    known = model.words.select(F.col("h").alias("c"), F.col("n").alias("times"))
    rare = read.where("d = 0").select("row", "c", "n").join(known, "c", "left")
    base = F.col("n") * (F.log10(F.coalesce("times", F.lit(0)) + 0.5) - F.lit(float(np.log10(base_total))))
    parts = [
        read.where("d = -1").select("row", "doc_id", "n_tokens", F.col("n").alias("n_known"), "base", "added"),
        _part(rare.groupBy("row").agg(F.sum(F.when(F.col("times").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(base).alias("base"), F.lit(0.0).alias("added"))),
    ]
    goes_on = None
    for d in range(depth, 0, -1):
        own = symbols_of(d)
        asked = read.where(F.col("d") == d).select("row", *names, "c")
        asked = asked.unionByName(goes_on) if goes_on is not None else asked
        found = asked.join(model.successors[d - 1].select(*own, "c", "gain"), [*own, "c"], "left").join(model.states[d - 1].select(*own, "left"), own, "left")
        if d > 1:  # few: most look-ups are of pairs
            found = materialize(found.select("row", *names, "c", "gain", "left"), "found")
            goes_on = found.where("gain is null").select("row", *names, "c")
        parts.append(_part(found.groupBy("row").agg(F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.sum(F.coalesce("gain", "left", F.lit(0.0))).alias("added"))))
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.max(x).alias(x) for x in ("doc_id", "n_tokens")), *(F.sum(x).alias(x) for x in ("n_known", "base", "added")))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("added")).alias("score"))


def _part(sums: DataFrame) -> DataFrame:
    return sums.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), "n_known", "base", "added")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 5) == 1, F.lit(False))
