"""Benchmark decontamination with an Aho-Corasick automaton over the normalised benchmark.

Texts are normalised to their words, one space apart. Every ``width`` consecutive words hold one whole block of an
item that is cut into blocks of (width + 1) / 2 words, so these blocks are the automaton's patterns (an item of fewer
than width words is one), framed by spaces so that they only match whole words. A document is normalised likewise and
scanned once; a block that is met is extended word by word as far as document and item agree, and what agrees on width
words or more is hit. Hits are mapped to word numbers and to offsets in the original.

Patterns take about the bytes of the benchmark's text, and travel to the executors by broadcast up to
``AUTOMATON_BYTES``. A larger benchmark is dealt into parts of that size, one automaton and one scan each, whose hits
are added up document by document; it never is on the driver or an executor whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, fresh, map_texts, materialize

#: Bytes of benchmark text in one automaton (a single item may have more), which takes some tens of bytes for each.
AUTOMATON_BYTES = 4 << 20
#: Bytes that are part of words (a-z, 0-9 and all beyond ASCII), with A-Z in lower case.
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Benchmark:
    """Items and an automaton over their blocks."""

    def __init__(self, items: list[tuple[object, bytes]], width: int) -> None:
        self.width = width
        by_text: dict[bytes, list] = {}
        for item, text in items:
            if text:
                by_text.setdefault(text, []).append(item)
        self.words = [t.split() for t in by_text]
        self.ids = list(by_text.values())
        blocks: dict[bytes, list[tuple[int, int]]] = {}
        half = (width + 1) // 2
        for i, own in enumerate(self.words):
            n = half if len(own) >= width else len(own)
            for at in range(0, len(own) - n + 1, n):
                blocks.setdefault(b" " + b" ".join(own[at : at + n]) + b" ", []).append((i, at))
        self.tree = ahocorasick.Automaton() if blocks else None
        for block, places in blocks.items():
            self.tree.add_word(block.decode("latin-1"), (block.count(b" ") - 1, places))  # a character for each byte
        if blocks:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words that windows cover, merged and in order, and the items whose windows occur."""
        if not words or self.tree is None:
            return [], set()
        found = list(self.tree.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not found:
            return [], set()
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where the space behind each word is
        ranges, items = set(), set()
        reach: dict[tuple[int, int], int] = {}  # how far an item laid at a word is known to agree
        for last, (_, (n, places)) in zip(np.searchsorted(stops, [end for end, _ in found]).tolist(), found, strict=True):
            first = last - n + 1
            for i, at in places:
                if reach.get((i, first - at), -1) > last:
                    continue
                own = self.words[i]
                a, b, y, z = first, at, last + 1, at + n
                while a and b and words[a - 1] == own[b - 1]:
                    a, b = a - 1, b - 1
                while y < len(words) and z < len(own) and words[y] == own[z]:
                    y, z = y + 1, z + 1
                reach[i, first - at] = y
                if y - a >= min(self.width, len(own)):
                    ranges.add((a, y))
                    items.update(self.ids[i])
        return merged(ranges), items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges as ranges apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text (start, end) that ranges of words cover."""
    letters = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], letters.astype(np.int8), [0])))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def parts_of(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """(item_id, normalised text) of the whole benchmark in parts; the driver holds one at a time."""
    part, size = [], 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary")).where("text is not null").distinct().toLocalIterator():
        words = b" ".join(words_of(bytes(text)))
        if part and size + len(words) > AUTOMATON_BYTES:
            yield part
            part, size = [], 0
        part.append((item, words))
        size += len(words)
    yield part


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of docs.

    items: the item_ids with windows in the document, as strings in their order as strings. spans: the byte ranges of
    the original text that hit words cover. Null and empty texts have no words; an empty benchmark, and items that
    are null or without words, have no windows. Items that share an id, and repeated rows, count once. Windows with a
    null item_id hit words but name no item. Other columns are not read.
    """
    ranged = "array<struct<start: long, end: long>>"
    state = docs.select("doc_id", F.array().cast(ranged).alias("ranges"), F.array().cast("array<string>").alias("items"), F.col("text").cast("binary").alias("text"))

    def scanned(part: list, last: bool) -> DataFrame:
        send = docs.sparkSession.sparkContext.broadcast(part)

        def make() -> Callable:
            own = Benchmark(send.value, width)

            def step(columns: list[list]) -> list:
                ids, before, named, texts = columns
                out: list[list] = [[], [], [], []]
                for ranges, items, text in zip(before, named, texts, strict=True):
                    words = words_of(text)
                    found, who = own.scan(words)
                    ranges = merged([*((r["start"], r["end"]) for r in ranges), *found])
                    out[0].append(len(words))
                    out[1].append([{"start": a, "end": b} for a, b in (spans(text, ranges) if last and ranges else ranges)])
                    out[2].append(sorted({*items, *(str(i) for i in who if i is not None)}))
                    out[3].append(sum(b - a for a, b in ranges))
                return [ids, out[0], out[3], out[2], out[1]] if last else [ids, out[1], out[2], texts]

            return step

        schema = f"doc_id long, n_words long, n_hit long, items array<string>, spans {ranged}" if last else f"doc_id long, ranges {ranged}, items array<string>, text binary"
        return map_texts(state, ["doc_id", "ranges", "items", "text"], make, schema)

    waiting = None
    for part in parts_of(benchmark):
        if waiting is not None:
            state = materialize(scanned(waiting, False), "scanned")
        waiting = part
    return scanned(waiting, True)


def contaminated(share: int = 20) -> F.col:
    """True where hit words are there and are at least one in share of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Null and empty texts have no words and stay; repeated rows are decided alike; an empty benchmark keeps all rows. The
    decision is made row by row, without a join, where the benchmark is one part.
    """
    parts = parts_of(benchmark)
    first = next(parts)
    if next(parts, None) is not None:
        row = fresh("row_key", docs)
        keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
        found = contamination(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, width)
        gone = found.where((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).select(F.col("doc_id").alias(row))
        return keyed.join(gone, row, "left_anti").select(*docs.columns)
    send = docs.sparkSession.sparkContext.broadcast(first)

    def make() -> Callable:
        own = Benchmark(send.value, width)

        def keep(texts: list) -> list[bool]:
            out = []
            for words in map(words_of, texts):
                n = sum(b - a for a, b in own.scan(words)[0])
                out.append(not (n > 0 and share * n >= len(words)))
            return out

        return keep

    return filter_texts(docs, make)
