"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-level BPE encodes each pre-token by itself, so a document's count is the sum over its pre-tokens. They are kept
in the leaves of a segment tree whose inner nodes hold sums of characters and tokens. An edit descends to the leaf of
its first character, backs up by a few pre-tokens (what the pattern looks ahead of a pre-token's end or start is
bounded), and cuts the text anew from there until a boundary coincides with an old one behind the edit. Only those
pre-tokens are encoded again and only the sums above their leaves change.

The vocabulary is a file of a public tokenizer in tiktoken's format. Its path is a parameter; the driver reads it and
sends the ranks, whose size is checked, to the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a vocabulary file at most, as every executor gets it.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern reads from a pre-token's start, or beyond its end, at most.
AHEAD = 3
LEAF = 64
#: Counts of pre-tokens that a task remembers; when they are more, it begins anew.
REMEMBERED = 1 << 20


class Counter:
    """Counts the tokens of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.encoded = 0

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        found = [known.get(p) for p in pieces]
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    n = known.get(pieces[i])
                    if n is None:
                        n = known[pieces[i]] = len(self.encoding.encode_ordinary(pieces[i]))
                    found[i] = n
        return found


class CountedText:
    """A text's pre-tokens in a segment tree; total() is its number of tokens."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        self.encoded = 0
        pieces = counter.pattern.findall(text)
        self._arrange(pieces, self._counts(pieces))

    def _arrange(self, pieces: list[str], counts: list[int]) -> None:
        """Deal pre-tokens, whose counts are known, to leaves."""
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (own, n) in enumerate(self.leaves, self.width):
            self.chars[i], self.tokens[i] = sum(map(len, own)), sum(n)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _counts(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return self.counter.counts(pieces)

    def total(self) -> int:
        return self.tokens[1]

    def pieces(self) -> int:
        return sum(len(own) for own, _ in self.leaves)

    def text(self) -> str:
        return "".join(p for own, _ in self.leaves for p in own)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf with the character at, and where the leaf begins; the last leaf that has characters for the end."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if begin + self.chars[i] <= at and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Put new in the place of the characters from start to end of the text as it is now."""
        size = self.chars[1]
        if not 0 <= start <= end <= size:
            raise ValueError("an edit outside the text")
        first, begin = self._leaf(start)
        first, begin, inner = self._back(first, begin, start)
        # old pre-tokens from the boundary on, as far as they are needed
        old: list[str] = self.leaves[first][0][inner:]
        last = first
        reach = begin + sum(map(len, old))
        while reach < end + AHEAD and last + 1 < len(self.leaves):
            last += 1
            old = old + self.leaves[last][0]
            reach += self.chars[self.width + last]
        while True:
            before = "".join(old)
            after = before[: start - begin] + new + before[end - begin :]
            cut, used = self._cut(old, after, end - begin, len(new) - (end - start), last + 1 == len(self.leaves))
            if used is not None:
                break
            last += 1
            old = old + self.leaves[last][0]
        self._put(first, inner, used, cut)

    def _back(self, leaf: int, begin: int, start: int) -> tuple[int, int, int]:
        """A boundary AHEAD + 1 pre-tokens before start: its leaf, its place in the text and in the leaf."""
        at, inner = begin, 0
        for piece in self.leaves[leaf][0]:
            if at + len(piece) > start:
                break
            at += len(piece)
            inner += 1
        for _ in range(AHEAD + 1):
            while not inner and leaf:
                leaf -= 1
                inner = len(self.leaves[leaf][0])
            if not inner:
                break
            inner -= 1
            at -= len(self.leaves[leaf][0][inner])
        return leaf, at, inner

    def _cut(self, old: list[str], after: str, end: int, shift: int, whole: bool) -> tuple[list[str], int | None]:
        """New pre-tokens up to a boundary that old ones have, too, and how many old ones they replace."""
        bounds, at = {}, 0
        for k, piece in enumerate(old):
            if at >= end:
                bounds[at + shift] = k
            at += len(piece)
        bounds.setdefault(at + shift, len(old))
        cut, here = [], 0
        while here < len(after):
            if here in bounds and here >= end + shift and cut:
                return cut, bounds[here]
            found = self.counter.pattern.match(after, here)
            if not whole and max(found.end() + 1, here + AHEAD) > len(after):
                return cut, None  # what follows might change this one
            cut.append(found[0])
            here = found.end()
        return cut, len(old) if whole else None

    def _put(self, first: int, inner: int, used: int, cut: list[str]) -> None:
        """Replace used pre-tokens from place inner of leaf first on by those cut anew."""
        counts = self._counts(cut)
        leaf, at, left = first, inner, used
        changed = []
        while True:
            own, n = self.leaves[leaf]
            gone = min(left, len(own) - at)
            fresh, fresh_n = (cut, counts) if leaf == first else ([], [])
            self.leaves[leaf] = own[:at] + fresh + own[at + gone :], n[:at] + fresh_n + n[at + gone :]
            changed.append(leaf)
            left -= gone
            if not left:
                break
            leaf, at = leaf + 1, 0
        if len(self.leaves[first][0]) > 4 * LEAF:
            # a large insert: leaves are dealt anew, with the counts that they have
            self._arrange([p for own, _ in self.leaves for p in own], [n for _, counts in self.leaves for n in counts])
            return
        for leaf in changed:
            i = self.width + leaf
            own, n = self.leaves[leaf]
            self.chars[i], self.tokens[i] = sum(map(len, own)), sum(n)
            while i > 1:
                i //= 2
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]


def read_ranks(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks from a vocabulary file: a path of the driver's machine, or one with a scheme, which Spark reads."""
    if "://" in path:
        found = spark.read.format("binaryFile").load(path)
        size = found.agg(F.sum("length")).first()[0]
        raw = bytes(found.first().content) if size <= VOCABULARY_BYTES else b"x" * (VOCABULARY_BYTES + 1)
    else:
        with open(path, "rb") as file:
            raw = file.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than what executors may be sent")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def counted(docs: DataFrame, edits: Callable[[str], Iterable[tuple[int, int, str]]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_edits, n_encoded_again, n_pretokens_after, n_tokens_after) for each row of docs.

    edits: from a text to its edits (start, end, new text) in code points of the original; they must not overlap. They
    are applied from the last to the first. n_encoded_again: pre-tokens that the edits had cut and encoded anew. Null
    and empty texts have no tokens. Repeated rows are counted each; other columns are not read.
    """
    send = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, vocabulary))

    def make() -> Callable:
        counter = Counter(send.value)

        def step(columns: list[list]) -> list:
            out: list[list] = [columns[0], [], [], [], [], [], []]
            for raw in columns[1]:
                text = raw.decode("utf-8", "replace") if raw else ""
                tree = CountedText(text, counter)
                facts = [tree.pieces(), tree.total()]
                once = tree.encoded
                changes = sorted(edits(text), reverse=True)
                for start, end, new in changes:
                    tree.edit(start, end, new)
                for column, fact in zip(out[1:], [*facts, len(changes), tree.encoded - once, tree.pieces(), tree.total()], strict=True):
                    column.append(fact)
            return out

        return step

    return map_texts(docs, ["doc_id", "text"], make, "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_encoded_again long, n_pretokens_after long, n_tokens_after long")
