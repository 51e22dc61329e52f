"""Toxicity by a weighted finite-state pattern grammar over clauses.

Texts are cut into clauses, and the words of a clause into classes: insult, threat, target, negation, reported speech
and other. A transducer for each kind of evidence reads the classes and gives each step a weight and a factor;
their composition (the product automaton) reads a clause once. An insult counts more near a target, less behind a
negation or in reported speech, and a threat counts with a target only. Words alone are not scored: a clause is.

Which words insult is learned from the labels: words and beginnings of words that are frequent in toxic training texts
and all but absent from clean ones are candidates. The training texts are divided in two by their longest words, which
copies and near copies share, and a candidate stays if it holds in each part by itself, so what copies of one text
brought along goes. The sum of a text's clauses becomes a probability by a
logistic curve fitted on the training texts.

The classifier is fitted on at most ``sample`` labelled rows, those with the smallest hash of their ids; a bounded
number of ids can be sent to the texts, so fitting never shuffles texts. Scoring covers every row and whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 200_000
#: Words that a task remembers; when they are more, it begins anew.
REMEMBERED = 1 << 15
#: Candidates for insults at most that are looked at in both parts of the training texts: those of most weight.
CANDIDATES = 2000

# Words of the closed classes, in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself they them their he him his she her these those people everyone du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos eux ils elles tú ti tus usted ustedes vosotros ellos ellas".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn hang murder crush punch töten umbringen schlagen vernichten verletzen tuer frapper détruire brûler blesser matar golpear destruir quemar herir".split())
NEGATIONS = frozenset("not no never none neither nor without hardly don't isn't aren't wasn't nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin".split())
REPORTS = frozenset("said says say told tells called calls wrote writes claimed claims quoted reported sagte sagt nannte schrieb behauptete dit disait appelé écrit prétend dijo dice llamó escribió afirma".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
SHORTEST, LONGEST = 3, 6

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """step maps (state, class) to (state, weight, factor); the start state is 0."""

    step: Callable[[int, int], tuple[int, float, float]]


def _target(reach: int, bonus: float) -> Transducer:
    """An insult within reach words of a target weighs more, on either side. States: 0; 1.. reach since a target; -1.. since an insult."""

    def step(state: int, kind: int) -> tuple[int, float, float]:
        gone = 0 if abs(state) >= reach else state + (state > 0) - (state < 0)
        if kind == INSULT:
            return -1, bonus if state > 0 else 0.0, 1.0
        if kind == TARGET:
            return 1, bonus / 2 if state < 0 else 0.0, 1.0
        return gone, 0.0, 1.0

    return Transducer(step)


def _negation(reach: int, factor: float) -> Transducer:
    def step(state: int, kind: int) -> tuple[int, float, float]:
        if kind == NEGATION:
            return 1, 0.0, 1.0
        return (0 if not state or state >= reach else state + 1), 0.0, factor if state and kind in (INSULT, THREAT) else 1.0

    return Transducer(step)


def _report(factor: float) -> Transducer:
    def step(state: int, kind: int) -> tuple[int, float, float]:
        return (1 if kind == REPORT or state else 0), 0.0, factor if state else 1.0

    return Transducer(step)


def _threat(reach: int, weight: float) -> Transducer:
    """A threat with a target within reach words."""

    def step(state: int, kind: int) -> tuple[int, float, float]:
        if kind == THREAT:
            return 1, 0.0, 1.0
        if kind == TARGET and state:
            return 0, weight, 1.0
        return (0 if not state or state >= reach else state + 1), 0.0, 1.0

    return Transducer(step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read each class; weights add up and factors multiply. A state is the pair of theirs, numbered as they come."""
    pairs: list[tuple[int, int]] = [(0, 0)]
    number: dict[tuple[int, int], int] = {(0, 0): 0}
    known: dict[tuple[int, int], tuple[int, float, float]] = {}

    def step(state: int, kind: int) -> tuple[int, float, float]:
        if (state, kind) not in known:
            (sa, wa, fa), (sb, wb, fb) = a.step(pairs[state][0], kind), b.step(pairs[state][1], kind)
            if (sa, sb) not in number:
                number[sa, sb] = len(pairs)
                pairs.append((sa, sb))
            known[state, kind] = number[sa, sb], wa + wb, fa * fb
        return known[state, kind]

    return Transducer(step)


def grammar(reach: int = 4, target: float = 0.25, negated: float = 0.25, reported: float = 0.5, threat: float = 1.0) -> Transducer:
    return reduce(compose, [_threat(reach, threat), _target(reach, target), _negation(reach, negated), _report(reported)])


@dataclass
class Model:
    """insults: weights of words, and of beginnings of words (^...). curve: intercept, slope."""

    insults: dict[str, float]
    curve: tuple[float, float]


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))]


class Scorer:
    """Scores texts. Most texts hold no insult or threat at all, which one scan for all of them tells."""

    def __init__(self, insults: dict[str, float], machine: Transducer | None = None) -> None:
        self.insults, self.machine = insults, machine or grammar()
        self.tree = ahocorasick.Automaton()
        for term in [f.removeprefix("^") for f in insults] + sorted(THREATS):
            self.tree.add_word(term, True)
        self.tree.make_automaton()
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The weight of a word as an insult, or 0."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = max([self.insults[f] for f in features(word) if f in self.insults], default=0.0)
        return found

    def evidence(self, text: str) -> float:
        """The sum over a text's clauses of what the grammar gives them; 0 without matches."""
        text = text.lower()
        if next(self.tree.iter(text), None) is None:
            return 0.0
        total = 0.0
        for clause in CLAUSE.split(text):
            found = WORD.findall(clause)
            weights = [self.weight(w) for w in found]
            if not any(weights) and THREATS.isdisjoint(found):
                continue
            state = 0
            for word, w in zip(found, weights, strict=True):
                kind = INSULT if w else THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER
                state, weight, factor = self.machine.step(state, kind)
                total += (w + weight) * factor
        return total


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of the labelled documents whose crc32(doc_id) mod 3 is not 1, of at most sample labels."""
    known = labels.where("toxic is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null").select("toxic", "text")


def words_of(text: bytes) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def part_of(words: set[str]) -> int:
    """0 or 1, by the longest word (of equally long ones the last)."""
    return zlib.crc32(max(words, key=lambda w: (len(w), w)).encode()) & 1 if words else 0


def _picker(wanted: frozenset) -> Callable[[set[str]], set[str]]:
    """What finds the wanted features among words. Few words have any, and those without are the same empty tuple."""
    known: dict[str, tuple[str, ...]] = {}

    def pick(words: set[str]) -> set[str]:
        out: set[str] = set()
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) > REMEMBERED:
                    known.clear()
                found = known[w] = tuple(f for f in features(w) if f in wanted)
            out.update(found)
        return out

    return pick


def _counts(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(feature, n): in how many of the texts each feature occurs; of all features or of those wanted."""

    def make() -> Callable:
        pick = _picker(wanted) if wanted is not None else lambda words: {f for w in words for f in features(w)}

        def step(columns: list[list]) -> list:
            found: Counter = Counter()
            for text in columns[0]:
                found.update(pick(words_of(text)))
            return [list(found), list(found.values())]

        return step

    return map_texts(rows, ["text"], make, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _incidence(rows: DataFrame, wanted: frozenset) -> list[tuple[int, int, frozenset, int]]:
    """(toxic, part, the wanted features that a text has, how many texts); at most a row for each row of the sample."""

    def make() -> Callable:
        pick = _picker(wanted)

        def step(columns: list[list]) -> list:
            words = [words_of(t) for t in columns[1]]
            return [columns[0], [part_of(w) for w in words], [sorted(pick(w)) for w in words]]

        return step

    found = map_texts(rows, ["toxic", "text"], make, "toxic int, part int, features array<string>").groupBy("toxic", "part", "features").count().collect()
    return [(r[0], r[1], frozenset(r[2]), r[3]) for r in found]


def chosen(found: list[tuple[int, int, frozenset, int]], candidates: dict[str, float], least: int = 2, precision: float = 0.9) -> list[str]:
    """The candidates that hold in each part of the training texts by itself, the most frequent in toxic ones first.

    They hold in a part if least toxic texts have them there, and precision of all texts that have them are toxic. Of
    words and the beginnings of the same words the most frequent (then the heavier, the longer, the first) stands for
    the others.
    """
    every: Counter = Counter()
    toxic: Counter = Counter()
    for label, part, own, n in found:
        for f in own:
            every[f, part] += n
            toxic[f, part] += n * label
    parts = {part for _, part, _, _ in found}
    able = [f for f in candidates if all(toxic[f, p] >= least and toxic[f, p] >= precision * every[f, p] for p in parts)]
    out: list[str] = []
    for f in sorted(able, key=lambda f: (-sum(toxic[f, p] for p in parts), -candidates[f], -len(f), f)):
        stem = f.removeprefix("^")
        if not any(c[0] == "^" and stem.startswith(c[1:]) or f[0] == "^" and c.removeprefix("^").startswith(stem) for c in out):
            out.append(f)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_share: float = 0.005, ratio: float = 20.0) -> Model:
    """Learn the insults and the curve.

    least_share: of the toxic texts that a feature must occur in (and in 3 of them) to be a candidate. ratio: how many
    times more frequent than in clean texts it must be. Features and counts that reach the driver are bounded by the
    share and the sample. Without toxic or without clean training texts there is nothing to learn: no insults, and
    threats alone count.
    """
    rows = training_rows(docs, labels, sample)
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, (-3.0, 3.0))
    toxic, clean = rows.where("toxic = 1").select("text"), rows.where("toxic = 0").select("text")
    least = max(3, math.ceil(least_share * n1))
    in_toxic = dict(map(tuple, _counts(toxic, None).where(F.col("n") >= least).collect()))
    in_clean = dict(map(tuple, _counts(clean, frozenset(in_toxic)).collect()))

    def odds(f: str) -> float:
        return math.log((in_toxic[f] + 0.5) / (n1 + 1)) - math.log((in_clean.get(f, 0) + 0.5) / (n0 + 1))

    precise = sorted((f for f in in_toxic if odds(f) >= math.log(ratio)), key=lambda f: (-in_toxic[f] * odds(f), f))[:CANDIDATES]
    weights = {f: odds(f) for f in precise}
    taken = chosen(_incidence(rows, frozenset(precise)), weights) if precise else []
    most = max((weights[f] for f in taken), default=1.0)
    insults = {f: weights[f] / most for f in taken}
    return Model(insults, _curve(rows, insults))


def _curve(rows: DataFrame, insults: dict[str, float], width: float = 0.05) -> tuple[float, float]:
    """Logistic curve over log(1 + evidence), fitted with a weak prior on a histogram of the training texts."""

    def make() -> Callable:
        scorer = Scorer(insults)

        def step(columns: list[list]) -> list:
            return [columns[0], [round(math.log1p(scorer.evidence(t.decode("utf-8", "replace"))) / width) for t in columns[1]]]

        return step

    bins = map_texts(rows, ["toxic", "text"], make, "toxic int, bin long").groupBy("toxic", "bin").count().collect()
    y, x, n = (np.array([r[i] for r in bins], float) for i in range(3))
    design, theta = np.stack([np.ones_like(x), x * width], 1), np.array([-2.0, 1.0])
    n *= 1000 / max(1000.0, n.sum())  # the prior counts as a thousandth of the rows at least
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.1 * (theta - [-2.0, 1.0])
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(max(theta[1], 0.1))


def probability(text: bytes | None, model: Model, scorer: Scorer) -> float:
    found = scorer.evidence(text.decode("utf-8", "replace")) if text else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.curve[0] + model.curve[1] * math.log1p(found)))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs; null and empty texts have no clauses and get the curve's lowest value."""

    def make() -> Callable:
        scorer = Scorer(model.insults)

        def step(columns: list[list]) -> list:
            return [columns[0], [probability(t, model, scorer) for t in columns[1]]]

        return step

    return map_texts(docs, ["doc_id", "text"], make, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns; decided row by row."""

    def make() -> Callable:
        scorer = Scorer(model.insults)
        return lambda texts: [probability(t, model, scorer) < threshold for t in texts]

    return filter_texts(docs, make)
