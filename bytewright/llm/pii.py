"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The base kinds (email, ip, card, phone) are defined by patterns and always stay. Everything else in a text that may be
personal, such as secrets, account numbers, e-mail addresses written out in words and national telephone numbers, is
proposed as candidate segments with several possible boundaries and kinds: account numbers, numbers and contacts from
each token to each token that the pattern allows, while secrets have no blanks and end where their run ends. A log-linear model over whole segments
(their kind together with shape, length, checksum and the words in front) scores each candidate; dynamic programming
over segments in order of their ends picks the best set of segments that do not overlap each other or a base span. All
patterns bound an entity's length, so a segment looks back over a bounded number of characters.

The weights are trained here by maximum likelihood: the forward-backward recursions over the same lattice of candidate
segments give expected feature counts. Training texts are made by rule, with a fixed seed and with decoys (dates,
prices, versions, identifiers), as no table marks personal data of these kinds.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, slices

#: The base kinds in their order, then those of the model.
BASE = ("email", "ip", "card", "phone")
LEARNED = ("account", "contact", "number", "secret")
KINDS = BASE + LEARNED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, from each @ outwards: linear however long a run of letters is."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, by kind and start."""
    out = [Span("email", a, b) for a, b in emails(text)]
    out += [Span("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        number = digits_of(m[0])
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(Span("card", m.start(), m.end()))
    if "+" in text:
        out += [Span("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# Candidates: every repetition is bounded.
PROPOSALS: tuple[tuple[str, re.Pattern, str], ...] = (
    ("account", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){9,33}(?![0-9A-Za-z])"), "digits"),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![0-9A-Za-z])"), "digits"),
    ("number", re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?[ ./-][0-9]{2,5}(?:[ ./-][0-9]{2,5}){0,3}(?![0-9A-Za-z])"), "digits"),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{16,8192}+(?![0-9A-Za-z_/+-])={0,2}(?![0-9A-Za-z])"), "run"),
    ("secret", re.compile(r"(?<=[\"'])[^\s\"']{8,8192}+(?=[\"'])"), "quotes"),
    ("secret", re.compile(r"(?<=[:=] )[^\s\"']{8,8192}+(?=\s|\Z)"), "any"),
    ("contact", re.compile(r"(?<![0-9A-Za-z._-])[A-Za-z0-9._-]{1,40} ?[\[({]? ?(?:at|AT|arroba) ?[\])}]? ?[A-Za-z0-9-]{1,40}(?: ?[\[({]? ?(?:dot|DOT|punto|point|punkt)(?![A-Za-z]) ?[\])}]? ?[A-Za-z0-9-]{2,20}){1,3}(?![0-9A-Za-z])"), "dot"),
)
#: What a text must have for a pattern to match anywhere in it; each follows from its pattern.
NEEDS = {"run": re.compile(r"[0-9A-Za-z_/+-]{16}").search, "digits": re.compile(r"[0-9]").search, "quotes": re.compile(r"[\"']").search, "any": re.compile(r"[:=] ").search, "dot": re.compile(r"(?:dot|DOT|punto|point|punkt)(?![A-Za-z])").search}
TOKEN = re.compile(r"[0-9A-Za-z]+")
BEFORE = 24
CUE = re.compile(r"[^\W\d_]+")
#: Words in front that tell kinds apart.
CUES = {w: kind for kind, words in {"secret": "token key secret password passwd pwd apikey auth bearer passwort", "account": "account iban konto card visa cuenta compte passport", "number": "phone tel call telephone fax mobile telefon teléfono ring", "contact": "mail email contact write kontakt correo", "other": "version chapter page order isbn date price id invoice build"}.items() for w in words.split()}


def segments(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """All matches of the pattern that begin and end with tokens, overlapping ones included."""
    for m in pattern.finditer(text):
        tokens = [t.start() for t in TOKEN.finditer(text, *m.span())]
        for start in sorted({m.start(), *tokens, *(t - 1 for t in tokens if t > m.start() and text[t - 1] == "(")}):
            longest = pattern.match(text, start)
            if longest:
                yield longest.span()
                yield from ((start, t.end()) for t in TOKEN.finditer(text, start, longest.end()) if pattern.fullmatch(text, start, t.end()))


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Segments that the model may choose, by end and start; none overlaps a base span."""
    found = set()
    able = {need: bool(test(text)) for need, test in NEEDS.items()}
    for kind, pattern, need in PROPOSALS:
        if able[need]:
            places = (m.span() for m in pattern.finditer(text)) if kind == "secret" else segments(pattern, text)
            found.update(Span(kind, a, b) for a, b in places)
    if not found:
        return []
    edges = sorted((s.start, s.end) for s in taken)
    free = []
    i, reach = 0, -1
    for span in sorted(found, key=lambda s: (s.start, s.end)):
        while i < len(edges) and edges[i][0] <= span.start:
            reach = max(reach, edges[i][1])
            i += 1
        if reach <= span.start and (i == len(edges) or edges[i][0] >= span.end):
            free.append(span)
    return sorted(free, key=lambda s: (s.end, s.start, s.kind))


def features(text: str, span: Span) -> list[str]:
    """Whole-segment features, each joined with the kind."""
    segment = text[span.start : span.end]
    number = digits_of(segment)
    letters = [c for c in segment if c.isalpha()]
    before = text[max(0, span.start - BEFORE) : span.start]
    words = [w.lower() for w in CUE.findall(before)][-2:]
    cues = {CUES[w] for w in words if w in CUES}
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "_" if c == " " else c for c in segment[:24]))
    hexed = bool(letters) and all(c in "0123456789abcdefABCDEF" for c in segment)
    facts = [
        "bias", f"digits {min(len(number), 20)}", f"share {0 if not segment else round(4 * len(number) / len(segment))}", f"length {min(len(segment).bit_length(), 8)}",
        f"hex {hexed}", f"mixed {bool(number) and bool(letters)}", f"case {len({c.isupper() for c in letters})}", f"assigned {bool(re.search(r'[:=] ?[^A-Za-z0-9]?$', before))}",
        f"quoted {before[-1:] in (chr(34), chr(39))}", f"groups {min(5, len(re.split(r'[ ./-]+', segment)))}", f"luhn {len(number) >= 12 and luhn(number)}", f"words {bool(re.search(r'[ \[(](?:at|AT|arroba)[ \])]', segment))}",
    ]
    facts += [f"cue {c}" for c in sorted(cues)] or ["cue none"]
    if len(shape) <= 12:
        facts.append(f"shape {shape}")
    return [f"{span.kind} {f}" for f in facts]


def score(text: str, span: Span, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in features(text, span))


def best(spans: list[Span], scores: list[float]) -> list[Span]:
    """The set of segments without overlaps whose scores add up to most; text outside segments scores 0."""
    ends = [s.end for s in spans]
    total, back = [0.0], []
    for i, span in enumerate(spans):
        j = _before(ends, span.start, i)
        taken = total[j] + scores[i]
        back.append(j if taken > total[i] else -1)
        total.append(max(total[i], taken))
    out, i = [], len(spans)
    while i:
        if back[i - 1] >= 0:
            out.append(spans[i - 1])
            i = back[i - 1]
        else:
            i -= 1
    return out[::-1]


def _before(ends: list[int], start: int, i: int) -> int:
    """How many of the first i segments end at start or before it."""
    return bisect_right(ends, start, 0, i)


def marginals(spans: list[Span], scores: list[float]) -> list[float]:
    """The probability of each segment, by the forward and backward recursions."""
    ends = [s.end for s in spans]
    prior = [_before(ends, s.start, i) for i, s in enumerate(spans)]
    forward = [0.0]
    for i in range(len(spans)):
        forward.append(_log_add(forward[i], forward[prior[i]] + scores[i]))
    backward = [-math.inf] * len(spans) + [0.0]
    for i in range(len(spans) - 1, -1, -1):
        backward[i] = _log_add(backward[i], backward[i + 1])
        backward[prior[i]] = _log_add(backward[prior[i]], backward[i + 1] + scores[i])
    return [math.exp(forward[prior[i]] + scores[i] + backward[i + 1] - forward[-1]) for i in range(len(spans))]


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def training_texts(n: int = 600, seed: int = 7) -> Iterator[tuple[str, list[Span]]]:
    """Texts with entities and decoys, and the spans of the entities."""
    draw = random.Random(seed)

    def some(letters: str, low: int, high: int = 0) -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(low, high or low)))

    lower, figures, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    upper = lower.upper()

    def word() -> str:
        return some(lower, 2, 12)

    made: list[Callable[[], tuple[str, str, str, str]]] = [
        lambda: ("secret", draw.choice(["token", "key", "secret", "api_key", "password"]) + draw.choice([" = ", "=", ": "]) + '"', some(hexes, *draw.choice([(32, 32), (40, 40), (64, 64)])), '"'),
        lambda: ("secret", draw.choice(["TOKEN", "KEY", "SECRET"]) + ' = "', some(hexes.upper(), 40), '"'),
        lambda: ("secret", draw.choice(["password", "Passwort", "pwd"]) + ": ", some(lower + figures, 4, 8) + some(figures + "!#%", 4, 8), ""),
        lambda: ("secret", draw.choice(["", "token ", "bearer "]), some(upper + lower + figures, 24, 48), ""),
        lambda: ("account", draw.choice(["", "card ", "Konto ", "account "]), some(figures, 16), ""),
        lambda: ("account", draw.choice(["", "card "]), " ".join(some(figures, 4) for _ in range(4)), ""),
        lambda: ("account", draw.choice(["", "IBAN ", "iban "]), some(upper, 2) + some(figures, 2) + " " + " ".join(some(figures, 4) for _ in range(4)), ""),
        lambda: ("account", "IBAN ", some(upper, 2) + some(figures, 20), ""),
        lambda: ("number", draw.choice(["", "tel ", "call ", "phone: "]), f"({some(figures, 3)}) {some(figures, 3)}-{some(figures, 4)}", ""),
        lambda: ("number", draw.choice(["tel. ", "call ", "phone "]), f"{some(figures, 3)}-{some(figures, 3)}-{some(figures, 4)}", ""),
        lambda: ("contact", draw.choice(["", "mail ", "write to "]), word() + draw.choice([" at ", " (at) ", " [at] "]) + word() + draw.choice([" dot ", " (dot) ", " [dot] "]) + draw.choice(["com", "org", "net"]), ""),
    ]
    decoys: list[Callable[[], str]] = [
        lambda: f"{draw.randint(1900, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}",
        lambda: f"{draw.randint(1, 28):02}/{draw.randint(1, 12):02}/{draw.randint(1900, 2030)}",
        lambda: f"version {some(figures, 1)}.{some(figures, 1)}",
        lambda: f"{some(figures, 1, 3)},{some(figures, 3)}.{some(figures, 2)}",
        lambda: f"order {some(figures, 4, 8)}",
        lambda: f"pages {some(figures, 2, 3)}-{some(figures, 2, 3)}",
        lambda: f"{some(figures, 10, 12)} items",
        lambda: f'"{word()}{word()}"',
        lambda: f"{word().capitalize()}: {word()}{word()}",
        lambda: some(lower, 16, 30),
        lambda: "-".join(word() for _ in range(4)),
        lambda: f"{word()} at {word()} dotted {word()}",
        lambda: f"https://{word()}.example.com/{word()}/{some(figures, 3)}",
        lambda: f"{word()}_{word()}_{word()}_{word()}",
    ]
    for _ in range(n):
        text, spans = "", []
        for _ in range(draw.randint(2, 6)):
            text += " ".join(word() for _ in range(draw.randint(1, 8))) + draw.choice([" ", ". ", ", ", "\n"])
            if draw.random() < 0.5:
                kind, front, segment, behind = draw.choice(made)()
                text += front
                spans.append(Span(kind, len(text), len(text) + len(segment)))
                text += segment + behind
            else:
                text += draw.choice(decoys)()
            text += draw.choice([" ", ". ", ", ", "\n"])
        yield text, spans


def train(n: int = 600, rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 7) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood of the made texts' segmentations."""
    lattices = []
    for text, truth in training_texts(n, seed):
        taken = base_spans(text)
        spans = candidates(text, taken)
        wanted = set(truth)
        lattices.append((spans, [features(text, s) for s in spans], [s in wanted for s in spans]))
    weights: dict[str, float] = defaultdict(float)
    draw = random.Random(seed)
    for turn in range(rounds):
        draw.shuffle(lattices)
        step = rate / (1 + turn)
        for spans, facts, gold in lattices:
            if not spans:
                continue
            p = marginals(spans, [sum(weights[f] for f in own) for own in facts])
            for own, q, right in zip(facts, p, gold, strict=True):
                for f in own:
                    weights[f] += step * (right - q - decay * weights[f])
    return dict(weights)


def find(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans and the model's additional ones, each by kind and start."""
    base = base_spans(text)
    spans = candidates(text, base)
    chosen = best(spans, [score(text, s, weights) for s in spans]) if spans else []
    return base, sorted(chosen, key=lambda s: (KINDS.index(s.kind), s.start))


def replacements(spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, <kind>) for spans; those that overlap become one, of the kind that begins first."""
    out: list[tuple[int, int, str]] = []
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if out and span.start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], span.end), out[-1][2]
        else:
            out.append((span.start, span.end, f"<{span.kind}>"))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with <kind> in the place of each span."""
    out, at = [], 0
    for start, end, new in replacements(spans):
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def spans_of(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, base, learned) for each row of docs: arrays of (kind, start, end), in code points with exclusive ends.

    Null and empty texts have no spans. Repeated rows give repeated rows; other columns are not read.
    """
    weights = train() if weights is None else weights

    def make() -> Callable:
        def step(columns: list[list]) -> list:
            out: list[list] = [columns[0], [], []]
            for text in columns[1]:
                base, learned = find(text.decode("utf-8", "replace"), weights) if text else ((), ())
                out[1].append([s._asdict() for s in base])
                out[2].append([s._asdict() for s in learned])
            return out

        return step

    kind = "array<struct<kind: string, start: long, end: long>>"
    return map_texts(docs, ["doc_id", "text"], make, f"doc_id long, base {kind}, learned {kind}")


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with personal data in text replaced by <kind> and n_chars, where there is such a column, counted anew."""
    weights = train() if weights is None else weights
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in slices(batch, at):
                texts = [t if t is None else redacted(t, [*b, *x]) for t in part.column(at).to_pylist() for b, x in [find(t, weights) if t else ((), ())]]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
