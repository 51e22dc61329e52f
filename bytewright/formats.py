"""Ready-made machines: FASTA, tab-separated values, BED, numbers, URLs and a small programming language."""

from __future__ import annotations

from bytewright.operators.records import Append, Capture, Emit, Mark, Put, RecordParser
from bytewright.operators.tokens import Tokenizer
from bytewright.plans.regex import Regex, alt, cat, literal, opt, rep, rep1, rx

NEWLINE = rx("\r?\n")


def fasta() -> RecordParser:
    """>identifier description, then lines of the sequence."""
    identifier = rx("[^ \t\r\n>][^ \t\r\n]*").on_enter("mark").on_exit("identifier")
    description = rx("[^ \t\r\n][^\r\n]*").on_enter("mark").on_exit("description")
    line = rx("[A-Za-z*\\-]+").on_enter("mark").on_exit("sequence")
    record = cat(">", identifier, opt(cat(rx("[ \t]+"), description)), NEWLINE, rep(cat(opt(line), NEWLINE)))
    steps = {"mark": Mark(), "identifier": Capture("identifier"), "description": Capture("description"), "sequence": Append("sequence"), "record": Emit()}
    return RecordParser(rep(record.on_exit("record")), steps, "identifier string, description string, sequence string")


def delimited(columns: list[str], types: list[str] | None = None, separator: str = "\t", header: bool = False) -> RecordParser:
    """Lines with exactly these columns; with a header, the first line names them and is no record."""
    value = f"[^{separator}\r\n]"
    fields = [rx(f"{value}*").on_enter(f"mark {i}").on_exit(f"field {i}") for i in range(len(columns))]
    parts: list[Regex] = []
    for i, field in enumerate(fields):
        parts += [literal(separator)] * bool(i) + [field]
    # a field that is empty has no first byte of its own: its mark is where the one behind it is
    row = cat(*parts).on_exit("row")
    lines = rep(cat(row, NEWLINE))
    first = cat(*[p for i, c in enumerate(columns) for p in ([literal(separator)] * bool(i) + [literal(c)])], NEWLINE)
    steps = {f"mark {i}": Mark() for i in range(len(columns))} | {f"field {i}": Capture(c) for i, c in enumerate(columns)} | {"row": Emit()}
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, types or ["string"] * len(columns), strict=True))
    return RecordParser(first * lines if header else lines, steps, schema)


def bed3() -> RecordParser:
    chrom = rx("[A-Za-z0-9_.]+").on_enter("mark").on_exit("chrom")
    start = rx("[0-9]+").on_enter("mark").on_exit("start")
    end = rx("[0-9]+").on_enter("mark").on_exit("end")
    line = cat(chrom, "\t", start, "\t", end).on_exit("line") * NEWLINE
    steps = {"mark": Mark(), "chrom": Capture("chrom"), "start": Capture("start"), "end": Capture("end"), "line": Emit()}
    return RecordParser(rep(line), steps, "chrom string, start long, end long")


def numbers() -> RecordParser:
    """Numbers between blanks: oct, dec, hex and float, with their text."""
    kinds = {
        "oct": rx("0o[0-7]+"),
        "dec": rx("[-+]?[0-9]+"),
        "hex": rx("0x[0-9A-Fa-f]+"),
        "float": rx("[-+]?[0-9]*\\.[0-9]+([eE][-+]?[0-9]+)?") | rx("[-+]?[0-9]+\\.([eE][-+]?[0-9]+)?") | rx("[-+]?[0-9]+[eE][-+]?[0-9]+"),
    }
    number = alt(*[x.on_exit(kind) for kind, x in kinds.items()]).on_enter("mark")
    blank = rx("[ \t\n]")
    return RecordParser(
        cat(rep(blank), opt(cat(number, rep(cat(rep1(blank), number)), rep(blank)))),
        {"mark": Mark()} | {k: (Capture("text"), Put("kind", k), Emit()) for k in kinds},
        "kind string, text string",
    )


def url() -> RecordParser:
    """scheme://host[/path][?query][#fragment] in one record."""
    scheme = rx("[a-z]+").on_enter("mark").on_exit("scheme")
    host = rx("[^/?#:]+").on_enter("mark").on_exit("host")
    path = rx("/[^?#]*").on_enter("mark").on_exit("path")
    query = rx("[^#]+").on_enter("mark").on_exit("query")
    fragment = rx("(.)+").on_enter("mark").on_exit("fragment")
    whole = cat(scheme, "://", host, opt(path), opt(cat("?", opt(query))), opt(cat("#", opt(fragment)))).on_exit("end")
    fields = ("scheme", "host", "path", "query", "fragment")
    return RecordParser(whole, {"mark": Mark(), "end": Emit()} | {f: Capture(f) for f in fields}, ", ".join(f"{f} string" for f in fields))


def language() -> Tokenizer:
    """Tokens of a small programming language; keywords win over identifiers as they come later."""
    marks = {"colon": ":", "comma": ",", "dot": "\\.", "equal": "=", "less": "<", "greater": ">", "plus": "\\+", "minus": "\\-", "times": "\\*", "lparen": "\\(", "rparen": "\\)", "lbracket": "\\[", "rbracket": "]", "lbrace": "{", "rbrace": "}"}
    words = ["function", "if", "else", "elseif", "while", "end", "return"]
    spaced = {"space": "[ \t]+", "newline": "\r?\n", "comment": "#[^\r\n]*", "string": '"[^"]*"', "number": "[0-9]+(\\.[0-9]+)?", "identifier": "[A-Za-z_][0-9A-Za-z_!]*"}
    return Tokenizer([(n, rx(p)) for n, p in (spaced | marks).items()] + [(w, rx(w)) for w in words])
