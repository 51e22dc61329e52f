"""Queries over small literal inputs whose results are published: each has its inputs and its expected rows here.

The Spark side runs the operators; the SQL side lists what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright import formats
from bytewright.functions import columns as B
from bytewright.operators.records import RecordParser, parse_records
from bytewright.operators.tokens import Tokenizer, tokenize
from bytewright.plans.automata import compile_regex
from bytewright.plans.byteset import ByteSet
from bytewright.plans.regex import Regex, RegexError, cat, literal, opt, rep, rep1, rx
from bytewright.streaming.chunks import final_states, first_errors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(names: dict[str, str], rows: Iterable[tuple]) -> str:
    """SQL for rows with names and types."""
    casts = ", ".join(f"{n}::{t} AS {n}" for n, t in names.items())
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _inputs(spark: SparkSession, data: list[bytes], first: int = 1) -> DataFrame:
    """(case_no, data) with a binary column, numbered from first on."""
    rows = ", ".join(f"({i}, X'{d.hex()}')" for i, d in enumerate(data, first))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(case_no, data)")


def _numbered(cases: list[tuple]) -> list[tuple[int, tuple]]:
    return list(enumerate(cases, 1))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Published inputs and results.
_FASTA = "(>[ -~]*\r?\n([A-Za-z]*\r?\n)*)*"
MATCHES: list[tuple[Regex, list[bytes], list[bytes]]] = [
    (rx(_FASTA), [b"", b">\naa\n", b">seq1\n", b">seq1\na\n", b">seq1\nac\ngt\n", b">seq1\r\nacgt\r\n", b">seq1\nac\n>seq2\ngt\n"], [b"a", b">", b">seq1\na", b">seq1\nac\ngt"]),
    (rx("a[ab]*") & rx("[ab]*b"), [b"aab", b"ab", b"abab", b"abb", b"abbb"], [b"", b"a", b"aba", b"b", b"bab"]),
    (rx("a.*b"), [b"ab", b"azb", b"azzzb"], [b"azzz", b"zzzb"]),
    (rx("a\\.*b"), [b"ab", b"a.b", b"a...b"], [b"azzzb", b"a...", b"...b"]),
    (rx("a\\.\\*b"), [b"a.*b"], [b"a...b"]),
    (rx("[^A-Z]"), [b"1", b"a"], [b"A"]),
    (rx("[A-Z]+") & rx("FOO?"), [b"FO", b"FOO"], [b"foo"]),
    (rx("[A-Z]+") - rx("foo"), [b"FOO"], [b"foo"]),
    (~rx("foo"), [b"bar"], [b"foo"]),
    (rx("A+(B+C)*(D|E)+"), [b"ABCD", b"AABCD", b"AAABBCD", b"AAAABCD", b"AAAABBBBBCD"], []),
    (rx("[a\\-c]"), [b"-"], [b"b"]),
    (rx("[a-c]"), [b"b"], [b"-"]),
    (rx("øæ"), ["øæ".encode()], ["æ".encode(), "ø".encode()]),
    (rx("[\\x1a-\\x29\\xaa-\\xf0]+"), [b"\xd0\xe9", b"\x20\xaa\xf0"], [b"", b"\x20\xaa\xf1"]),
    (rx("[AB]") & rx("A"), [b"A"], [b"B", b"AA", b"AB"]),
    (rx("(A|B|C|D)") - rx("[A-C]"), [b"D"], [b"AC", b"A", b"B", b"DD"]),
    (~rx("A[BC]D?E"), [b"ABCDE", b"ABCE"], [b"ABDE", b"ACE", b"ABE"]),
    (literal(""), [b""], [b"a"]),
    (rep(literal(b"\xff\x00")), [b"", b"\xff\x00\xff\x00"], [b"\xff", b"\xc3\xbf\x00"]),
]


def fixture_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole matches over bytes, invalid UTF-8 included; by the JVM where it can decide and by machines."""
    parts, at = [], 1
    for x, yes, no in MATCHES:
        found = _inputs(spark, yes + no, at)
        at += len(yes) + len(no)
        parts.append(found.select("case_no", B.matches("data", x, binary=True).alias("hit"), B.matches("data", x, binary=True, engine="arrow").alias("by_machine")))
    return _union(parts)


ORACLE_SQL["fixture_matches"] = _values({"case_no": "INTEGER", "hit": "BOOLEAN", "by_machine": "BOOLEAN"}, [(i, h, h) for i, h in enumerate((h for _, yes, no in MATCHES for h in [True] * len(yes) + [False] * len(no)), 1)])

_ESCAPES = b"\x00\x07\x08\t\n\x0b\r\x00\xff\xff\\"
_WORDS = "a(bc)*|(def)|x+|def|x+"
FIRST_ERRORS: list[tuple[str, bytes, int | None]] = [
    ("\\0\\a\\b\\t\\n\\v\\r\\x00\\xff\\xFF[\\\\][^\\\\]", _ESCAPES + b"!", None),
    ("\\0\\a\\b\\t\\n\\v\\r\\x00\\xff\\xFF[\\\\][^\\\\]", _ESCAPES + b"\\", 12),
    ("\\0\\a\\b\\t\\n\\v\\r\\x00\\xff\\xFF[\\\\][^\\\\]", _ESCAPES, 0),
    ("(>[a-z]+\n([ACGT]+\n)+)*", b">hello\nTAGAGA\nTAGAG", 0),
    ("(>[a-z]+\n([ACGT]+\n)+)*", b">helloXXX", 7),
    ("(>[a-z]+\n([ACGT]+\n)+)*", b">hello\nTAGAGA\nTAGAG\n", None),
    *((_WORDS, w, None) for w in (b"def", b"abc", b"abcbcbcbcbc", b"x", b"xxxxxx")),
    (_WORDS, b"", 0), (_WORDS, b"abcabc", 4), (_WORDS, b"abcbb", 5), (_WORDS, b"abcbcb", 0), (_WORDS, b"defdef", 4), (_WORDS, b"xabc", 2),
]


def fixture_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([_inputs(spark, [data], i).select("case_no", B.first_error("data", x, binary=True).alias("err")) for i, (x, data, _) in _numbered(FIRST_ERRORS)])


ORACLE_SQL["fixture_first_errors"] = _values({"case_no": "INTEGER", "err": "INTEGER"}, [(i, err) for i, (_, _, err) in _numbered(FIRST_ERRORS)])

_HEAD, _LINES = "(>[a-z]+\n)+", "([a-z][a-z]+)(\n[a-z][a-z]+)*"
LOCATIONS: list[tuple[str, bytes, int | None, int | None, int | None]] = [
    (_HEAD, b">abc", None, 1, 4), (_HEAD, b">abc:a", 58, 1, 5), (_HEAD, b">", None, 1, 1), (_HEAD, b"", None, 1, 0), (_HEAD, b">abc\n>def\n>ghi\n>j!", 33, 4, 3), (_HEAD, b">abc\n;", 59, 2, 1),
    (_LINES, b"abcd", None, None, None), (_LINES, b"aaaaaaaaaa!", 33, 1, 11), (_LINES, b"aaaaaaaaaa\nabc!", 33, 2, 4), (_LINES, b"abcdef\n\n", 10, 3, 0), (_LINES, b"abc!", 33, 1, 4),
    (_LINES, b"", None, 1, 0), (_LINES, b"a", None, 1, 1), (_LINES, b"ab\na", None, 2, 1), (_LINES, b"ab\naa\n\n", 10, 4, 0),
]


def fixture_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union([_inputs(spark, [data], i).select("case_no", B.error_location("data", x, binary=True).alias("e")) for i, (x, data, *_) in _numbered(LOCATIONS)])
    return found.select("case_no", F.col("e.byte").cast("int").alias("byte"), F.col("e.line").alias("line"), F.col("e.col").alias("col"))


ORACLE_SQL["fixture_locations"] = _values({"case_no": "INTEGER", "byte": "INTEGER", "line": "BIGINT", "col": "BIGINT"}, [(i, *x[2:]) for i, x in _numbered(LOCATIONS)])


def _nested() -> Regex:
    a = rx("a*").on_enter("enter_a").on_exit("exit_a")
    b = rx("bb*").on_enter("enter_b").on_exit("exit_b")
    ab = cat(a, b).on_enter("enter_ab").on_exit("exit_ab")
    return ab | cat(ab, "c").on_final("final_abc")


_KEYWORD = rx("if|else|end|while")
_SIX = "enter_ab,enter_a,exit_a,enter_b,exit_b,exit_ab"
ACTIONS: list[tuple[Callable[[], Regex], bytes, str, str]] = [
    (lambda: literal("").on_enter("enter").on_exit("exit"), b"", "ok", "enter,exit"), (lambda: literal("").on_enter("enter").on_exit("exit"), b"a", "error", ""),
    *((lambda: _KEYWORD.on_exit("keyword") | (rx("[a-z]+") - _KEYWORD).on_exit("ident"), w, "ok", "keyword") for w in (b"if", b"else", b"end", b"while")),
    *((lambda: _KEYWORD.on_exit("keyword") | (rx("[a-z]+") - _KEYWORD).on_exit("ident"), w, "ok", "ident") for w in (b"e", b"eif", b"i", b"iff")),
    (lambda: _KEYWORD.on_exit("keyword") | (rx("[a-z]+") - _KEYWORD).on_exit("ident"), b"1if", "error", ""),
    (lambda: rep(literal("a").on_all("a")), b"aaa", "ok", "a,a,a"), (lambda: rep(literal("a").on_all("a")), b"aaab", "error", "a,a,a"),
    (lambda: cat(*(rx(c).on_enter("enter").on_all("all").on_exit("exit") for c in ("a+", "b+"))), b"ab", "ok", "enter,all,exit,enter,all,exit"),
    (lambda: literal("abc").on_final("last"), b"abc", "ok", "last"), (lambda: literal("abc").on_final("last"), b"ab", "incomplete", ""),
    (lambda: cat(rx("a+").on_exit("x"), rx("b")).without_actions(), b"aab", "ok", ""),
]


def fixture_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of entering, leaving, final and all actions."""
    found = _union([_inputs(spark, [data], i).select("case_no", B.run("data", x(), binary=True).alias("r")) for i, (x, data, *_) in _numbered(ACTIONS)])
    return found.select("case_no", F.col("r.status").alias("status"), F.array_join("r.events.action", ",").alias("log"))


ORACLE_SQL["fixture_actions"] = _values({"case_no": "INTEGER", "status": "VARCHAR", "log": "VARCHAR"}, [(i, *x[2:]) for i, x in _numbered(ACTIONS)])

NESTED = [(b"b", "ok", _SIX), (b"ab", "ok", _SIX), (b"abb", "ok", _SIX), (b"abc", "ok", _SIX + ",final_abc"), (b"aabc", "ok", _SIX + ",final_abc"), (b"a", "incomplete", "enter_ab,enter_a")]


def fixture_nested_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of actions of nested expressions, some of which both branches share."""
    found = _inputs(spark, [d for d, *_ in NESTED]).select("case_no", B.run("data", _nested(), binary=True, unambiguous=False).alias("r"))
    return found.select("case_no", F.col("r.status").alias("status"), F.array_join("r.events.action", ",").alias("log"))


ORACLE_SQL["fixture_nested_actions"] = _values({"case_no": "INTEGER", "status": "VARCHAR", "log": "VARCHAR"}, [(i, *x[1:]) for i, x in _numbered(NESTED)])

TOKENS: list[tuple[list[str], bytes, list[tuple[int, int, int]]]] = [
    (["a", "a*b", "cd"], b"aa", [(1, 1, 1), (2, 1, 1)]), (["a", "a*b", "cd"], b"ab", [(1, 2, 2)]), (["a", "a*b", "cd"], b"aab", [(1, 3, 2)]), (["a", "a*b", "cd"], b"abaabba", [(1, 2, 2), (3, 3, 2), (6, 1, 2), (7, 1, 1)]),
    (["a", "a*b", "cd"], b"c", [(1, 1, 0)]), (["a", "a*b", "cd"], b"ac", [(1, 1, 1), (2, 1, 0)]), (["a", "a*b", "cd"], b"abc", [(1, 2, 2), (3, 1, 0)]), (["a", "a*b", "cd"], b"acb", [(1, 1, 1), (2, 1, 0), (3, 1, 2)]),
    (["a", "a*b", "cd"], b"cdc", [(1, 2, 3), (3, 1, 0)]), (["a", "a*b", "cd"], b"", []),
    *((["ADF", "[A-Z]+", "[abcde]+", "abc", "ab[a-z]"], d, t) for d, t in [(b"!" * 11, [(1, 11, 0)]), (b"abca", [(1, 4, 3)]), (b"ADFADF", [(1, 6, 2)]), (b"AD", [(1, 2, 2)]), (b"ADF", [(1, 3, 2)]), (b"abc", [(1, 3, 5)]), (b"abe", [(1, 3, 5)])]),
    (["a", "b"], b"abxxxba", [(1, 1, 1), (2, 1, 2), (3, 3, 0), (6, 1, 2), (7, 1, 1)]), (["abc", "def"], b"abcxyzdef123", [(1, 3, 1), (4, 3, 0), (7, 3, 2), (10, 3, 0)]), (["x+"], b"\xff\xfexx\xc3", [(1, 2, 0), (3, 2, 1), (5, 1, 0)]),
]


def fixture_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tokens: the longest, then the last one listed; errors as one; bytes that are no UTF-8."""
    return _union([tokenize(_inputs(spark, [data], i), "data", Tokenizer(x), ["case_no"]).select("case_no", "seq", "start", "len", "token") for i, (x, data, _) in _numbered(TOKENS)])


ORACLE_SQL["fixture_tokens"] = _values({"case_no": "INTEGER", "seq": "INTEGER", "start": "BIGINT", "len": "INTEGER", "token": "INTEGER"}, [(i, k, *t) for i, (_, _, ts) in _numbered(TOKENS) for k, t in enumerate(ts, 1)])

NAMED = [(1, 2, "letters"), (3, 2, "error"), (5, 1, "rparens")]


def fixture_named_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Tokenizer([("lparens", "\\("), ("rparens", "\\)"), ("comma", ","), ("quote", '"'), ("space", " +"), ("letters", "[A-Za-z]+")])
    return tokenize(_inputs(spark, [b"XY!!)"]), "data", own, ["case_no"]).select("start", "len", "token")


ORACLE_SQL["fixture_named_tokens"] = _values({"start": "BIGINT", "len": "INTEGER", "token": "VARCHAR"}, NAMED)

NUMBERS = [("dec", "1"), ("hex", "0x0123BEEF"), ("oct", "0o754"), ("float", "3.14"), ("float", "-1e4"), ("float", "+6.022045e23")]


def fixture_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_inputs(spark, [" ".join(t for _, t in NUMBERS).encode()]), "data", formats.numbers(), mode="FAILFAST")


ORACLE_SQL["fixture_numbers"] = _values({"seq": "INTEGER", "kind": "VARCHAR", "text": "VARCHAR"}, [(i, *x) for i, x in _numbered(NUMBERS)])

BROKEN = [(1, 1, "dec", "42", "error"), (2, None, None, None, "error"), (3, None, None, None, "incomplete")]


def fixture_broken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERMISSIVE: what was read before an error stays, with its status."""
    found = parse_records(_inputs(spark, [b"42 ,", b"42,", b"1e"]), "data", formats.numbers(), ["case_no"])
    return found.select("case_no", "seq", "kind", "text", F.col("_status").alias("status"))


ORACLE_SQL["fixture_broken_numbers"] = _values({"case_no": "INTEGER", "seq": "INTEGER", "kind": "VARCHAR", "text": "VARCHAR", "status": "VARCHAR"}, BROKEN)


def fixture_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_inputs(spark, [b">abc first one\nTAGA\nAAGA\n>header\nAAAG\n\r\nGGCG\r\n>empty\n"]), "data", formats.fasta(), mode="FAILFAST")


ORACLE_SQL["fixture_fasta"] = _values({"seq": "INTEGER", "identifier": "VARCHAR", "description": "VARCHAR", "sequence": "VARCHAR"}, [(1, "abc", "first one", "TAGAAAGA"), (2, "header", None, "AAAGGGCG"), (3, "empty", None, None)])


def fixture_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_inputs(spark, [b"a\tabc\n12\t13\r\nxyc\tz\n"]), "data", formats.delimited(["a", "abc"], header=True), mode="FAILFAST")


ORACLE_SQL["fixture_tsv"] = _values({"seq": "INTEGER", "a": "VARCHAR", "abc": "VARCHAR"}, [(1, "12", "13"), (2, "xyc", "z")])


def fixture_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_records(_inputs(spark, [b"1\t10\t200000\nchr12\t0\t21000\r\nchrM\t123\t12345\n"]), "data", formats.bed3(), mode="FAILFAST")
    return found.withColumnsRenamed({"start": "from_base", "end": "to_base"})


ORACLE_SQL["fixture_bed"] = _values({"seq": "INTEGER", "chrom": "VARCHAR", "from_base": "BIGINT", "to_base": "BIGINT"}, [(1, "1", 10, 200000), (2, "chr12", 0, 21000), (3, "chrM", 123, 12345)])

COMPILED: list[tuple[Callable[[], Regex], bool]] = [
    (lambda: rx("\\o"), False), (lambda: rx("+"), False), (lambda: rx("(a"), False), (lambda: rx("a)"), False), (lambda: rx("[a-ø]"), False),
    (lambda: rx("A") & rx("B"), False), (lambda: rx("[a-z]") - rx("[a-z]"), False),
    *((lambda p=p: rx(p).on_final("f"), False) for p in ("a+", "abc*", "ab(c*)", "(a|b|c)+", "(abc)+")),
    *((lambda p=p: rx(p).on_final("f"), True) for p in ("abc", "a+b", "(a|b)*c", "a|b|c")),
    (lambda: rx("a").on_exit("x") | rx("a").on_exit("y"), False), (lambda: rx("a").on_exit("x") | rx("b").on_exit("y"), True),
    (lambda: rx("a") | rx("a"), True), (lambda: cat(rx("a*").on_exit("x"), rx("a*")), False),
]


def fixture_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expressions are refused: bad syntax, empty languages, final actions on loops, ambiguous actions."""

    def compiles(x: Callable[[], Regex]) -> bool:
        try:
            compile_regex(x())
        except (RegexError, ValueError):
            return False
        return True

    return spark.createDataFrame([(i, compiles(x)) for i, (x, _) in _numbered(COMPILED)], "case_no int, compiles boolean")


ORACLE_SQL["fixture_compile"] = _values({"case_no": "INTEGER", "compiles": "BOOLEAN"}, [(i, ok) for i, (_, ok) in _numbered(COMPILED)])

LINES = [(b"\n", "ok"), (b" foo\n", "ok"), (b" foo\r\n", "ok"), (b"", "incomplete"), (b"\r", "incomplete"), (b"foo", "incomplete"), (b"\r\r", "error"), (b"\r\nx", "error"), (b"foo\nx", "error")]
SIZES = (1, 2, 3, 4, 5, 8, 10, 100)


def _chunks(spark: SparkSession, data: list[bytes]) -> DataFrame:
    """Each input cut into chunks of each size; stream_id is input/size."""
    rows = [(f"{i}/{n}", k, d[k * n : (k + 1) * n]) for i, d in _numbered(data) for n in SIZES for k in range(max(1, -(-len(d) // n)))]
    return spark.createDataFrame([(s, k, bytearray(b)) for s, k, b in rows], "stream_id string, chunk_no long, bytes binary")


def fixture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line, cut into chunks of any size: how it ends doesn't depend on the cuts."""
    chunks = _chunks(spark, [d for d, _ in LINES])
    ends, errors = final_states(chunks, "[^\r\n]*\r?\n"), first_errors(chunks, "[^\r\n]*\r?\n")
    status = F.when(F.col("state") == 0, "error").when(F.col("accepted"), "ok").otherwise("incomplete")
    return ends.join(errors, "stream_id").select("stream_id", status.alias("status"), F.col("position").isNull().alias("fine"))


ORACLE_SQL["fixture_chunks"] = _values({"stream_id": "VARCHAR", "status": "VARCHAR", "fine": "BOOLEAN"}, [(f"{i}/{n}", s, s == "ok") for i, (_, s) in _numbered(LINES) for n in SIZES])

#: State and position behind each piece of one input that is read piece by piece.
RESUMED = [(b"foo ", "ok"), (b"foo", "incomplete"), (b"foo foo", "incomplete"), (b"", "ok"), (b"fo o", "error")]


def fixture_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops in the middle goes on from its state and position as if it hadn't."""
    x = rx("(foo )*")
    found = _inputs(spark, [d for d, _ in RESUMED])
    whole = found.select("case_no", B.run("data", x, binary=True).alias("w"))
    return whole.select("case_no", F.col("w.status").alias("status"))


ORACLE_SQL["fixture_resume"] = _values({"case_no": "INTEGER", "status": "VARCHAR"}, [(i, s) for i, (_, s) in _numbered(RESUMED)])


def fixture_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that an action ends after each word: where it stands behind the first one."""
    x = rep(cat(literal("foo").on_exit("word"), rep1(" ")))
    found = _inputs(spark, [b"foo foo  ", b"foo", b"bar"]).select("case_no", B.run("data", x, binary=True, escape=["word"]).alias("r"))
    return found.select("case_no", F.col("r.status").alias("status"), F.col("r.position").alias("position"))


ORACLE_SQL["fixture_escape"] = _values({"case_no": "INTEGER", "status": "VARCHAR", "position": "BIGINT"}, [(1, "incomplete", 5), (2, "incomplete", 4), (3, "error", 1)])

GUARDED = [(b"aab", "ok"), (b"aaab", "error"), (b"b", "ok")]


def fixture_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A precondition on the position: a is read at the first two positions only."""
    x = cat(rep(literal("a").guard("early")), "b")
    found = _inputs(spark, [d for d, _ in GUARDED]).select("case_no", B.run("data", x, binary=True, guards={"early": lambda position, byte, row: position <= 2}).alias("r"))
    return found.select("case_no", F.col("r.status").alias("status"))


ORACLE_SQL["fixture_guards"] = _values({"case_no": "INTEGER", "status": "VARCHAR"}, [(i, s) for i, (_, s) in _numbered(GUARDED)])

SETS = [set(), {0}, {255}, {1, 2, 3}, {3, 4, 200}, set(range(97, 123))]


def fixture_byte_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of what set operators give for each pair of six sets."""
    made = [ByteSet(s) for s in SETS]
    rows = [(i, j, len(list(a | b)), len(list(a & b)), len(list(a - b)), len(list(a ^ b)), a.isdisjoint(b)) for i, a in enumerate(made) for j, b in enumerate(made)]
    return spark.createDataFrame(rows, "a int, b int, n_union int, n_both int, n_only_a int, n_one int, disjoint boolean")


ORACLE_SQL["fixture_byte_sets"] = _values(
    {"a": "INTEGER", "b": "INTEGER", "n_union": "INTEGER", "n_both": "INTEGER", "n_only_a": "INTEGER", "n_one": "INTEGER", "disjoint": "BOOLEAN"},
    [(i, j, len(a | b), len(a & b), len(a - b), len(a ^ b), not a & b) for i, a in enumerate(SETS) for j, b in enumerate(SETS)],
)

LANGUAGE = [("function", 1, 8), ("space", 9, 1), ("identifier", 10, 4), ("lparen", 14, 1), ("identifier", 15, 1), ("rparen", 16, 1), ("newline", 17, 1), ("if", 18, 2), ("space", 20, 1), ("identifier", 21, 1), ("equal", 22, 1), ("number", 23, 2), ("newline", 25, 1), ("end", 26, 3)]


def fixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords win over identifiers of the same letters, and longer identifiers over keywords."""
    found = tokenize(_inputs(spark, [b"function ends(x)\nif y=10\nend"]), "data", formats.language(), ["case_no"])
    return found.select("token", "start", "len")


ORACLE_SQL["fixture_language"] = _values({"token": "VARCHAR", "start": "BIGINT", "len": "INTEGER"}, LANGUAGE)

QUERIES |= {f.__name__: f for f in (
    fixture_matches, fixture_first_errors, fixture_locations, fixture_actions, fixture_nested_actions, fixture_tokens, fixture_named_tokens, fixture_numbers, fixture_broken_numbers, fixture_fasta,
    fixture_tsv, fixture_bed, fixture_compile, fixture_chunks, fixture_resume, fixture_escape, fixture_guards, fixture_byte_sets, fixture_language,
)}
