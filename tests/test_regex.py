"""Expressions, machines and runs on the driver: the documented goldens."""

import random
import re

import pytest

from bytewright.functions.runtime import Program, location
from bytewright.operators.tokens import Tokenizer
from bytewright.plans.automata import AmbiguousError, compile_regex, disjoint_masks, nfa_of
from bytewright.plans.byteset import ByteSet
from bytewright.plans.dot import edge_text, nfa_dot
from bytewright.plans.native import is_deterministic, java_pattern
from bytewright.plans.regex import RegexError, alt, any_byte, ascii_byte, byte_range, byte_set, cat, literal, opt, rep, rep1, rx, space

FASTA = rx("(>[ -~]*\r?\n([A-Za-z]*\r?\n)*)*")

MATCHES = [
    (FASTA, ["", ">\naa\n", ">seq1\n", ">seq1\na\n", ">seq1\nac\ngt\n", ">seq1\r\nacgt\r\n", ">seq1\nac\n>seq2\ngt\n"], ["a", ">", ">seq1\na", ">seq1\nac\ngt"]),
    (rx("a[ab]*") & rx("[ab]*b"), ["aab", "ab", "abab", "abb", "abbb"], ["", "a", "aba", "b", "bab"]),
    (rx("a.*b"), ["ab", "azb", "azzzb", "a\nb"], ["azzz", "zzzb"]),
    (rx(r"a\.*b"), ["ab", "a.b", "a...b"], ["azzzb", "a...", "...b"]),
    (rx(r"a\.\*b"), ["a.*b"], ["a...b"]),
    (rx("[^A-Z]"), ["1", "a"], ["A"]),
    (rx("[A-Z]+") & rx("FOO?"), ["FO", "FOO"], ["foo"]),
    (rx("[A-Z]+") - "foo", ["FOO"], ["foo"]),
    (~rx("foo"), ["bar", "", "fooo"], ["foo"]),
    (rx("A+(B+C)*(D|E)+"), ["ABCD", "AABCD", "AAABBCD", "AAAABCD", "AAAABBBBBCD"], []),
    (rx(r"[a\-c]"), ["-"], ["b"]),
    (rx("[a-c]"), ["b"], ["-"]),
    (rx("øæ"), ["øæ"], ["æ", "ø"]),
    (rx(r"[\x1a-\x29\xaa-\xf0]+"), [b"\xd0\xe9", b"\x20\xaa\xf0"], [b"", b"\x20\xaa\xf1"]),
    (rx("[AB]") & rx("A"), ["A"], ["B", "AA", "AB"]),
    (rx("A|B|C|D") - rx("[A-C]"), ["D"], ["AC", "A", "B", "DD"]),
    (~rx("A[BC]D?E"), ["ABCDE" * 2, "A"], ["ABDE", "ACE", "ABE"]),
    (rx("a^b$c{2}"), ["a^b$c{2}"], ["abc"]),
    (rx("a+?"), ["", "a", "aaa"], ["b"]),
    (rx(""), [""], ["a"]),
    (rx("é+"), ["é", "éé"], ["", b"\xc3"]),
    (cat("ab", opt(byte_range(0x30, 0x32)), rep(space()), byte_set(b"xy")), ["abx", "ab0 \t y"], ["ab3x"]),
    (alt("if", rep1(any_byte()) - rx("[a-z]*")), ["if", "A"], ["in"]),
]


def data(x):
    return x if isinstance(x, bytes) else x.encode()


@pytest.mark.parametrize("number", range(len(MATCHES)))
def test_matches(number):
    x, yes, no = MATCHES[number]
    for optimize in (True, False):
        program = Program(compile_regex(x, optimize=optimize))
        assert all(program.first_error(data(t)) is None for t in yes)
        assert all(program.first_error(data(t)) is not None for t in no)


def test_negation_keeps_what_the_expression_lacks():
    program = Program(compile_regex(~rx("A[BC]D?E")))
    assert [program.first_error(t.encode()) is None for t in ("ABCDE", "ABCE", "ABDE", "ACE", "ABE")] == [True, True, False, False, False]


def test_first_error():
    head = b"\0\a\b\t\n\v\r\x00\xff\xff"
    program = Program(compile_regex(rx(r"\0\a\b\t\n\v\r\x00\xff\xFF[\\][^\\]")))
    assert program.first_error(head + b"\\!") is None
    assert program.first_error(head + b"\\\\") == len(head) + 2
    assert program.first_error(head + b"\\") == 0
    program = Program(compile_regex(rx("(>[a-z]+\n([ACGT]+\n)+)*")))
    assert [program.first_error(t) for t in (b">hello\nTAGAGA\nTAGAG", b">helloXXX", b">hello\nTAGAGA\nTAGAG\n")] == [0, 7, None]


LOCATIONS = [
    ("(>[a-z]+\n)+", [(">abc", (None, 1, 4)), (">abc:a", (58, 1, 5)), (">", (None, 1, 1)), ("", (None, 1, 0)), (">abc\n>def\n>ghi\n>j!", (33, 4, 3)), (">abc\n;", (59, 2, 1))]),
    (
        "([a-z][a-z]+)(\n[a-z][a-z]+)*",
        [("abcd", None), ("a" * 10 + "!", (33, 1, 11)), ("a" * 10 + "\nabc!", (33, 2, 4)), ("abcdef\n\n", (10, 3, 0)), ("a" * 8 + "!\n" + "a" * 20 + "!", (33, 1, 9)), ("a" * 7 + "!", (33, 1, 8)), ("a" * 8, None), ("abc!", (33, 1, 4)), ("", (None, 1, 0)), ("a", (None, 1, 1)), ("ab\na", (None, 2, 1)), ("ab\naa\n\n", (10, 4, 0)), ("a\n", (10, 2, 0))],
    ),
]


@pytest.mark.parametrize(("pattern", "cases"), LOCATIONS)
def test_locations(pattern, cases):
    program = Program(compile_regex(rx(pattern)))
    for text, expected in cases:
        raw = text.encode()
        assert location(raw, program.first_error(raw)) == expected, text


def log(x, text, **options):
    found = Program(compile_regex(x, **options)).run(text.encode())
    return found.status == "ok", [a for _, a in found.events]


def test_empty_expression_enters_and_leaves():
    x = rx("").on_enter("enter").on_exit("exit")
    assert log(x, "") == (True, ["enter", "exit"])
    assert log(x, "a") == (False, [])


def test_nested_actions():
    a = rx("a*").on_enter("enter_a").on_exit("exit_a")
    b = rx("bb*").on_enter("enter_b").on_exit("exit_b")
    ab = (a * b).on_enter("enter_ab").on_exit("exit_ab")
    abc = cat(ab, rx("c*") if False else "c").on_final("final_abc")
    x = ab | abc
    six = ["enter_ab", "enter_a", "exit_a", "enter_b", "exit_b", "exit_ab"]
    for text in ("b", "ab", "abb"):
        assert log(x, text) == (True, six)
    assert log(x, "a") == (False, ["enter_ab", "enter_a"])
    for text in ("aabc", "abc"):
        assert log(x, text) == (True, [*six, "final_abc"])


def test_keyword_and_identifier():
    keyword = rx("if|else|end|while")
    ident = (rx("[a-z]+") - keyword).on_exit("ident")
    x = keyword.on_exit("keyword") | ident
    assert [log(x, t) for t in ("if", "else", "end", "while")] == [(True, ["keyword"])] * 4
    assert [log(x, t) for t in ("e", "eif", "i", "iff")] == [(True, ["ident"])] * 4
    assert log(x, "1if") == (False, [])


def test_action_on_every_byte():
    assert log(rx("a*").on_all("a"), "aaa") == (True, ["a"] * 3)
    assert log(rx("a*").on_all("a"), "aaab") == (False, ["a"] * 3)


def test_order_across_a_boundary():
    part = [rx(p).on_enter("enter").on_all("all").on_exit("exit") for p in ("a+", "b+")]
    assert log(cat(*part), "ab") == (True, ["enter", "all", "exit", "enter", "all", "exit"])


def test_set_operators_keep_actions():
    x = rx("[ab]+").on_all("x") & rx("a+").on_exit("y")
    assert log(x, "aa") == (True, ["x", "x", "y"])


def test_guards():
    x = cat(rep(rx("A").guard("open", when="enter")), opt(rx("b").guard("open", value=False)))
    program = Program(compile_regex(x))
    run = lambda text, n: program.run(text, guards={"open": lambda p, b, row: p <= n}).status
    assert run(b"AAA", 3) == "ok"
    assert run(b"AAA", 2) == "error"
    assert run(b"AAb", 2) == "ok"
    assert run(b"AAb", 3) == "error"


def test_escape_and_resume():
    word = rx("foo").on_enter("start").on_final("stop")
    program = Program(compile_regex(rep(word * rx(" *"))))
    text, state, at, out = b"foo foofoo   foo", 1, 1, []
    while state > 0 and at <= len(text):
        found = program.run(text, state, at, escape=frozenset(["stop"]))
        state, at = found.state, found.position
        out.append([p for p, a in found.events])
    assert out == [[1, 3], [5, 7], [8, 10], [14, 16]]


def test_ambiguity():
    xy, xz, aa, many = rx("XY"), rx("XZ"), rx("aa"), rx("a+")
    for x in (xy.on_enter("e") | xz, aa.on_enter("e") | many, aa.on_exit("e") | many):
        with pytest.raises(AmbiguousError):
            compile_regex(x)
        compile_regex(x, unambiguous=False)
    compile_regex(xy.on_exit("e") | xz)
    compile_regex(aa | many)
    compile_regex(rx("AAAAB").on_exit("a") | rx("A+C").on_exit("b"))
    compile_regex(xy.guard("c").on_enter("e") | xz.guard("c", value=False))


def test_final_actions_need_a_last_byte():
    for p in ("abc", "a+b", "(a|b)*c", "a|b|c"):
        compile_regex(rx(p).on_final("f"))
    for p in ("a+", "abc*", "ab(c*)", "(a|b|c)+", "(abc)+"):
        with pytest.raises(RegexError):
            compile_regex(rx(p).on_final("f"))


@pytest.mark.parametrize("pattern", [r"\o", "+", "*a", "(a", "a)", "[]", "[^]", "[z-a]", "[abc", "[a\\", "a|", "(|a)", "()", "[ø]", r"\d", r"\u0041", r"\x1", r"[^\x00-\xff]"])
def test_patterns_that_are_errors(pattern):
    with pytest.raises(RegexError):
        rx(pattern)


def test_languages_without_inputs():
    for x in (rx("a") & rx("b"), rx("a") - rx("a"), rx("ab") & rx("a"), ~rep(any_byte())):
        with pytest.raises(RegexError):
            compile_regex(x)


def test_action_kinds():
    with pytest.raises(RegexError):
        rx("a").on("leave", "x")


def test_machines_are_the_same_each_time():
    x = rx("(a|b)*c|d+[e-g]") | rx("x[yz]*")
    assert len({str(compile_regex(x).edges) for _ in range(20)}) == 1


def test_newline_action():
    assert log(rx("[a\n]*").with_newline_action(), "a\n\na") == (True, ["newline", "newline"])


TOKENS = [
    (["a", "a*b", "cd"], [("", []), ("aa", [(1, 1, 1), (2, 1, 1)]), ("ab", [(1, 2, 2)]), ("aab", [(1, 3, 2)]), ("abaabba", [(1, 2, 2), (3, 3, 2), (6, 1, 2), (7, 1, 1)]), ("c", [(1, 1, 0)]), ("ac", [(1, 1, 1), (2, 1, 0)]), ("abc", [(1, 2, 2), (3, 1, 0)]), ("acb", [(1, 1, 1), (2, 1, 0), (3, 1, 2)]), ("cdc", [(1, 2, 3), (3, 1, 0)])]),
    (["ADF", "[A-Z]+", "[abcde]+", "abc", "ab[a-z]"], [("!" * 11, [(1, 11, 0)]), ("abca", [(1, 4, 3)]), ("ADFADF", [(1, 6, 2)]), ("AD", [(1, 2, 2)]), ("ADF", [(1, 3, 2)]), ("abc", [(1, 3, 5)]), ("abe", [(1, 3, 5)])]),
    (["a", "b"], [("abxxxba", [(1, 1, 1), (2, 1, 2), (3, 3, 0), (6, 1, 2), (7, 1, 1)])]),
    (["abc", "def"], [("abcxyzdef123", [(1, 3, 1), (4, 3, 0), (7, 3, 2), (10, 3, 0)])]),
    (["abc", "b"], [("ab", [(1, 2, 0)])]),
]


@pytest.mark.parametrize(("patterns", "cases"), TOKENS)
def test_tokens(patterns, cases):
    tokenizer = Tokenizer([rx(p) for p in patterns])
    for text, expected in cases:
        assert tokenizer.tokens(text) == expected, text


def test_named_tokens():
    tokenizer = Tokenizer([("lparens", r"\("), ("rparens", r"\)"), ("comma", ","), ("quote", '"'), ("space", " +"), ("letters", "[a-zA-Z]+")])
    assert tokenizer.tokens("XY!!)") == [(1, 2, "letters"), (3, 2, "error"), (5, 1, "rparens")]
    with pytest.raises(ValueError, match="name"):
        Tokenizer([("a", "a"), ("a", "b")])
    with pytest.raises(ValueError, match="needs"):
        Tokenizer([])


def brute_tokens(patterns, text):
    compiled = [re.compile(p.encode(), re.S) for p in patterns]

    def longest(at):
        best = (0, 0)
        for n in range(1, len(text) - at + 1):
            for k, p in enumerate(compiled, 1):
                if p.fullmatch(text, at, at + n):
                    best = max(best, (n, k))
        return best

    def runs_out(at):  # the rest is the beginning of some token
        return any(Program(compile_regex(rx(p))).first_error(text[at:]) in (None, 0) for p in patterns)

    out, begin, at = [], 0, 0
    while at < len(text):
        n, k = longest(at)
        if n:
            if begin < at:
                out.append((begin + 1, at - begin, 0))
            out.append((at + 1, n, k))
            begin = at = at + n
        elif runs_out(at):
            at = len(text)
        else:
            at += 1
    if begin < len(text):
        out.append((begin + 1, len(text) - begin, 0))
    return out


def test_tokens_against_brute_force():
    draw = random.Random(3)
    sets = [["a+", "ab*", "bc"], ["abc", "b", "c+a"], ["[ab]+", "aba", "c"], ["aa", "ab|ba", "cc*a"]]
    for patterns in sets:
        tokenizer = Tokenizer([rx(p) for p in patterns])
        for _ in range(60):
            text = bytes(draw.choice(b"abcx") for _ in range(draw.randint(0, 12)))
            assert tokenizer.tokens(text) == brute_tokens(patterns, text), (patterns, text)


def random_pattern(draw, depth=3):
    if not depth or draw.random() < 0.3:
        return draw.choice(["a", "b", "c", "[ab]", "[^a]", "."])
    kind = draw.randint(0, 5)
    one = random_pattern(draw, depth - 1)
    if kind == 0:
        return f"({one})*"
    if kind == 1:
        return f"({one})+"
    if kind == 2:
        return f"({one})?"
    two = random_pattern(draw, depth - 1)
    return f"({one}|{two})" if kind == 3 else one + two


def test_random_expressions_against_python():
    draw = random.Random(11)
    native = 0
    for _ in range(150):
        p, q = random_pattern(draw), random_pattern(draw)
        a, b = re.compile(p.encode(), re.S), re.compile(q.encode(), re.S)
        texts = [bytes(draw.choice(b"abcd\xff") for _ in range(draw.randint(0, 7))) for _ in range(30)]
        pairs = [(rx(p), lambda t: bool(a.fullmatch(t))), (rx(p) & rx(q), lambda t: bool(a.fullmatch(t) and b.fullmatch(t))), (rx(p) - rx(q), lambda t: bool(a.fullmatch(t) and not b.fullmatch(t))), (~rx(p), lambda t: not a.fullmatch(t))]
        for x, wanted in pairs:
            try:
                program = Program(compile_regex(x))
            except RegexError:
                continue
            assert all((program.first_error(t) is None) == wanted(t) for t in texts), (p, q)
        if is_deterministic(rx(p)):
            native += 1
            possessive = re.compile(java_pattern(rx(p)).encode("latin-1"), re.S)
            assert all(bool(possessive.fullmatch(t)) == bool(a.fullmatch(t)) for t in texts), p
    assert native > 20


def test_loops_over_nothing_are_left_to_machines():
    for p in ("(a*|b*)*", "(a?)*", "((a|b?)+)c", "(a*)+"):
        assert not is_deterministic(rx(p))
    for p in ("([A-z]*\r?\n)*", "(a|b)*c?", "a?(b|c+d)*"):
        assert is_deterministic(rx(p))


def test_byte_sets():
    sets = [ByteSet(), ByteSet([0]), ByteSet(range(10, 20)), ByteSet([1, 3, 5, 255]), ByteSet(range(128, 256)), ByteSet.all()]
    for a in sets:
        assert set(~a) == set(range(256)) - set(a)
        assert ~~a == a
        assert len(a) == len(list(a))
        for b in sets:
            assert set(a | b) == set(a) | set(b)
            assert set(a & b) == set(a) & set(b)
            assert set(a ^ b) == set(a) ^ set(b)
            assert set(a - b) == set(a) - set(b)
            assert a.isdisjoint(b) == set(a).isdisjoint(b)
    assert ByteSet(range(3, 9)).is_contiguous()
    assert not ByteSet([1, 3]).is_contiguous()
    assert (ByteSet([9, 4]).min(), ByteSet([9, 4]).max()) == (4, 9)
    assert ByteSet([1, 2, 3, 7]).ranges() == [(1, 3), (7, 7)]
    for f in (ByteSet().min, ByteSet().max):
        with pytest.raises(ValueError, match="empty"):
            f()
    with pytest.raises(ValueError, match="byte"):
        ByteSet([256])


def test_disjoint_masks():
    masks = [0b1110, 0b0111, 0b1000]
    found = disjoint_masks(masks)
    assert sum(found) == 0b1111
    assert all(not a & b for i, a in enumerate(found) for b in found[:i])
    assert all(m & f in (0, f) for m in masks for f in found)


def test_pictures():
    machine = compile_regex(rx("[A-Za-z]+").on_exit("end") * rx("\n"))
    text = machine.to_dot()
    assert text.startswith("digraph")
    assert "[A-Za-z]" in text
    assert "/end" in text
    assert edge_text(ByteSet([0x61])) == "'a'"
    assert edge_text(None, (), ("x", "y")) == "ϵ/x,y"
    assert edge_text(ByteSet([0x0A]), (("c", True), ("d", False)), ("x",)) == "'\\n'(c,!d)/x"
    assert "ϵ" in nfa_dot(nfa_of(rx("a|b")))
    assert "start 1" in repr(machine)
    assert len(ascii_byte().args[0]) == 128
    assert literal("ab") == literal(b"ab")
