"""The engine's operators through Spark."""

import pytest
from pyspark.sql import functions as F

from bytewright import formats
from bytewright.functions import columns as B
from bytewright.functions.sql import register
from bytewright.operators import explain
from bytewright.operators.records import Append, Capture, Emit, InputError, Mark, RecordParser, parse_records
from bytewright.operators.tokens import Tokenizer, tokenize
from bytewright.plans.automata import compile_regex
from bytewright.plans.regex import RegexError, any_byte, cat, opt, rep, rx
from bytewright.sources.datasource import register as register_source
from bytewright.sources.files import read_files, read_records, write_pieces
from bytewright.streaming.chunks import chunked, final_states, first_errors, read_stream
from tests.test_regex import LOCATIONS, MATCHES, TOKENS, data


@pytest.fixture(scope="module")
def texts(spark):
    return lambda rows: spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_matches_in_both_engines(spark):
    rows, wanted = [], []
    picked = [(x, yes, no) for x, yes, no in MATCHES]
    for k, (_, yes, no) in enumerate(picked):
        rows += [(len(rows) + i, k, bytearray(data(t))) for i, t in enumerate([*yes, *no])]
        wanted += [True] * len(yes) + [False] * len(no)
    df = spark.createDataFrame(rows, "id int, k int, t binary")
    by_machine = by_choice = F.lit(None).cast("boolean")
    for k, (x, _, _) in enumerate(picked):
        by_machine = F.when(F.col("k") == k, B.matches("t", x, engine="arrow", binary=True)).otherwise(by_machine)
        by_choice = F.when(F.col("k") == k, B.matches("t", x, binary=True)).otherwise(by_choice)
    assert values(df, by_machine) == wanted
    assert values(df, by_choice) == wanted


def test_engines(texts):
    df = texts(["ab", "aab", None])
    assert values(df, B.matches("t", "a*b")) == [True, True, None]
    assert values(df, B.matches("t", "(a|ab)(c|bcd)*b?", engine="arrow")) == [True, False, None]
    with pytest.raises(RegexError):
        B.matches("t", "a*a", engine="native")
    with pytest.raises(ValueError, match="engine"):
        B.matches("t", "a", engine="goto")
    with pytest.raises(RegexError):
        B.matches("t", rx("a").guard("g"))


def test_native_predicates_run_in_catalyst(texts):
    df = texts(["x"])
    plan = df.where(B.matches("t", rx("[a-z]+( [a-z]+)*") - "red car"))._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "RLIKE" in plan
    long = texts(["a b " * 50_000 + "c"])
    assert values(long, B.matches("t", "[a-z]+( [a-z]+)*")) == [True]


@pytest.mark.parametrize(("pattern", "cases"), LOCATIONS)
def test_error_locations(texts, pattern, cases):
    df = texts([t for t, _ in cases])
    found = values(df, B.error_location("t", pattern))
    assert [r and tuple(r) for r in found] == [e for _, e in cases]
    assert [e is None for e in values(df, B.first_error("t", pattern))] == [e is None for _, e in cases]


def test_empty_tables_and_nulls(texts):
    none = texts([]).where("id < 0")
    assert none.select(B.first_error("t", "a"), B.run("t", "a"), B.trace("t", "a"), B.matches("t", "a*a")).count() == 0
    df = texts([None, ""])
    assert values(df, B.first_error("t", "a")) == [None, 0]
    assert tokenize(df, "t", Tokenizer(["a"])).count() == 0


def test_run_with_guards_and_escape(texts):
    x = cat(rep(rx("A").guard("open")), opt(rx("b").guard("open", value=False))).on_all("seen")
    df = texts(["AAA", "AAb", "AAAb"])
    found = values(df, B.run("t", x, guards={"open": lambda p, byte, row: p <= 2}))
    assert [r.status for r in found] == ["error", "ok", "error"]
    assert [len(r.events) for r in found] == [2, 3, 2]
    with pytest.raises(RegexError):
        B.run("t", x)
    stopped = values(texts(["foo foo"]), B.run("t", rep(rx("foo").on_final("stop") * rx(" *")), escape=["stop"]))[0]
    assert (stopped.status, stopped.position) == ("incomplete", 4)
    with pytest.raises(RegexError):
        B.run("t", "a", escape=["nothing"])


def test_trace_and_tables(spark, texts):
    x = rx("a+").on_exit("end") * rx("b")
    rows = values(texts(["aab"]), B.trace("t", x))[0]
    assert [(r.byte, list(r.actions)) for r in rows] == [(97, []), (97, []), (98, ["end"]), (None, [])]
    machine = compile_regex(x)
    assert explain.states(spark, machine).where("is_final").count() == 1
    assert explain.edges(spark, machine).where("array_contains(actions, 'end')").count() == 1


def test_tokens(texts):
    for patterns, cases in TOKENS:
        df = texts([t for t, _ in cases])
        rows = tokenize(df, "t", Tokenizer([rx(p) for p in patterns]), ["id"]).orderBy("id", "seq").collect()
        assert [(r.start, r.len, r.token) for r in rows] == [t for _, e in cases for t in e]


def test_language(texts):
    source = 'function f(xs)\n  if 1 <= 2.5 # one\n    return "s"\n  end\nend'
    rows = tokenize(texts([source]), "t", formats.language(), texts=True).orderBy("seq").collect()
    assert "".join(r.piece for r in rows) == source
    assert [r.token for r in rows if r.token not in ("space", "newline")][:6] == ["function", "identifier", "lparen", "identifier", "rparen", "if"]
    assert [r.piece for r in rows if r.token in ("comment", "string", "number")] == ["1", "2.5", "# one", '"s"']


def test_fasta(texts):
    df = texts([">seq1 a protein\nACGT\nTT\n\n>seq2\nGG\n", "x", None])
    rows = parse_records(df, "t", formats.fasta(), ["id"]).orderBy("id", "seq").collect()
    assert [(r.id, r.seq, r.identifier, r.description, r.sequence, r._status) for r in rows] == [(0, 1, "seq1", "a protein", "ACGTTT", "ok"), (0, 2, "seq2", None, "GG", "ok"), (1, None, None, None, None, "error")]
    assert "position 1" in rows[2]._error
    assert parse_records(df, "t", formats.fasta(), ["id"], mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="InputError"):
        parse_records(df, "t", formats.fasta(), mode="FAILFAST").collect()
    with pytest.raises(ValueError, match="mode"):
        parse_records(df, "t", formats.fasta(), mode="LENIENT")


def test_delimited(texts):
    parser = formats.delimited(["a", "abc"], header=True)
    df = texts(["a\tabc\n12\t13\r\nxyc\tz\n", "a\tabc\n1\n"])
    rows = parse_records(df, "t", parser, ["id"]).orderBy("id", "seq").collect()
    assert [(r.a, r.abc, r._status) for r in rows] == [("12", "13", "ok"), ("xyc", "z", "ok"), (None, None, "error")]


def test_bed(texts):
    df = texts(["1\t10\t200000\nchr12\t0\t21000\r\nchrM\t123\t12345\n"])
    rows = parse_records(df, "t", formats.bed3()).orderBy("seq").collect()
    assert [(r.chrom, r.start, r.end) for r in rows] == [("1", 10, 200000), ("chr12", 0, 21000), ("chrM", 123, 12345)]


def test_numbers(texts):
    df = texts(["1 0x0123BEEF 0o754 3.14 -1e4 +6.022045e23", "42,", "42 ,", "1e"])
    rows = parse_records(df, "t", formats.numbers(), ["id"]).orderBy("id", "seq").collect()
    assert [r.kind for r in rows if not r.id] == ["dec", "hex", "oct", "float", "float", "float"]
    assert [(r.id, r.text, r._status) for r in rows if r.id] == [(1, None, "error"), (2, "42", "error"), (3, None, "incomplete")]


def test_records_are_checked():
    word = rx("a+").on_enter("mark").on_exit("word")
    with pytest.raises(RegexError):
        RecordParser(word, {"mark": Mark()}, "word string")
    with pytest.raises(RegexError):
        RecordParser(word, {"mark": Mark(), "word": Capture("other")}, "word string")
    with pytest.raises(RegexError):
        RecordParser(word, {"mark": Mark(), "word": Capture("word")}, "word date")
    with pytest.raises(InputError):
        raise InputError("x")


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "one.fa").write_bytes(b">x\nAC\n")
    (tmp_path / "two.fa.gz").write_bytes(gzip.compress(b">y z\nGT\n"))
    assert {bytes(r.content) for r in read_files(spark, str(tmp_path)).collect()} == {b">x\nAC\n", b">y z\nGT\n"}
    rows = read_records(spark, str(tmp_path), formats.fasta()).orderBy("identifier").collect()
    assert [(r.identifier, r.sequence) for r in rows] == [("x", "AC"), ("y", "GT")]
    write_pieces(spark.createDataFrame([("p",)], "s string"), str(tmp_path / "out"), "s")
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "p"


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_data_source(spark, tmp_path, piece):
    import gzip

    register_source(spark)
    (tmp_path / "one.fa").write_bytes(b">x first\nACGT\nAC\n>w\nTT\n")
    (tmp_path / "two.fa.gz").write_bytes(gzip.compress(b">y z\nGT\n"))
    reader = spark.read.format("bytewright").option("machine", "fasta").option("piece", piece)
    rows = reader.load(str(tmp_path)).orderBy("identifier").collect()
    assert [tuple(r) for r in rows] == [("w", None, "TT"), ("x", "first", "ACGTAC"), ("y", "z", "GT")]
    (tmp_path / "bad.fa").write_bytes(b">x\n!")
    with pytest.raises(Exception, match="error at position 4"):
        reader.load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="machine"):
        spark.read.format("bytewright").load(str(tmp_path))


CHUNKS = [1, 2, 3, 5, 8, 100]


@pytest.mark.parametrize("size", CHUNKS)
def test_chunks_of_a_table(texts, size):
    rows = ["\n foo\n foo\r\n", "", "\r", "foo", "foo\nx", "é\n" * 7]
    line = rep(rx("[^\r\n]*\r?\n"))
    found = final_states(chunked(texts(rows), "id", "t", size), line)
    got = {int(r.stream_id): r.accepted for r in found.collect()}
    wanted = values(texts(rows), B.matches("t", line))
    assert [got[i] for i in range(len(rows))] == wanted


@pytest.mark.parametrize("size", [1, 3, 100])
def test_errors_in_chunks(texts, size):
    rows = ["ab\nab\n", "", "ab", "abx\n", "ab\n!", "a" * 20 + "?"]
    line = rep(rx("[ab]*\n"))
    got = {int(r.stream_id): r.position for r in first_errors(chunked(texts(rows), "id", "t", size), line).collect()}
    wanted = values(texts(rows), B.first_error("t", line))
    assert [got[i] for i in range(len(rows))] == wanted


def test_sql(spark, texts):
    register(spark)
    texts(["ab ba", "x1", None]).createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT id, fsm_match(t, '[a-z]+( [a-z]+)*') AS m, fsm_first_error(t, '[a-z ]*') AS e, fsm_status(t, '[a-z]+1?') AS s FROM some_texts ORDER BY id").collect()
    assert [(r.m, r.e, r.s) for r in rows] == [(True, None, "error"), (False, 2, "ok"), (None, None, None)]
    rows = spark.sql("SELECT id, t2.* FROM some_texts, LATERAL fsm_tokens(t, array('[a-z]+', ' ')) t2 ORDER BY id, seq").collect()
    assert [(r.id, r.start, r.len, r.token) for r in rows] == [(0, 1, 2, 1), (0, 3, 1, 2), (0, 4, 2, 1), (1, 1, 1, 1), (1, 2, 1, 0)]


def test_a_stream(spark, tmp_path):
    """Batches of a file stream: FASTA records cut anywhere come out as from the whole text."""
    source = b">seq1 first one\nACGT\nTTGG\n>seq2\nAA\n\nCC\n"
    word = rx("[A-Z]+").on_enter("mark").on_exit("line")
    parser = RecordParser(rep((cat(">", rx("[a-z0-9]+").on_enter("mark").on_exit("name"), opt(rx(" [^\n]*")), "\n", rep(cat(opt(word), "\n")))).on_exit("record")), {"mark": Mark(), "name": Capture("name"), "line": Append("bases"), "record": Emit()}, "name string, bases string")
    pieces = [source[i : i + 7] for i in range(0, len(source), 7)]
    rows = [("good", i, bytearray(p), i == len(pieces) - 1) for i, p in enumerate(pieces)] + [("bad", 0, bytearray(b">x\nA"), False), ("bad", 1, bytearray(b"C\n!"), True), ("cut", 0, bytearray(b">"), True)]
    schema = "stream_id string, chunk_no long, bytes binary, is_last boolean"
    for k, part in enumerate((rows[:3] + rows[-3:-2], rows[3:-3] + rows[-2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = read_stream(stream, parser).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
        found = spark.table("records").orderBy("stream_id", "seq").collect()
    finally:
        query.stop()
    got = [(r.stream_id, r.name, r.bases) for r in found if r.status is None]
    assert got == [("good", "seq1", "ACGTTTGG"), ("good", "seq2", "AACC")]
    assert {(r.stream_id, r.status, r.position) for r in found if r.status} == {("good", "ok", len(source) + 1), ("bad", "error", 7), ("cut", "incomplete", 2)}


def test_bytes_are_translated(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "b binary")
    upper = bytes(b - 32 if 97 <= b <= 122 else b for b in range(256))
    assert bytes(df.select(B.translate_bytes(F.col("b"), upper)).first()[0]) == b"ABC"
    assert bytes(df.select(B.part(F.col("b"), 2)).first()[0]) == b"bc"
    with pytest.raises(Exception, match="window"):
        df.select(B.part(F.col("b"), 3, 4)).collect()


def test_any_byte_includes_newlines(texts):
    assert values(texts(["a\nb", "\n"]), B.matches("t", rep(any_byte()))) == [True, True]


class TestQuickTokens:
    @pytest.mark.parametrize("tokens", [["[A-Za-z]+", "[0-9]+", "[ \t\n]+"], ["[^<&]+", "<[^>]*>", "&#?[A-Za-z0-9]+;"], ["a(bc)*", "x+y?", "[0-9]+(\\.[0-9]+)?"], ["(ab*c)+", "d(e(f)?)*"]])
    def test_the_pattern_and_the_machine_agree(self, tokens):
        import random

        own = Tokenizer(tokens)
        assert own.quick
        draw, program = random.Random(3), own.program()
        for _ in range(3000):
            data = "".join(draw.choice("abcdefxy019. <>&;#\n!é") for _ in range(draw.randint(0, 12))).encode()
            quick = program._quickly(data)
            assert quick is None or quick == program._stepwise(data), data

    def test_tokens_that_overlap_have_no_pattern(self):
        assert Tokenizer(["a", "a*b"]).quick is None
        assert Tokenizer(["a*b|a"]).quick is None or Tokenizer(["a*b|a"]).tokens("aac")[0][:2] == (1, 1)

    def test_bytes_that_are_no_text(self, spark):
        df = spark.sql("SELECT cast(X'61ff62' AS string) AS t, 1 AS k")
        assert [(r.start, r.len) for r in tokenize(df, "t", Tokenizer(["[ab]"]), ["k"]).collect()] == [(1, 1), (2, 1), (3, 1)]
        with pytest.raises(ValueError, match="rename"):
            tokenize(df.withColumnRenamed("k", "len"), "t", Tokenizer(["a"]), ["len"])


class TestBlocksOfTokens:
    """What a task holds doesn't grow with the tokens of a batch or of a text."""

    TOKENS = [("word", "[A-Za-z]+"), ("number", "[0-9]+"), ("blank", "[ \t\n]+")]
    OVERLAPPING = [("word", "[a-z]+"), ("if", "if"), ("blank", " +")]

    @staticmethod
    def peak(run):
        import tracemalloc

        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    @pytest.mark.parametrize("tokens", [TOKENS, OVERLAPPING])
    def test_memory_of_a_long_text(self, tokens):
        own = Tokenizer(tokens)
        assert (own.quick is None) == (tokens is self.OVERLAPPING)
        n, mb = self.peak(lambda: sum(1 for _ in own.program().tokens(b"if ab 1 " * 20_000)))
        assert n == 120_000
        assert mb < 2

    @pytest.mark.parametrize("rows", [[b"ab 1 " * 80_000], [b"ab 1 " * 40] * 2_000])
    def test_memory_of_a_batch(self, texts, monkeypatch, rows):
        import pyarrow as pa

        df, given = texts([""]), []
        monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: given.append(f))
        tokenize(df, "t", Tokenizer(self.TOKENS), texts=True)
        batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["text"])
        sizes, mb = self.peak(lambda: [b.num_rows for b in given[0](iter([batch]))])
        assert sum(sizes) == 320_000
        assert max(sizes) <= 20_000
        assert mb < 8

    @pytest.mark.parametrize("block, block_bytes", [(1, 1), (2, 1000), (3, 4), (1000, 1), (1000, 1000)])
    def test_tokens_across_blocks(self, spark, monkeypatch, block, block_bytes):
        from bytewright.operators import tokens as operator

        rows = [(1, "one two  3"), (2, None), (3, ""), (4, "a1"), (5, "a1b2c3 <é> ??"), (6, "é"), (7, "x y z")]
        own = Tokenizer([("left", "[\\xc3]"), ("word", "[a-z]+"), ("digit", "[0-9]")])
        wanted = [(k, i, s, n, t, text.encode()[s - 1 : s - 1 + n].decode("utf-8", "replace")) for k, text in rows if text for i, (s, n, t) in enumerate(own.tokens(text), 1)]
        monkeypatch.setattr(operator, "BLOCK", block)
        monkeypatch.setattr(operator, "BLOCK_BYTES", block_bytes)
        df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
        assert [tuple(r) for r in tokenize(df, "t", own, ["k"], texts=True).orderBy("k", "seq").collect()] == wanted
        assert [tuple(r) for r in tokenize(df, "t", own, ["k"]).orderBy("k", "seq").collect()] == [w[:-1] for w in wanted]

    def test_where_the_machine_takes_over(self):
        """From the first token that begins and doesn't end."""
        own = Tokenizer([("text", "[^<&]+"), ("tag", "<[^>]*>"), ("entity", "&[a-z]+;")])
        assert own.quick
        assert own.tokens("a<b>&c;&d e<f") == [(1, 1, "text"), (2, 3, "tag"), (5, 3, "entity"), (8, 1, "error"), (9, 3, "text"), (12, 2, "error")]
        program = own.program()
        assert program._quickly(b"a<b>&d e") is None
        assert list(program.tokens(b"a<b>&d e")) == program._stepwise(b"a<b>&d e")


def test_files_of_several_frames(spark, tmp_path):
    import zstandard

    from bytewright.sources.files import read_files

    (tmp_path / "a.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(x) for x in (b"one ", b"two")))
    assert bytes(read_files(spark, str(tmp_path)).first().content) == b"one two"
