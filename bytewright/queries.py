"""Queries of the finite-state text engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright import fixture_queries, formats
from bytewright.functions import columns as B
from bytewright.functions.sql import register
from bytewright.operators import explain
from bytewright.operators.records import Capture, Emit, Mark, RecordParser, parse_records
from bytewright.operators.tokens import Tokenizer, tokenize
from bytewright.plans.automata import compile_regex
from bytewright.plans.regex import Regex, byte, byte_range, byte_set, cat, literal, opt, rep, rep1, rx, space
from bytewright.streaming.chunks import chunked, final_states, first_errors

ASCII = rx("[\\x00-\\x7f]*")
WORDS = Tokenizer([("word", "[A-Za-z]+"), ("number", "[0-9]+"), ("blank", "[ \t\n]+")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str, name: str, by: str, text: str, x: Regex, engine: str = "auto") -> DataFrame:
    """How many texts match, by a column."""
    found = table(spark, sf_dir, name).select(by, B.matches(text, x, engine=engine).alias("hit"))
    return found.groupBy(by).agg(F.count(F.when(F.col("hit"), 1)).alias("n_match"), F.count("*").alias("n"))


def _match(name: str, by: str, text: str, x: Regex, sql: str, engine: str = "auto") -> tuple[Callable, str]:
    oracle = f"SELECT {by}, count(*) FILTER (WHERE {sql}) AS n_match, count(*) AS n FROM {name} GROUP BY {by}"
    return partial(_counts, name=name, by=by, text=text, x=x, engine=engine), oracle


def _full(text: str, pattern: str) -> str:
    return f"regexp_full_match({text}, '(?s){pattern}')"


#: (query, oracle) of the predicates: an operator of the expression language each.
MATCHES: dict[str, tuple[Callable, str]] = {
    "match_ascii_by_lang": _match("documents", "lang", "text", ASCII, _full("text", r"[\x00-\x7f]*")),
    "match_ascii_arrow": _match("documents", "lang", "text", ASCII, _full("text", r"[\x00-\x7f]*"), "arrow"),
    "match_literal": _match("part", "p_brand", "p_brand", literal("Brand#12"), "p_brand = 'Brand#12'"),
    "match_byte_primitives": _match("part", "p_brand", "p_brand", cat(literal(b"Brand"), byte(0x23), byte_range(0x31, 0x35), byte_set([0x31, 0x33, 0x35])), _full("p_brand", "Brand#[1-5][135]")),
    "match_class": _match("orders", "o_orderpriority", "o_orderpriority", rx("[1-3]-[A-Z]+"), _full("o_orderpriority", "[1-3]-[A-Z]+")),
    "match_negated_class": _match("orders", "o_orderpriority", "o_orderpriority", rx("[^1-3]*"), _full("o_orderpriority", "[^1-3]*")),
    "match_any_byte": _match("documents", "lang", "lang", rx("..*e.*|.*s"), _full("lang", "..*e.*|.*s")),
    "match_alternation": _match("events", "event_type", "event_type", rx("click|view|purchase"), _full("event_type", "click|view|purchase")),
    "match_star": _match("part", "p_brand", "p_name", rx("[a-z]*( [a-z]*)*"), _full("p_name", "[a-z]*( [a-z]*)*")),
    "match_plus": _match("customer", "c_mktsegment", "c_name", rx("Customer#0+[1-9]+"), _full("c_name", "Customer#0+[1-9]+")),
    "match_option": _match("customer", "c_mktsegment", "c_mktsegment", rx("BUILDINGS?|AUTOMOBILE"), _full("c_mktsegment", "BUILDINGS?|AUTOMOBILE")),
    "match_intersection": _match("part", "p_brand", "p_name", rx("[a-z ]*") & rx(".*ed.*"), _full("p_name", "[a-z ]*") + " AND p_name LIKE '%ed%'"),
    "match_difference": _match("part", "p_brand", "p_name", rx("[a-z]+ [a-z]+") - rx("red .*"), _full("p_name", "[a-z]+ [a-z]+") + " AND p_name NOT LIKE 'red %'"),
    "match_negation": _match("customer", "c_mktsegment", "c_name", ~rx("Customer#0*[0-9]*5"), "NOT " + _full("c_name", "Customer#0*[0-9]*5")),
    "match_nested_sets": _match("customer", "c_mktsegment", "c_name", cat("Customer#", rep("0"), rep1(rx("[0-9]")) - rx("[0-9]*7[0-9]*")), "regexp_full_match(c_name, 'Customer#0*[0-689]+')"),
    "match_space": _match("part", "p_brand", "p_name", cat(rep1(rx("[a-z]")), rep1(space()), rep1(rx("[a-z]"))), _full("p_name", "[a-z]+[ \\t\\n\\v\\f\\r]+[a-z]+")),
    "match_option_group": _match("documents", "lang", "source", cat("src", opt(rx("[0-9]")), rx("[0-9]")), _full("source", "src[0-9]?[0-9]")),
}


def first_error_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.first_error("text", ASCII).alias("err"))


def error_location_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", B.error_location("text", ASCII).alias("e"))
    return found.select("doc_id", F.col("e.byte").cast("int").alias("byte"), F.col("e.line").alias("line"), F.col("e.col").alias("col"))


def status_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(B.status("props", '{"k": [0-9]+}').alias("status"))
    return found.groupBy("status").agg(F.count("*").alias("n"))


def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents stop being lines of printable ASCII: incomplete ones end without a newline."""
    found = table(spark, sf_dir, "documents").select("lang", B.status("text", rep(rx("[ -~]*\n"))).alias("status"))
    return found.groupBy("lang", "status").agg(F.count("*").alias("n"))


def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize(table(spark, sf_dir, "documents"), "text", WORDS, ["doc_id"])
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the short texts of parts."""
    return tokenize(table(spark, sf_dir, "part"), "p_name", WORDS, ["p_partkey"], texts=True)


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize(table(spark, sf_dir, "conversations"), "text", WORDS, ["role"])
    return found.groupBy("role", "token").agg(F.count("*").alias("n"))


def token_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words of documents (a top-k report)."""
    found = tokenize(table(spark, sf_dir, "documents"), "text", WORDS, texts=True).where("token = 'word'")
    return found.groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(10)


def token_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize(table(spark, sf_dir, "documents"), "text", WORDS, ["doc_id"]).where("token = 'word'").groupBy("doc_id").agg(F.count("*").alias("n_words"))
    return table(spark, sf_dir, "labels").join(words, "doc_id").groupBy("quality").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n"))


HTML = Tokenizer([("text", "[^<&]+"), ("tag", "<[^>]*>"), ("entity", "&#?[A-Za-z0-9]+;")])


def tokenize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize(table(spark, sf_dir, "pages"), "html", HTML, ["page_id"])
    return found.groupBy("token").agg(F.count("*").alias("n"))


def parse_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "pages"), "url", formats.url(), ["page_id"], mode="DROPMALFORMED").drop("seq")


def parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = rx("[0-9]+").on_enter("mark").on_exit("k")
    parser = RecordParser(cat('{"k": ', number, "}"), {"mark": Mark(), "k": (Capture("k"), Emit())}, "k int")
    return parse_records(table(spark, sf_dir, "events"), "props", parser, ["event_id"], mode="FAILFAST").drop("seq")


def parse_part_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = rx("[0-9]+").on_enter("mark").on_exit("number")
    parser = RecordParser(cat("Brand#", number), {"mark": Mark(), "number": (Capture("number"), Emit())}, "number int")
    return parse_records(table(spark, sf_dir, "part"), "p_brand", parser, ["p_partkey"], mode="FAILFAST").drop("seq")


def parse_customer_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = rx("[0-9]+").on_enter("mark").on_exit("number")
    parser = RecordParser(cat("Customer#", number), {"mark": Mark(), "number": (Capture("number"), Emit())}, "number long")
    return parse_records(table(spark, sf_dir, "customer"), "c_name", parser, ["c_custkey"], mode="FAILFAST").drop("seq")


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that aren't empty, with their lengths in bytes."""
    line = rx("[^\n]+").on_enter("mark").on_exit("line")
    parser = RecordParser(cat(opt(line), rep(cat("\n", opt(line)))), {"mark": Mark(), "line": (Capture("line"), Emit())}, "line string")
    found = parse_records(table(spark, sf_dir, "documents"), "text", parser, ["doc_id"], mode="FAILFAST")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("bytes"))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a keyword and identifier machine over words of part types."""
    keyword = rx("ECONOMY|STANDARD|PROMO|SMALL|MEDIUM|LARGE").on_exit("keyword")
    word = (rx("[A-Z]+") - rx("ECONOMY|STANDARD|PROMO|SMALL|MEDIUM|LARGE")).on_exit("word")
    item = keyword | word
    found = table(spark, sf_dir, "part").select("p_partkey", B.run("p_type", cat(item, rep(cat(" ", item)))).alias("r"))
    return found.select("p_partkey", F.col("r.status").alias("status"), F.array_join(F.col("r.events.action"), ",").alias("log"))


def resume_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks: composed chunk maps say what a run of the whole says."""
    chunks = chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    found = final_states(chunks, ASCII)
    return found.select(F.col("stream_id").cast("long").alias("doc_id"), "accepted")


def errors_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_error() of documents that are read in chunks, each of them by itself."""
    found = first_errors(chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 1000), ASCII)
    return found.select(F.col("stream_id").cast("long").alias("doc_id"), F.col("position").cast("int").alias("err"))


def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL."""
    register(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("fsm_suppliers")
    return spark.sql("SELECT s_suppkey, t.seq, t.start, t.len, t.token FROM fsm_suppliers, LATERAL fsm_tokens(s_name, array('[A-Za-z]+', '#', '[0-9]+')) t")


FASTA_SHAPE = rx("(>[a-z]+\n([ACGT]+\n)+)*")


def machine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.edges(spark, compile_regex(FASTA_SHAPE))


def machine_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.states(spark, compile_regex(FASTA_SHAPE))


def trace_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(B.trace("p_name", "[a-z]+( [a-z]+)*")).alias("at", "t"))
    return found.select("p_partkey", "at", "t.byte", "t.state", F.array_join("t.actions", ",").alias("actions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in MATCHES.items()} | {
    f.__name__: f
    for f in (
        first_error_ascii, error_location_ascii, status_props, validate_lines, tokenize_words, token_rows, token_histogram, token_top_words, token_join_labels, tokenize_html,
        parse_url, parse_props, parse_part_brand, parse_customer_number, line_records, action_log, resume_chunks, errors_in_chunks, sql_tokens, machine_edges, machine_states, trace_part_names,
    )
} | fixture_queries.QUERIES

_PREFIX = r"regexp_extract(text, '^[\x00-\x7f]*')"
_TOKENS = r"regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[ \t\n]+|[^A-Za-z0-9 \t\n]+')"
_KIND = r"CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN 'word' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, '^[ \t\n]') THEN 'blank' ELSE 'error' END"

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in MATCHES.items()} | {
    "first_error_ascii": f"SELECT doc_id, CASE WHEN strlen({_PREFIX}) = strlen(text) THEN NULL ELSE strlen({_PREFIX}) + 1 END::INTEGER AS err FROM documents",
    "error_location_ascii": f"""
        WITH p AS (SELECT doc_id, text, {_PREFIX} AS pre FROM documents), q AS (SELECT doc_id, strlen(pre) < strlen(text) AS bad, pre, encode(text) AS raw FROM p)
        SELECT doc_id, CASE WHEN bad THEN ('0x' || substr(hex(raw), 2 * strlen(pre)::INTEGER + 1, 2))::INTEGER END AS byte,
            CASE WHEN bad THEN 1 + length(pre) - length(replace(pre, chr(10), '')) END::BIGINT AS line, CASE WHEN bad THEN length(string_split(pre, chr(10))[-1]) + 1 END::BIGINT AS col FROM q""",
    "status_props": r"""SELECT CASE WHEN regexp_full_match(props, '\{"k": [0-9]+\}') THEN 'ok' WHEN regexp_full_match(props, '\{("(k("(:( [0-9]*)?)?)?)?)?') THEN 'incomplete' ELSE 'error' END AS status, count(*) AS n FROM events GROUP BY 1""",
    "validate_lines": r"""SELECT lang, CASE WHEN regexp_full_match(text, '([ -~]*\n)*') THEN 'ok' WHEN regexp_full_match(text, '([ -~]*\n)*[ -~]+') THEN 'incomplete' ELSE 'error' END AS status, count(*) AS n FROM documents GROUP BY 1, 2""",
    "tokenize_words": f"SELECT doc_id, {_KIND} AS token, count(*) AS n, sum(strlen(t))::BIGINT AS bytes FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS t FROM documents) GROUP BY 1, 2",
    "token_rows": f"""
        WITH s AS (SELECT p_partkey, {_TOKENS.format('p_name')} AS ts FROM part), u AS (SELECT p_partkey, unnest(ts) AS t, generate_subscripts(ts, 1) AS seq FROM s)
        SELECT p_partkey, seq::INTEGER AS seq, (1 + coalesce(sum(strlen(t)) OVER (PARTITION BY p_partkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, strlen(t)::INTEGER AS len, {_KIND} AS token, t AS piece FROM u""",
    "token_histogram": f"SELECT role, {_KIND} AS token, count(*) AS n FROM (SELECT role, unnest({_TOKENS.format('text')}) AS t FROM conversations) GROUP BY 1, 2",
    "token_top_words": "SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 10",
    "token_join_labels": """
        WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words FROM documents)
        SELECT quality, sum(n_words)::BIGINT AS n_words, count(*) AS n FROM labels JOIN w USING (doc_id) WHERE n_words > 0 GROUP BY quality""",
    "tokenize_html": """
        SELECT token, count(*) AS n FROM (SELECT CASE WHEN t[1] NOT IN ('<', '&') THEN 'text' WHEN t[1] = '<' AND t[-1] = '>' THEN 'tag' WHEN t[1] = '&' AND t[-1] = ';' THEN 'entity' ELSE 'error' END AS token
            FROM (SELECT unnest(regexp_extract_all(html, '<[^>]*>|<[^>]*$|[^<&]+|&#?[A-Za-z0-9]+;|&')) AS t FROM pages)) GROUP BY token""",
    "parse_url": r"""
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), '') AS path,
            nullif(regexp_extract(url, '\?([^#]+)', 1), '') AS query, nullif(regexp_extract(url, '#(.+)', 1), '') AS fragment FROM pages WHERE regexp_full_match(url, '[a-z]+://[^/?#:]+(/[^?#]*)?(\?[^#]*)?(#.*)?')""",
    "parse_props": "SELECT event_id, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events",
    "parse_part_brand": "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+')::INTEGER AS number FROM part",
    "parse_customer_number": "SELECT c_custkey, regexp_extract(c_name, '[0-9]+')::BIGINT AS number FROM customer",
    "line_records": "SELECT doc_id, count(*) AS n_lines, sum(strlen(l))::BIGINT AS bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY doc_id",
    "action_log": r"""
        SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '[A-Z]+( [A-Z]+)*') THEN 'ok' ELSE 'error' END AS status,
            array_to_string(list_transform(string_split(p_type, ' '), lambda w: CASE WHEN w IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM', 'LARGE') THEN 'keyword' ELSE 'word' END), ',') AS log FROM part""",
    "resume_chunks": r"SELECT doc_id, regexp_full_match(text, '(?s)[\x00-\x7f]*') AS accepted FROM documents",
    "errors_in_chunks": f"SELECT doc_id, CASE WHEN strlen({_PREFIX}) = strlen(text) THEN NULL ELSE strlen({_PREFIX}) + 1 END::INTEGER AS err FROM documents",
    "sql_tokens": """
        WITH s AS (SELECT s_suppkey, regexp_extract_all(s_name, '[A-Za-z]+|#|[0-9]+') AS ts FROM supplier), u AS (SELECT s_suppkey, unnest(ts) AS t, generate_subscripts(ts, 1) AS seq FROM s)
        SELECT s_suppkey, seq::INTEGER AS seq, (1 + coalesce(sum(strlen(t)) OVER (PARTITION BY s_suppkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, strlen(t)::INTEGER AS len,
            CASE WHEN t = '#' THEN 2 WHEN regexp_matches(t, '^[0-9]') THEN 3 ELSE 1 END::INTEGER AS token FROM u""",
    "trace_part_names": r"""
        WITH u AS (SELECT p_partkey, p_name, unnest(range(0, length(p_name) + 1)) AS k FROM part)
        SELECT p_partkey, k::INTEGER AS at, CASE WHEN k < length(p_name) THEN ascii(p_name[k + 1]) END::SMALLINT AS byte, CASE WHEN k = length(p_name) THEN 0 WHEN p_name[k + 1] = ' ' THEN 1 ELSE 2 END::INTEGER AS state, '' AS actions FROM u""",
} | fixture_queries.ORACLE_SQL
