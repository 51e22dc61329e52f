"""URL filtering by listed rules and by association rules that FP-growth mines from labelled URLs.

Everything runs in Catalyst and in Spark's own FP-growth; there is no Python on the executors. A URL's tokens are its
host's suffixes, the directories of its path, the words of its host labels and the names in its query. FP-growth finds
token sets that are frequent together with a verdict. Of their rules those with enough confidence, support and lift
stay, and among them those that no more general rule with the same verdict implies. Rules match by an inverted index
from token to rules: a rule holds for a URL when all of its tokens were met. A small index is a literal in the plan, so
judging needs no shuffle; a larger one is a table that URLs meet in a join.

Tokens that occur in the same labelled URLs (the directories of one path, the suffixes of one host) are one item: mining
all their subsets would take time that grows exponentially with their number and say the same. The shortest stands for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tokens in all rules up to which the index may be part of the plan; a larger one is a table that is joined.
INDEX_TOKENS = 20_000
#: What decides for a URL that no listed rule fits.
MATCH = "struct<tokens: string, verdict: string, confidence: double>"
#: The two verdicts.
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A listed rule: a host and its subdomains, and the beginning of a path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Mined:
    """A mined rule: URLs with all of the tokens get the verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    lift: float


def rules(lines: str) -> list[Rule]:
    """Rules from 'allow host/path, block host/path, ...'."""
    return [Rule(*line.split()) for line in lines.split(",")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, given: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equally long ones the first as strings), or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(given, key=lambda r: (-len(r.text), r.text))[::-1]:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, as an array in order."""
    labels = F.split(F.split_part(host, F.lit(":"), F.lit(1)), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("word:"), x))
    # a directory, or a last segment without what counts pages up
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "0")))
    names = F.transform(F.filter(F.split(query_of(url), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.split_part(s, F.lit("="), F.lit(1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(suffixes, words, parts, names))))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, lift: float = 1.2, least: int = 20) -> list[Mined]:
    """Rules from labelled (tokens array<string>, verdict string).

    support: share of the rows with all tokens and the verdict; they must be least rows at any rate.

    Rows with a null verdict are left out; no rows give no rules. The frequent sets, and so what reaches the driver,
    are limited by the support, which is a share of the rows and not a number.
    """
    verdicts = F.concat(F.lit("= "), F.col("verdict"))
    baskets = labelled.where("verdict is not null and size(tokens) > 0").select(F.array_append("tokens", verdicts).alias("items"))
    baskets = materialize(merged(baskets), "baskets")
    n = baskets.count()
    if n < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("= ")).where(F.col("lift") >= lift)
    rows = found.select("antecedent", F.element_at("consequent", 1).alias("verdict"), "confidence", "lift", "support").collect()
    every = [Mined(tuple(sorted(r[0])), r[1][2:], r[2], r[4], r[3]) for r in rows if not any(t.startswith("= ") for t in r[0])]
    return pruned(every)


def merged(baskets: DataFrame) -> DataFrame:
    """baskets (items) with one item for those that occur in the same rows: the shortest, then the first. Verdicts stay."""
    rows = materialize(baskets.withColumn("row", F.monotonically_increasing_id()), "rows")
    pairs = rows.select("row", F.explode("items").alias("item")).where(~F.col("item").startswith("= "))
    prints = pairs.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    first = prints.groupBy("n", "x", "y").agg(F.min(F.struct(F.length("item").alias("length"), F.col("item"))).alias("first"))
    kept = pairs.join(first.select(F.col("first.item").alias("item")), "item").groupBy("row").agg(F.collect_list("item").alias("kept"))
    verdicts = F.filter("items", lambda i: i.startswith("= "))
    return rows.join(kept, "row").select(F.array_sort(F.concat("kept", verdicts)).alias("items"))


def pruned(every: list[Mined]) -> list[Mined]:
    """Without rules that a more general one with the same verdict and no less confidence implies."""
    kept: list[Mined] = []
    for rule in sorted(every, key=lambda r: (len(r.tokens), -r.confidence, r.tokens, r.verdict)):
        own = set(rule.tokens)
        if not any(k.verdict == rule.verdict and k.confidence >= rule.confidence and own.issuperset(k.tokens) for k in kept):
            kept.append(rule)
    return kept


def matched(found: Column, mined: list[Mined]) -> Column:
    """struct(tokens, verdict, confidence) of the best mined rule that the tokens fulfil, or null.

    Best: most confident, then most tokens, then as strings.
    """
    if not mined:
        return F.lit(None).cast(MATCH)
    order = sorted(mined, key=lambda r: (-r.confidence, -len(r.tokens), r.tokens, r.verdict))
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(order):
        for token in rule.tokens:
            index.setdefault(token, []).append(i)
    lookup = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ids)))])
    sizes = F.array(*[F.lit(len(r.tokens)) for r in order])
    met = F.flatten(F.filter(F.transform(found, lambda t: F.try_element_at(lookup, t)), lambda a: a.isNotNull()))
    full = F.filter(F.array_distinct(met), lambda i: F.size(F.filter(met, lambda j: j == i)) == F.element_at(sizes, i + 1))
    facts = F.array(*[F.struct(F.lit(" ".join(r.tokens)).alias("tokens"), F.lit(r.verdict).alias("verdict"), F.lit(r.confidence).alias("confidence")) for r in order])
    return F.try_element_at(facts, F.array_min(full) + 1)


def joined(read: DataFrame, mined: list[Mined]) -> DataFrame:
    """read (tokens, ...) with the column best, as matched() has it, by a join of the tokens with the index."""
    spark = read.sparkSession
    order = sorted(mined, key=lambda r: (-r.confidence, -len(r.tokens), r.tokens, r.verdict))
    index = spark.createDataFrame([(t, i, len(r.tokens)) for i, r in enumerate(order) for t in r.tokens], "token string, rule int, size int")
    facts = spark.createDataFrame([(i, " ".join(r.tokens), r.verdict, r.confidence) for i, r in enumerate(order)], "rule int, tokens string, verdict string, confidence double")
    keyed = materialize(read.withColumn("row", F.monotonically_increasing_id()), "urls")
    met = keyed.select("row", F.explode("tokens").alias("token")).join(index, "token").groupBy("row", "rule").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    best = met.where("n = size").groupBy("row").agg(F.min("rule").alias("rule")).join(facts, "rule").select("row", F.struct("tokens", "verdict", "confidence").alias("best"))
    return keyed.join(best, "row", "left").drop("row")


def labelled(read: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, verdict): the pages that labels has under their id; poor quality or toxicity means block."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return read.select("page_id", "tokens").join(known, "page_id").select("tokens", F.when(F.col("bad"), BLOCK).otherwise(ALLOW).alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, given: list[Rule], support: float = 0.005, confidence: float = 0.9, lift: float = 1.2, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for each row of pages (page_id, url).

    Listed rules come first; for other URLs the rules that are mined from labels (doc_id, quality, toxic) decide, doc_id
    being the page's id, and where none fits the default. mined: the tokens of the mined rule that decided, else null. A
    null url, or one without ://, has empty host and path, no tokens, and gets the default. Repeated rows are judged
    alike; other columns are not read; an empty table gives no rows.
    """
    url = F.col("url")
    read = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    read = read.select("page_id", "host", "path", listed(F.col("host"), F.col("path"), given).alias("given"), tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(labelled(read, labels), support, confidence, lift)
    if sum(len(r.tokens) for r in mined) > INDEX_TOKENS:
        read = joined(read, mined)
    else:
        read = read.withColumn("best", matched(F.col("tokens"), mined))
    read = read.select("page_id", "host", "path", "given", F.when(F.col("given").isNull(), F.col("best")).alias("best"))
    return read.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.tokens").alias("mined"))
