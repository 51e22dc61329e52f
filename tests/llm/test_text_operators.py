"""Operators on single texts and pages: defined results in odd cases, brute force, round trips, held-out accuracy."""

import base64
import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from bytewright.llm import decontaminate, html_text, pii, suffix_tree, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns(extra) if extra else df


# words of all kinds, and cases that break careless code
ODD = [None, "", " \n\t", "a", "word " * 40_000, "é ñ ß", "\u0000 null", "x" * 200_000, "a\u2028b\u00a0c", "🙂 " * 50, "A B C D E F G H I J K L M N O P"]


class TestDecontaminate:
    def brute(self, text, items, width):
        norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        words = norm(text)
        hit, who = set(), set()
        for item, t in items:
            own = norm(t)
            k = min(width, len(own))
            for j in range(len(own) - k + 1) if own else ():
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == own[j : j + k]:
                        hit.update(range(i, i + k))
                        who.add(str(item))
        return len(words), len(hit), sorted(who)

    def test_against_brute_force(self, spark):
        draw = random.Random(4)
        word = lambda: draw.choice(["a", "b", "C", "dé", "7"])
        sep = lambda: draw.choice([" ", "-", "\n", ", ", "__"])
        make = lambda n: "".join(word() + sep() for _ in range(n))
        texts = [make(draw.randint(0, 60)) for _ in range(60)] + [None, "", "?!"]
        items = [(i, make(draw.randint(0, 12))) for i in range(12)] + [(3, make(5)), (99, None), (98, "")]
        found = decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), width=4).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r["items"]) for r in found] == [self.brute(t, items, 4) for t in texts]

    @pytest.mark.parametrize("limit", [1, 60])
    def test_several_automata_give_the_same(self, spark, monkeypatch, limit):
        draw = random.Random(5)
        make = lambda n: " ".join(draw.choice("abc") for _ in range(n))
        items = spark.createDataFrame([(i, make(draw.randint(0, 20))) for i in range(20)], "item_id long, text string")
        df = docs(spark, [make(draw.randint(0, 50)) for _ in range(40)] + [None, ""])
        whole = decontaminate.contamination(df, items, 6).orderBy("doc_id").collect()
        clean = {r.doc_id for r in decontaminate.clean(df, items, 6).collect()}
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
        assert len(list(decontaminate.parts_of(items))) > 3
        assert decontaminate.contamination(df, items, 6).orderBy("doc_id").collect() == whole
        assert {r.doc_id for r in decontaminate.clean(df, items, 6).collect()} == clean
        assert 0 < len(clean) < df.count()

    def test_spans_are_of_the_original(self, spark):
        text = "Before -- The QUICK, brown fox! after"
        items = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
        row = decontaminate.contamination(docs(spark, [text]), items).first()
        assert [text[s.start : s.end] for s in row.spans] == ["The QUICK, brown fox"]

    def test_odd_texts_and_empty_tables(self, spark):
        items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
        found = decontaminate.contamination(docs(spark, ODD), items).orderBy("doc_id").collect()
        assert len(found) == len(ODD)
        assert [r.n_hit for r in found if r.n_hit] == [14]
        assert decontaminate.contamination(docs(spark, []), items).count() == 0
        assert decontaminate.contamination(docs(spark, ["a"]), items.where("false")).first().n_hit == 0

    def test_filter_keeps_rows_as_they_are(self, spark):
        items = spark.createDataFrame([(1, "some secret question of the benchmark")], "item_id long, text string")
        df = docs(spark, ["some secret question of the benchmark", "clean", None, "some secret question of the benchmark " + "more " * 200], {"items": F.lit(7), "keep": F.lit("x")})
        kept = decontaminate.clean(df, items)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


class TestUrls:
    RULES = url_filter.rules("block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/")

    def brute(self, url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
        path = re.split("[?#]", rest)[0]
        fits = [r for r in self.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
        return host, path, best and best.text

    def test_rules_against_brute_force(self, spark):
        urls = [None, "", "no scheme", "http://", "http://COM/en/", "http://a.com/en/7?x=1", "https://www.example.com/en/72#top", "http://xexample.com/en/7", "http://example.net/de/8/9", "http://m.example.net/de/9", "http://b.org/es", "http://b.org/es/", "http://b.org?es/", "ftp://a.b://c/d", "http://h#x/y", "://x.com/en/a", "http://a.com:80/en/", "http://é.com/en/ü"]
        pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        found = url_filter.judge(pages, labels, self.RULES).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule) for r in found] == [self.brute(u) for u in urls]
        verdicts = {r.text: r.verdict for r in self.RULES}
        assert all(r.verdict == verdicts.get(r.rule, "allow") for r in found)
        assert url_filter.judge(pages.where("false"), labels, self.RULES).count() == 0

    @pytest.mark.parametrize("limit", [0, 20_000])
    def test_mined_verdicts_against_brute_force(self, spark, monkeypatch, limit):
        monkeypatch.setattr(url_filter, "INDEX_TOKENS", limit)
        draw = random.Random(9)
        rows = [(i, f"http://{draw.choice('abcd')}.{draw.choice(['x', 'y', 'z'])}.test/{draw.choice('pq')}/{draw.choice('rst')}") for i in range(600)] + [(600, None), (601, rows_url := "http://a.x.test/p/r"), (601, rows_url)]
        bad = lambda u: "/p/" in u and ".x." in u or "//b." in u
        pages = spark.createDataFrame(rows, "page_id long, url string")
        labels = spark.createDataFrame([(i, int(not bad(u)), 0) for i, u in rows[:600]], "doc_id long, quality int, toxic int")
        read = pages.select("page_id", url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"))
        mined = url_filter.mine(url_filter.labelled(read, labels))
        assert mined
        got = url_filter.judge(pages, labels, []).collect()
        assert len(got) == len(rows)
        own = {r.page_id: set(r.tokens) for r in read.collect()}
        for r in got:
            fits = [m for m in mined if own[r.page_id] >= set(m.tokens)]
            best = min(fits, key=lambda m: (-m.confidence, -len(m.tokens), m.tokens, m.verdict), default=None)
            assert (r.verdict, r.mined, r.rule) == ((best.verdict, " ".join(best.tokens), None) if best else ("allow", None, None))

    def test_tokens_that_always_meet_are_one(self, spark):
        deep = "/".join(f"d{i}" for i in range(24))
        rows = [(i, f"http://{'a.b.c.d.bad' if i % 2 else 'w.x.y.z.good'}.test/{deep}/{i % 2}") for i in range(200)]
        labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
        got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, self.RULES).collect()
        assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)

    def test_mined_rules_decide_the_rest(self, spark):
        rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}-{i % 7}.shop.test/{'buy' if i % 3 == 0 else 'read'}/{i}") for i in range(300)]
        pages = spark.createDataFrame(rows, "page_id long, url string")
        labels = spark.createDataFrame([(i, int(i % 3 != 0), None) for i in range(0, 300, 2)] + [(None, 0, 1), (0, None, 1)], "doc_id long, quality int, toxic int")
        found = url_filter.judge(pages, labels, self.RULES)
        assert {(r.page_id % 3 == 0, r.verdict) for r in found.collect()} == {(True, "block"), (False, "allow")}
        assert found.where("verdict = 'block' and mined is null").count() == 0

    def test_pruning(self):
        a = url_filter.Mined(("x",), "block", 0.95, 0.1, 2.0)
        b = url_filter.Mined(("x", "y"), "block", 0.95, 0.05, 2.0)
        c = url_filter.Mined(("x", "y"), "block", 0.99, 0.05, 2.0)
        assert url_filter.pruned([b, a]) == [a]
        assert url_filter.pruned([c, a]) == [a, c]


class TestToxicity:
    def corpus(self, spark, n=240):
        draw = random.Random(8)
        filler = lambda k: " ".join("".join(draw.choice("aeioustnr") for _ in range(draw.randint(2, 7))) for _ in range(k))
        rows, labels = [], []
        for i in range(n):
            toxic = i % 5 == 0
            insult = lambda: draw.choice(["blockhead", "nitwit", "stinkface", "stinkling"])
            text = ". ".join(filler(8) + (f" you {insult()} " if toxic else " you ") + filler(6) for _ in range(3))
            rows.append((i, text, "en", "s", len(text)))
            labels.append((i, 1, int(toxic)))
        return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def test_held_out_accuracy(self, spark):
        df, labels = self.corpus(spark)
        model = toxicity.fit(df, labels)
        found = toxicity.scores(df, model).collect()
        held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        assert len(held) > 50
        assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
        assert not any("you" in f for f in model.insults)

    def test_labels_of_held_out_rows_teach_nothing(self, spark):
        df, labels = self.corpus(spark)
        turned = labels.withColumn("toxic", F.when(toxicity.crc_mod(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        assert toxicity.fit(df, labels) == toxicity.fit(df, turned)

    def test_grammar(self):
        score = toxicity.Scorer({"fool": 1.0}).evidence
        assert score("a calm day") == score("") == 0
        assert score("you fool") > score("some fool") > score("he is not a fool") > 0
        assert score("they said: fool") == score("some fool")  # another clause
        assert score("they said fool") < score("some fool")
        assert score("i will hurt you") > 0 == score("it may hurt")
        assert score("fool. fool") == 2 * score("fool")

    def test_odd_texts_and_empty_tables(self, spark):
        df, labels = self.corpus(spark)
        none = labels.where("false")
        model = toxicity.fit(df, none)
        assert model.insults == {}
        scored = toxicity.scores(docs(spark, ODD), toxicity.fit(df, labels)).collect()
        assert len(scored) == len(ODD)
        assert all(0 <= r.score < 0.7 for r in scored)
        assert toxicity.fit(df.where("false"), labels).insults == {}
        assert toxicity.reject(docs(spark, ODD, {"score": F.lit(1)}), model).count() == len(ODD)


class TestPersonalData:
    PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(self, text):
        out = []
        for kind, pattern in self.PATTERNS.items():
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
                if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                    out.append((kind, m.start(), m.end()))
        return out

    def test_base_spans_against_the_patterns(self):
        draw = random.Random(5)
        for _ in range(4000):
            text = "".join(draw.choice(["a", "b.", "@", "x@y.z", ".", "-", "1", "12", "255", "4111111111111111", "+1 ", " ", "(", ")", "\n", "é", "%", "+"]) for _ in range(draw.randint(0, 14)))
            assert [tuple(s) for s in pii.base_spans(text)] == self.brute(text), text

    def test_long_runs_take_linear_time(self):
        assert pii.base_spans("a" * 300_000 + " x@y.z")[0] == ("email", 300_001, 300_006)
        assert pii.base_spans("1" * 300_000) == []
        assert len(pii.base_spans("1." * 100_000)) == 25_000 - 1 + 1
        assert pii.find("+1" + " " * 100_000, {})[0] == []

    def test_held_out_accuracy_of_the_model(self):
        weights = pii.train()
        right = wrong = missed = 0
        for text, truth in pii.training_texts(300, seed=1234):
            base, found = pii.find(text, weights)
            right += len(set(found) & set(truth))
            wrong += len(set(found) - set(truth))
            missed += sum(1 for s in truth if s not in found and not any(b.start < s.end and s.start < b.end for b in base))
        assert right / (right + wrong) > 0.95
        assert right / (right + missed) > 0.9

    def test_best_against_all_subsets(self):
        draw = random.Random(2)
        for _ in range(200):
            spans = sorted({pii.Span("number", a, a + draw.randint(1, 5)) for a in (draw.randint(0, 12) for _ in range(6))}, key=lambda s: (s.end, s.start))
            scores = [draw.uniform(-1, 2) for _ in spans]
            value = {s: v for s, v in zip(spans, scores, strict=True)}
            subsets = [[s for i, s in enumerate(spans) if m >> i & 1] for m in range(1 << len(spans))]
            free = [x for x in subsets if all(a.end <= b.start or b.end <= a.start for i, a in enumerate(x) for b in x[:i])]
            assert sum(value[s] for s in pii.best(spans, scores)) == pytest.approx(max(sum(value[s] for s in x) for x in free))
            weight = [2.718281828459045 ** sum(value[s] for s in x) for x in free]
            for s, p in zip(spans, pii.marginals(spans, scores), strict=True):
                assert p == pytest.approx(sum(w for w, x in zip(weight, free, strict=True) if s in x) / sum(weight))

    def test_found_and_redacted(self, spark):
        text = 'Mail ann.b@x.example.com or ann (at) mail (dot) org, token = "0123456789abcdef0123456789abcdef01234567", é 10.0.0.1.'
        row = pii.spans_of(docs(spark, [text])).first()
        got = {(s.kind, text[s.start : s.end]) for s in [*row.base, *row.learned]}
        assert {("email", "ann.b@x.example.com"), ("ip", "10.0.0.1"), ("secret", "0123456789abcdef0123456789abcdef01234567"), ("contact", "ann (at) mail (dot) org")} <= got
        df = docs(spark, [text, *ODD], {"spans": F.lit("x")})
        out = pii.redact(df).orderBy("doc_id").collect()
        assert out[0].text == 'Mail <email> or <contact>, token = "<secret>", é <ip>.'
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
        assert [r.text for r in out[1:]] == ODD
        assert pii.redact(df.where("false")).count() == 0

    def test_adjacent_entities(self):
        weights = pii.train()
        for text, wanted in [
            ("call 555-123-4567 555-987-6543", [("number", "555-123-4567"), ("number", "555-987-6543")]),
            ("konto 4111111111111112 2024-05-06", [("account", "4111111111111112")]),
            ("account 1234567812345678 8765432187654321", [("account", "1234567812345678"), ("account", "8765432187654321")]),
        ]:
            proposed = {(s.kind, text[s.start : s.end]) for s in pii.candidates(text, pii.base_spans(text))}
            assert proposed >= set(wanted), text
            assert [(s.kind, text[s.start : s.end]) for s in pii.find(text, weights)[1]] == wanted

    def test_every_segment_between_tokens_is_proposed(self):
        text = "x (12) 34-56 789 0123456789 98 76.54 AB12 3456 7890 1234 ann at b dot co dot uk"
        ends = [m.start() for m in re.finditer(r"[(0-9A-Za-z]", text)], [m.end() for m in re.finditer(r"[0-9A-Za-z]+", text)]
        wanted = set()
        for kind, pattern, _ in pii.PROPOSALS:
            if kind != "secret":
                spans = ((a, b) for a in ends[0] for b in ends[1] if a < b)
                wanted |= {(kind, a, b) for a, b in spans if pattern.fullmatch(text, a, b)}
        got = {tuple(s) for s in pii.candidates(text, []) if s.kind != "secret"}
        assert got == wanted

    def test_secrets_of_letters_and_long_ones(self):
        key = "".join(random.Random(1).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(40))
        for text in (f"bearer {key} end", f"bearer {key} end 7"):
            assert pii.Span("secret", 7, 47) in pii.candidates(text, [])
        for n in (129, 1000, 8192):
            long = (key * n)[:n]
            assert pii.Span("secret", 7, 7 + n) in pii.candidates(f"bearer {long} end", [])

    def test_overlapping_spans_become_one(self):
        assert pii.redacted("abcdef", [pii.Span("ip", 1, 3), pii.Span("card", 2, 5)]) == "a<ip>f"


class TestPages:
    def test_articles(self):
        page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
        <nav><ul><li>Home</li></ul></nav><header>Site</header><div class="cookie-notice">Cookies<div>inner</div></div>
        <article><h1>Big &amp; small</h1><p>One<br>two <b>three</b>
        four<p>Next <span class="ad-label">Buy</span>part<div class="ad">Buy</div><form><p>Name</p></form><ul><li>a<li>b</ul>
        <aside>Side</aside><section class="comments"><p>First!</p></section><p>Caf&eacute; &#8364;&nbsp;5 &lt;ok&gt;</p></article>
        <div id="sidebar">More</div><footer>&copy; me</footer></body></html>"""
        assert html_text.article_text(page) == "Big & small\n\nOne two three four\n\nNext part\n\na\n\nb\n\nCafé € 5 <ok>"

    @pytest.mark.parametrize(
        "page, text",
        [
            ('<article><h1 class="page-header">Title</h1><p>x</p></article>', "Title\n\nx"),
            ('<article><div class="ad-hoc">Ad hoc</div><div class="ad-box">Buy</div><p class="alert">Alert</p></article>', "Ad hoc\n\nAlert"),
            ('<article><div class="search-results">Found</div><p class="ad">Buy</p><div class="comments"><p>c</p></div></article>', "Found"),
            ('<div id="widget"><article><p>All</p></article></div>', "All"),
            ('<div class="sidebar"><article>Teaser</article></div><article>Own</article>', "Own"),
            ('<article><a title="x>link</a> y</article>', "link y"),
        ],
    )
    def test_marks_that_mislead(self, page, text):
        assert html_text.article_text(page) == text

    def test_only_plain_capitals_of_hosts_are_lowered(self):
        assert html_text.host_of("http://ÄB.Test/X") == "Äb.test"

    def test_pages_that_are_cut_off(self):
        assert html_text.article_text("<article><p>One &am") == "One &am"
        assert html_text.article_text("<article><p>One &amp") == "One &"
        assert html_text.article_text("<article><p>One <b") == "One"
        assert html_text.article_text("<article><p>One<script>var x") == "One"
        assert html_text.article_text("<article><p>One<!-- two") == "One"
        assert html_text.article_text("<article></article>") == ""
        assert html_text.article_text("<p>no article") is None
        assert html_text.article_text('<article><a href="x>y</article>') is not None

    def test_host_repeats_are_removed(self, spark):
        boiler = "Welcome to the best site of all please subscribe to our weekly letter"
        words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
        rows = [(k, f"http://a.test/{k}", f"<div>{boiler}</div><div>{words(k)}</div><nav>menu</nav>") for k in range(3)]
        rows += [(10, "http://b.test/", f"<div>{boiler}</div>"), (11, None, None), (12, "x", ""), (13, "http://a.test/0", rows[0][2]), (13, "http://a.test/0", rows[0][2])]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
        got = [(r.page_id, r.text) for r in html_text.extract(pages).orderBy("page_id").collect()]
        assert got[:3] == [(0, words(0)), (1, words(1)), (2, words(2))]
        assert got[3:6] == [(10, boiler), (11, ""), (12, "")]
        assert len(got) == len(rows)
        assert html_text.extract(pages.where("false")).count() == 0

    def test_suffixes_against_brute_force(self, spark):
        draw = random.Random(6)
        texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 14))) for _ in range(20)]
        pages = spark.createDataFrame([(i, f"http://h{i % 2}/", f"<div>{t}</div>") for i, t in enumerate(texts)], "page_id long, url string, html string")
        run = 4
        for r in html_text.extract(pages, run=run).collect():
            own, others = texts[r.page_id].split(), [t.split() for i, t in enumerate(texts) if i != r.page_id and i % 2 == r.page_id % 2]
            grams = {tuple(o[k : k + run]) for o in others for k in range(len(o) - run + 1)}
            covered = {k + j for k in range(len(own) - run + 1) if tuple(own[k : k + run]) in grams for j in range(run)}
            assert r.text == (" ".join(w for k, w in enumerate(own) if k not in covered) or " ".join(own))

    def test_longest_repeats_of_a_suffix_array(self):
        draw = random.Random(8)
        for run in (1, 2, 3):
            pages = [[draw.choice("ab") for _ in range(draw.randint(0, 9))] for _ in range(5)]
            every = {}
            for page, tokens in enumerate(pages):
                for i in range(len(tokens)):
                    every.setdefault((f"h{page % 2}", " ".join(tokens[i : i + 6])), set()).add(page)
            rows = [(*k, min(v), max(v)) for k, v in sorted(every.items())]

            def want(host, suffix):
                own = every[host, suffix]
                return max((html_text.common(s.split(), suffix.split()) for (h, s), v in every.items() if h == host and len(v | own) > 1), default=0)

            got = {(h, s): n for h, s, n in html_text.longest(rows, run)}
            assert got == {k: n for k in every if (n := want(*k)) >= run}
        rows = [("h", "a b c", 1, 1), ("h", "a b d", 1, 1), ("h", "a c", 2, 2), ("i", "a c", 3, 3)]
        assert list(html_text.longest(rows, 1)) == [("h", "a b d", 1), ("h", "a b c", 1), ("h", "a c", 1)]
        assert list(html_text.longest(rows, 2)) == []


class TestTokenCounts:
    @pytest.fixture(scope="class")
    def counter(self):
        with open(token_counts.VOCABULARY, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return token_counts.Counter(ranks)

    def test_edits_against_counting_anew(self, counter):
        draw = random.Random(1)
        letters = "ab 'sltdmrve  \n\t1é!?.,x"
        for _ in range(300):
            text = "".join(draw.choice(letters) for _ in range(draw.choice([0, 3, 20, 200, 1500])))
            tree = token_counts.CountedText(text, counter)
            for _ in range(4):
                a = draw.randint(0, len(text))
                b = min(len(text), a + draw.choice([0, 0, 1, 3, 30, 400]))
                new = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 4, 300])))
                text = text[:a] + new + text[b:]
                tree.edit(a, b, new)
                assert tree.text() == text
                assert [p for own, _ in tree.leaves for p in own] == counter.pattern.findall(text)
                assert tree.total() == len(counter.encoding.encode_ordinary(text))

    def test_a_large_insert_encodes_what_it_brings_alone(self, counter, monkeypatch):
        tree = token_counts.CountedText("one two three " * 5_000, counter)
        asked = []
        monkeypatch.setattr(counter, "counts", lambda pieces, f=counter.counts: asked.append(len(pieces)) or f(pieces))
        before = tree.encoded
        tree.edit(700, 700, "four " * 600)
        assert tree.encoded - before == sum(asked) < 620
        assert tree.total() == len(counter.encoding.encode_ordinary(tree.text()))

    def test_a_vocabulary_on_any_file_system(self, spark):
        assert token_counts.read_ranks(spark, f"file://{token_counts.VOCABULARY}") == token_counts.read_ranks(spark)

    def test_an_edit_is_local(self, counter):
        tree = token_counts.CountedText("one two three " * 20_000, counter)
        before = tree.encoded
        tree.edit(140_000, 140_003, "eleven")
        assert tree.encoded - before < 100
        with pytest.raises(ValueError, match="outside"):
            tree.edit(5, 4, "")

    def test_query(self, spark):
        texts = [*ODD, "write to a@b.example.com now"]
        rows = token_counts.counted(docs(spark, texts, {"n_tokens": F.lit(0)}), lambda t: [(9, 24, "<email>")] if "@" in t else []).orderBy("doc_id").collect()
        with open(token_counts.VOCABULARY, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        plain = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [r.n_tokens for r in rows] == [len(plain.encode_ordinary(t or "")) for t in texts]
        assert rows[-1].n_tokens_after == len(plain.encode_ordinary("write to <email> now"))
        assert (rows[-1].n_edits, rows[0].n_edits) == (1, 0)


class TestSuffixTree:
    def test_counting_keys_holds_few_copies(self):
        keys = np.random.default_rng(3).permutation(200_000)
        tracemalloc.start()
        try:
            first, n = suffix_tree.distinct(keys)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert (keys[first] == np.arange(len(keys))).all() and (n == 1).all()
        assert peak < 40 * len(keys)

    def test_workers_give_freed_arrays_back(self):
        code = """
import numpy as np
from bytewright.llm import common
getattr(common, "lean", lambda: None)()
def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096
def full(mb):
    return np.ones(mb << 20, np.int8)
full(24)
before = resident()
x = full(20)
del x
print(resident() - before)
"""
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
        assert int(done.stdout) < 4 << 20

    def corpus(self, spark):
        draw = random.Random(9)
        after = {w: draw.sample("abcde", 2) for w in "abcde"}
        texts = []
        for _ in range(300):
            w, out = "a", ["a" * 3]
            for _ in range(40):
                likely = after[w][zlib.crc32(" ".join(out[-3:]).encode()) % 2]  # by the last three
                w = likely if draw.random() < 0.9 else draw.choice("abcde")
                out.append(w * 3)
            texts.append(" ".join(out))
        return docs(spark, [*texts, None, "", "unseen words only", "aaa. bbb, 123 é"])

    def brute(self, texts, trains, depth=3, least=(8, 8, 8), pair_least=3, gain=3.0):
        """(n_known, base, score) of each text by plain dictionaries."""
        tokens = [[*(t or "").lower().split(), None] for t in texts]
        learnt = [t for t, ok in zip(tokens, trains, strict=True) if ok]
        words = Counter(w for t in learnt for w in t)
        z = sum(words.values()) + 0.5 * (len(words) + 1)
        root = lambda w: (words[w] + 0.5) / z
        grams = {d: Counter() for d in range(1, depth + 1)}
        totals = Counter()
        for t in learnt:
            line = ["<s>", *t]
            for i in range(1, len(line)):
                for d in range(1, depth + 1):
                    if i >= d:
                        grams[d][(*line[i - d : i], line[i])] += 1
                        totals[tuple(line[i - d : i])] += 1
        states = {}

        def p(w, context):
            if context not in states:
                return p(w, context[1:]) if context else root(w)
            kept, left = states[context]
            return kept.get(w, 0.0) + left * p(w, context[1:])

        for d in range(1, depth + 1):
            new = {}
            for context in {g[:-1] for g in grams[d]}:
                if totals[context] < least[d - 1] or d > 1 and context[1:] not in states:
                    continue
                kept = {g[-1]: (n - suffix_tree.DISCOUNT) / totals[context] for g, n in grams[d].items() if g[:-1] == context and n >= pair_least}
                left = 1 - sum(kept.values())
                won = sum(grams[d][(*context, w)] * math.log((k + left * p(w, context[1:])) / p(w, context[1:])) for w, k in kept.items())
                if kept and won >= gain * len(kept):
                    new[context] = kept, left
            states.update(new)
        out = []
        for t in tokens:
            line = ["<s>", *t]
            s = sum(math.log10(p(line[i], tuple(line[max(0, i - depth) : i]))) for i in range(1, len(line)))
            out.append((sum(words[w] > 0 for w in t), sum(math.log10(root(w)) for w in t), s))
        return out, states, p

    def caches(self, monkeypatch, size, bits):
        for name in ("WORDS", "STATES", "SUCCESSORS"):
            monkeypatch.setattr(suffix_tree, name, size)
        monkeypatch.setattr(suffix_tree, "BITS", bits)

    @pytest.mark.parametrize(("size", "bits"), [(1 << 18, 1 << 20), (3, 1 << 20), (3, 64), (0, 8)])
    def test_scores_against_brute_force_whatever_the_caches_hold(self, spark, monkeypatch, size, bits):
        self.caches(monkeypatch, size, bits)
        df = self.corpus(spark)
        rows = sorted(suffix_tree.score(df, suffix_tree.fit(df)).collect(), key=lambda r: r.doc_id)
        texts = [r.text for r in df.orderBy("doc_id").collect()]
        wanted, states, _ = self.brute(texts, [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))])
        assert {len(c) for c in states} == {1, 2, 3}
        assert [r.n_known for r in rows] == [w[0] for w in wanted]
        assert [r.base_score for r in rows] == pytest.approx([w[1] for w in wanted])
        assert [r.score for r in rows] == pytest.approx([w[2] for w in wanted])
        held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 1 and r.n_tokens > 10]
        assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)

    def test_a_model_scores_other_tables(self, spark, monkeypatch):
        self.caches(monkeypatch, 3, 64)
        df = self.corpus(spark)
        texts = [r.text for r in df.orderBy("doc_id").collect()]
        other = ["aaa bbb ccc unseen bbb", None, "ddd ddd eee", "aaa " * 5000]
        rows = suffix_tree.score(docs(spark, other, {"row": F.lit(1), "c": F.lit(2)}), suffix_tree.fit(df)).orderBy("doc_id").collect()
        wanted, _, _ = self.brute([*texts, *other], [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))] + [False] * len(other))
        assert [r.score for r in rows] == pytest.approx([w[2] for w in wanted[-len(other) :]])

    def test_it_is_a_distribution(self, spark):
        # of the brute force, which the operator equals
        texts = [r.text for r in self.corpus(spark).collect()]
        _, states, p = self.brute(texts, [True] * len(texts))
        words = {w for t in texts for w in (t or "").lower().split()} | {None}
        for context in [(), ("nowhere",), *list(states)[:: max(1, len(states) // 40)]]:
            assert sum(p(w, context) for w in words) + p("unseen word", context) == pytest.approx(1.0)

    def test_hashes_are_those_of_spark(self, spark):
        import numpy as np

        rows = [(-5, 7, 1 << 62), (0, 0, 0), (-(1 << 63), (1 << 63) - 1, 3)]
        got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long").select(F.xxhash64("a", "b", "c")).collect()]
        a, b, c = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        assert suffix_tree.hashed(c, suffix_tree.hashed(b, suffix_tree.hashed(a, 42))).tolist() == got

    def test_empty_tables_and_repeats(self, spark):
        df = docs(spark, ODD)
        none = df.where("false")
        assert suffix_tree.score(none, suffix_tree.fit(none)).count() == 0
        unlearnt = suffix_tree.score(df, suffix_tree.fit(none)).collect()
        assert len(unlearnt) == len(ODD)
        assert all(r.n_known == 0 and r.score == r.base_score for r in unlearnt)
        twice = df.union(df)
        rows = suffix_tree.score(twice, suffix_tree.fit(twice)).collect()
        assert len(rows) == 2 * len(ODD)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)))
        assert all(len(x) == 1 for x in by.values())
        null = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
        assert suffix_tree.score(null, suffix_tree.fit(null)).first().n_tokens == 3

    @pytest.mark.parametrize("n", [0, 1, 2, 3, 100_000])
    def test_a_task_copies_no_table(self, n):
        import tracemalloc

        import numpy as np

        keys = np.unique(np.random.default_rng(n).integers(-(1 << 63), (1 << 63) - 1, n))
        table, bits = suffix_tree.Table(keys, np.arange(len(keys))), np.zeros(8, np.uint8)
        sent = suffix_tree.Cache(table, True, table, table, bits, bits).packed()
        tracemalloc.start()
        opened = suffix_tree.Cache.opened(sent)
        assert tracemalloc.get_traced_memory()[1] < 50_000
        tracemalloc.stop()
        found, hit = opened.successors.find(np.concatenate((keys[::-1], [0])), -1)
        assert found.tolist() == [*range(len(keys))[::-1], -1] and hit.tolist() == [True] * len(keys) + [False]

    def test_counts_are_handed_on_in_small_batches_from_little_memory(self, monkeypatch):
        import tracemalloc

        import numpy as np

        monkeypatch.setattr(suffix_tree, "ROWS", 1 << 12)
        rng, n = np.random.default_rng(5), 1 << 17
        held = [[rng.integers(0, 300, n), rng.integers(-200, 200, n)] for _ in range(4)]
        want = Counter(zip(*(np.concatenate(x).tolist() for x in zip(*held, strict=True)), strict=True))
        got, size = {}, sum(x.nbytes for part in held for x in part)
        tracemalloc.start()
        for batch in suffix_tree.handed(held, ["a", "b", "none", "n"]):
            assert batch.num_rows <= 1 << 12
            got.update({(a, b): k for a, b, none, k in zip(*(x.to_pylist() for x in batch.columns), strict=True) if none == 0})
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == want and not held
        assert peak < 5 * size, peak / size

    def test_the_tree_grows_with_the_corpus(self, spark):
        # many words that each are a tiny share of the corpus, and each foretells the next
        grown = {}
        for n in (50, 1000):
            texts = [" ".join(f"a{i} b{i} c{i}" for _ in range(3)) for i in range(n) for _ in range(5)] + ["x y " * 300_000] * 2
            model = suffix_tree.fit(docs(spark, texts))
            grown[n] = model.words.count(), model.states[0].count(), model.successors[0].count()
        assert all(b > 15 * a for a, b in zip(grown[50], grown[1000], strict=True)), grown
