"""Operators over whole tables: links, components, mixing and the pipeline, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bytewright.llm import embedding_dedup, minhash, mixing, simhash
from bytewright.llm.common import connected_components, forest, materialize
from tests.llm.test_text_operators import DOCS, ODD, docs


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


class TestComponents:
    @pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
    def test_against_union_find(self, spark, kind):
        draw = random.Random(3)
        edges = {"path": [(i, i + 1) for i in range(60)], "star": [(100, i) for i in range(60)], "random": [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(70)], "none": []}[kind]
        df = spark.createDataFrame([*edges, *edges[:3], (7, 7), (None, 1), (2, None)], "a long, b long")
        nodes = {x for e in edges for x in e if e[0] != e[1]}
        got = {r.node: r.root for r in connected_components(df).collect()}
        assert got == components(nodes, [e for e in edges])

    def test_forest(self):
        draw = random.Random(1)
        for _ in range(30):
            n = draw.randint(1, 40)
            edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randint(0, n))]
            i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            assert forest(n, i, j).tolist() == list(components(range(n), edges).values())


class TestSimHash:
    def test_fingerprints(self):
        for text in ["", "a", "a b", "A b c", "a b c d e f g a b c", "é ñ x y", "word " * 3000, " \t\n\x0b\x0c\r"]:
            assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text), text
        assert simhash.fingerprint(None) == 0
        assert simhash.fingerprint(b"A B C D") == simhash.fingerprint(b"a  b\tc d")

    def test_components_against_all_pairs(self, spark):
        draw = random.Random(7)
        base = [" ".join(draw.choice("abcdefghijklmnop") * 3 for _ in range(300)) for _ in range(6)]
        texts = [None, "", " \n", *base, *base[:3], *[t.replace("aaa bbb", "aaa ccc", 1) for t in base], *[t + " end" for t in base]]
        fp = [brute_fingerprint(t) for t in texts]
        edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
        wanted = components(range(len(texts)), edges)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs(spark, texts)).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id").collect()}
        assert got == {i: (f"{fp[i]:016x}", wanted[i]) for i in range(len(texts))}

    @pytest.mark.parametrize(("distance", "bucket"), [(2, 1000), (2, 3), (6, 1000), (6, 3)])
    def test_links_lose_nothing(self, spark, distance, bucket):
        draw = random.Random(distance)
        centres = [draw.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
        values = {c ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 5))) & (1 << 64) - 1 for c in centres for _ in range(40)}
        signed = {simhash.signed(v & (1 << 64) - 1) for v in values}
        fps = spark.createDataFrame([(v,) for v in signed], "fp long")
        edges = [(a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
        found = [(r.a, r.b) for r in simhash.links(fps, distance, bucket=bucket).collect()]
        if distance == 2 or bucket == 1000:  # else edges are of a forest and may join what chains of links join
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in found)
        assert components(sorted(signed), found) == components(sorted(signed), edges)

    def test_parts_of_a_crowded_bucket(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "PART", 16)
        signed = {simhash.signed((0xABC << 40) + (1 << i) + (1 << j)) for i in range(12) for j in range(12)}
        fps = spark.createDataFrame([(v,) for v in signed], "fp long")
        found = [(r.a, r.b) for r in simhash.links(fps, 4, bucket=5).collect()]
        assert len(set(components(sorted(signed), found).values())) == 1

    def test_blocks_follow_the_number_of_fingerprints(self):
        assert simhash.blocks_for(1000, 2) == 4
        assert simhash.blocks_for(10**11, 6) > simhash.blocks_for(10**5, 6)
        with pytest.raises(ValueError, match="blocks"):
            simhash.links(None, 4, blocks=4)

    def test_one_of_each_group_stays(self, spark):
        df = docs(spark, ["x y z", "x y z", "other words here", None, "", "X Y Z"], {"fp": F.lit(1), "component_id": F.lit("c")})
        kept = simhash.keep_one(df.union(df), width=2, distance=6)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
        assert simhash.keep_one(df.where("false")).count() == 0
        nulls = spark.createDataFrame([(None, "x y z", "en", "s", 5), (4, "x y z", "en", "s", 5)], DOCS)
        assert [r.component_id for r in simhash.components(nulls).collect()] == [4, 4]


class TestNearDuplicates:
    @pytest.mark.parametrize("part", [1024, 8])
    def test_against_exact_similarities(self, spark, monkeypatch, part):
        monkeypatch.setattr(minhash, "PART", part)
        draw = random.Random(3)
        base = [[f"w{draw.randrange(3000)}" for _ in range(draw.randint(12, 150))] for _ in range(12)]
        texts = [None, "", "one two", "One  two", *map(" ".join, base)]
        for words in base:
            for k in range(12):
                own = list(words)
                for _ in range(k // 2):
                    own[draw.randrange(len(own))] = f"x{draw.randrange(3000)}"
                texts.append(" ".join(own))

        def grams(text):
            words = (text or "").lower().split()
            return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

        sets = [grams(t) for t in texts]
        edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        wanted = components(range(len(texts)), edges)
        kept = {r.doc_id for r in minhash.keep_one(docs(spark, texts)).collect()}
        assert kept == {i for i, c in wanted.items() if i == c}
        stage = corpus_pipeline.near_duplicates(spark, docs(spark, texts), "")
        assert {r.doc_id for r in stage.collect()} == kept

    @pytest.mark.parametrize("crowd", [32, 3])
    def test_the_stage_takes_simhash_blocks(self, spark, monkeypatch, crowd):
        def no_bands(own):
            raise AssertionError("proposed by minhashes")

        monkeypatch.setattr(minhash, "bands", no_bands)
        monkeypatch.setattr(simhash, "CROWD", crowd)
        draw = random.Random(9)
        texts = []
        for i in range(40):  # 45 shingles, of which the copy has 40 and none or 4 of its own: at and just below 0.8
            words = [f"w{draw.randrange(10**6)}" for _ in range(49)]
            texts += [" ".join(words), " ".join(words[: 44 - i % 2] + [f"x{draw.randrange(10**6)}" for _ in range(5)])]
        words = [f"c{j}" for j in range(104)]
        texts += [" ".join(words + [f"y{i}"]) for i in range(60)]  # a crowd
        sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
        edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        assert len(edges) == 20 + 60 * 59 // 2
        wanted = components(range(len(texts)), edges)
        kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").collect()}
        assert kept == {i for i, c in wanted.items() if i == c}

    @pytest.mark.parametrize("most", [1024, 50])
    def test_texts_travel_once_and_not_with_each_pair(self, spark, monkeypatch, most):
        monkeypatch.setattr(simhash, "PAIRS", most, raising=False)
        draw = random.Random(4)
        texts = []
        for _ in range(10):
            words = [f"w{draw.randrange(10**9)}" for _ in range(300)]
            texts += [" ".join(words + [f"y{i}"]) for i in range(30)]  # no crowd: 435 pairs

        def written():
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
            return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

        df = materialize(docs(spark, texts), "docs")
        before, joined = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
        assert kept == list(range(0, 300, 30))
        moved = (written() - before) / sum(map(len, texts))
        print("shuffled times the texts:", moved)
        if most == 1024:
            assert moved < 2.5

    def test_wide_fingerprints_against_brute_force(self):
        rng = np.random.default_rng(2)
        for n in (1, 4, 255, 256, 700):
            own = rng.integers(0, 1 << 64, n, np.uint64)
            single = np.array([np.unpackbits(np.frombuffer(simhash.wide(own[i : i + 1], 3), np.uint8)) for i in range(n)], int)
            want = 2 * single.sum(axis=0) > n
            assert (np.unpackbits(np.frombuffer(simhash.wide(own, 3), np.uint8)) == want).all()
        assert simhash.wide(own[:0], 3) == b""

    def test_rows_that_repeat_an_id(self, spark):
        texts = ["a b c d e f g", "h i j k l m n", "a b c d e f g"]
        df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 2, 7).otherwise(9).cast("long"))
        assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [(7, texts[0]), (7, texts[1])]


class TestEmbeddings:
    def brute(self, rows, threshold):
        ok = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
        edges = [(a[0], b[0]) for a, b in combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= threshold]
        root = components([r[0] for r in rows], edges)
        return {i: (sum(i in e for e in edges), root[i], root[i] == i) for i, _, _ in rows}

    def rows(self):
        draw = np.random.default_rng(4)
        centres = draw.normal(size=(6, 12))
        rows = [(i, (centres[i % 6] + draw.normal(size=12) * [0.1, 0.2, 0.4][i % 3]).tolist(), i % 2) for i in range(150)]
        rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(210, rows[0][1], None), (211, None, 0), (212, [0.0] * 12, 0), (213, [float("nan")] * 12, 0), (214, [1.0, None] * 6, 0), (215, [float("inf")] * 12, 0), (216, [1.0], 0), (217, [2.0], 0), (218, [], 0), (219, [1e200] * 12, 1), (220, [3e-200] * 12, 1)]
        return rows

    @pytest.mark.parametrize("block", [2048, 16])
    def test_against_all_pairs(self, spark, block):
        rows = self.rows()
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(3))
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.93, block).collect()}
        wanted = self.brute([r for r in rows if r[0] < 219], 0.93)
        assert {i: g for i, g in got.items() if i < 219} == wanted
        assert got[219] == (1, 219, True)
        assert got[220] == (1, 219, False)

    def test_empty_tables_and_repeats(self, spark):
        df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
        assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
        assert [(r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()] == [(2, 1)] * 3

    @pytest.mark.parametrize("numbers", [0, 4 << 20])
    def test_labels_of_any_kind_and_large_dimensions(self, spark, monkeypatch, numbers):
        monkeypatch.setattr(embedding_dedup, "BASIS_NUMBERS", numbers)
        draw = np.random.default_rng(2)
        base = draw.normal(size=(3, 3072 if not numbers else 7))
        rows = [(i, (base[i % 3] + 0.05 * draw.normal(size=base.shape[1])).tolist(), ["a b", "a", "1 2"][i % 2]) for i in range(24)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
        assert got == self.brute(rows, 0.93)
        halves = spark.createDataFrame([(1, [1.0, 2.0], 1.2), (2, [1.0, 2.0], 1.7), (3, [1.0, 2.0], 1.2), (4, [1.0, 2.0], 0.0), (5, [1.0, 2.0], -0.0)], "vec_id long, embedding array<double>, label double")
        assert sorted((r.vec_id, r.component_id) for r in embedding_dedup.near_duplicates(halves).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]

    def test_tiles_against_all_products(self):
        draw = np.random.default_rng(1)
        a, b = (draw.normal(size=(700, 5)) for _ in range(2))
        axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
        i, j = embedding_dedup.linked_pairs(a, b, axes, 0.93, False)
        exact = embedding_dedup.units(a) @ embedding_dedup.units(b).T >= 0.93
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact)), strict=True))


class TestMixing:
    DIMS = {"source": None, "lang": None, "topic": mixing.topic}
    TARGETS = {"source": mixing.Target(temper=0.5), "lang": mixing.Target({"en": 0.5, "de": 0.3}), "topic": mixing.Target()}

    def corpus(self, spark):
        draw = random.Random(2)
        rows = [(i, " ".join(["w"] * draw.randint(1, 60)) + draw.choice(["", " | x", "!! a"]), draw.choice(["en", "en", "de", "fr", None]), f"s{int(draw.random() ** 2 * 5)}", 1) for i in range(900)]
        return spark.createDataFrame(rows, DOCS)

    def test_marginals_and_share(self, spark):
        rows = mixing.mix(self.corpus(spark), self.DIMS, self.TARGETS, share=0.05).collect()
        assert all(r.mix_probability == r.mix_weight <= 1 for r in rows)
        mass, total = sum(r.mix_tokens * r.mix_weight for r in rows), sum(r.mix_tokens for r in rows)
        assert mass == pytest.approx(0.05 * total)
        of = lambda name, value: sum(r.mix_tokens * r.mix_weight for r in rows if r[name] == value) / mass
        assert of("lang", "en") == pytest.approx(0.5, abs=1e-6)
        assert of("lang", "de") == pytest.approx(0.3, abs=1e-6)
        roots = {s: sum(r.mix_tokens for r in rows if r.source == s) ** 0.5 for s in {r.source for r in rows}}
        for s, m in roots.items():
            assert of("source", s) == pytest.approx(m / sum(roots.values()), abs=1e-6)
        kept = sum(r.mix_tokens for r in rows if r.mix_kept)
        assert 0.02 * total < kept < 0.1 * total

    def test_distributed_cells_give_the_same(self, spark, monkeypatch):
        df = self.corpus(spark)
        local = {r.doc_id: (r.mix_weight, r.mix_kept) for r in mixing.mix(df, self.DIMS, self.TARGETS, share=0.3).collect()}
        monkeypatch.setattr(mixing, "LOCAL_CELLS", 3)
        spread = {r.doc_id: (r.mix_weight, r.mix_kept) for r in mixing.mix(df, self.DIMS, self.TARGETS, share=0.3).collect()}
        assert local.keys() == spread.keys()
        assert all(local[i][0] == pytest.approx(spread[i][0], rel=1e-6) for i in local)
        assert [local[i][1] for i in local] == [spread[i][1] for i in local]

    def test_probabilities_have_the_marginals(self, spark):
        # shares that weights beyond 1 would be needed for, were probabilities only cut
        draw = random.Random(6)
        rows = [(i, " ".join(["w"] * draw.randint(1, 60)) + draw.choice(["", "", "", " | x"]), draw.choice(["en"] * 8 + ["de"]), f"s{i % 3}", 1) for i in range(900)]
        targets = {"lang": mixing.Target({"en": 0.8, "de": 0.2}), "topic": mixing.Target({"prose": 0.6, "table": 0.4})}
        found = mixing.mix(spark.createDataFrame(rows, DOCS), {"lang": None, "topic": mixing.topic}, targets, share=0.5)
        got = {(r.dimension, r.value): r for r in mixing.marginals(found, targets).collect()}
        total = sum(r.tokens for (d, _), r in got.items() if d == "lang")
        assert found.where("mix_weight > 1").count() > 0
        for d, target in targets.items():
            masses = {v: r.tokens for (x, v), r in got.items() if x == d}
            wanted = mixing.reachable(target.of(masses), masses, 0.5 * total)
            assert sum(wanted.values()) == pytest.approx(0.5 * total)
            for v, tokens in wanted.items():
                assert got[d, v].expected == pytest.approx(tokens, abs=1e-6 * total)

    def test_raking_against_brute_force(self):
        # two by two cells: the scale is a product of row and column factors, cut at the bound
        draw = random.Random(3)
        for _ in range(20):
            mass = np.array([draw.uniform(1, 9) for _ in range(4)])
            truth = np.outer([draw.uniform(0.1, 1.2), draw.uniform(0.1, 1.2)], [1, draw.uniform(0.1, 1.2)]).ravel()
            p = np.minimum(1, truth)
            values = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
            wanted = [np.bincount(v, mass * p) for v in values]
            got = mixing.rake(values, mass, wanted, 20_000, 1e-12, 1.0)
            for v, w in zip(values, wanted, strict=True):
                assert np.bincount(v, mass * got) == pytest.approx(w, rel=1e-6)
            assert got == pytest.approx(p, rel=1e-3)

    def test_what_can_be_reached(self):
        assert mixing.reachable({"a": 0.5, "b": 0.5}, {"a": 10, "b": 90}, 50) == {"a": 10, "b": 40}
        assert mixing.reachable({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 50) == {"a": 10, "b": 20}
        assert mixing.reachable({"a": 1.0, "b": 0.0}, {"a": 10, "b": 20}, 5) == {"a": 5, "b": 0}

    def test_odd_texts_and_empty_tables(self, spark):
        df = docs(spark, ODD, {"cell_weight": F.lit(1)})
        rows = mixing.mix(df, self.DIMS, self.TARGETS).collect()
        assert len(rows) == len(ODD)
        assert [r.mix_tokens for r in rows if not (r.text or "").strip()] == [0, 0, 0]
        assert mixing.mix(df.where("false"), self.DIMS, self.TARGETS).count() == 0
        again = {r.doc_id: r.mix_kept for r in mixing.mix(df.repartition(5), self.DIMS, self.TARGETS).collect()}
        assert again == {r.doc_id: r.mix_kept for r in rows}


    def test_unnamed_and_null_languages_have_a_share(self, spark):
        df = docs(spark, [f"some words {i}" for i in range(60)])
        df = df.withColumn("lang", F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es", "it", None])), (F.col("doc_id") % 6 + 1).cast("int")))
        rows = mixing.mix(df, mixing.DIMENSIONS, mixing.TARGETS, mixing.SHARE).collect()
        mass = {}
        for r in rows:
            mass[r.lang] = mass.get(r.lang, 0) + r.mix_tokens * r.mix_weight
        assert all(r.mix_probability > 0 for r in rows)
        assert (mass["it"] + mass[None]) / sum(mass.values()) == pytest.approx(0.04, abs=1e-3)
        assert mixing.TARGETS["lang"].of({"en": 1, "de": 1, "fr": 1, "es": 1}) == pytest.approx({"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})


class TestPipeline:
    def tables(self, spark, folder, more=()):
        draw = random.Random(12)
        prose = lambda k: " ".join("".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3))) for _ in range(k)) + "."
        texts = [prose(80) for _ in range(60)]
        exam = prose(40)
        plan = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(10)] + [(120, prose(20) + " " + exam + " " + prose(20)), (121, "write to a.b@c.example.com " + prose(60))]
        plan += [(130 + i, prose(30) + f" you {draw.choice(['dolt', 'oaf', 'twit'])} " + prose(20) + " what an oaf and dolt " + prose(5)) for i in range(30)] + list(more)
        spark.createDataFrame([(i, t, ["en", "de", "fr", "es"][i % 4], f"src{i % 3}", None if t is None else len(t)) for i, t in plan], DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, int(130 <= i < 160)) for i, _ in plan], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return dict(plan)

    def test_stages(self, spark, tmp_path):
        texts = self.tables(spark, tmp_path, [(170, None), (171, "")])
        folder, kept = str(tmp_path), {}
        current = spark.read.parquet(f"{folder}/documents.parquet")
        columns = current.columns
        for name, stage in corpus_pipeline.STAGES:
            current = materialize(stage(spark, current, folder), name)
            kept[name] = {r.doc_id: r.text for r in current.collect()}
            assert name == "mixing" or current.columns == columns
        assert set(texts) - set(kept["toxicity"]) == set(range(130, 160))
        gone = set(kept["toxicity"]) - set(kept["near_duplicates"])
        assert gone == {*range(100, 110), 171}  # the empty text is a copy of the null one
        assert set(kept["near_duplicates"]) - set(kept["contamination"]) == {120}
        assert kept["personal_data"].keys() == kept["contamination"].keys()
        assert kept["personal_data"][121].startswith("write to <email> ")
        assert all(t == texts[i] for i, t in kept["personal_data"].items() if i != 121)
        assert 0 < len(kept["mixing"]) < len(kept["personal_data"])
        whole = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert whole == set(kept["mixing"])

    def test_empty_tables(self, spark, tmp_path):
        self.tables(spark, tmp_path)
        empty = tmp_path / "empty"
        for name in ("documents", "labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
        assert corpus_pipeline.run(spark, str(empty)).count() == 0
        assert corpus_pipeline.ORACLE_SQL is None
