"""Candidates, identifiers and scores on small cases, and rules after pruning against plain programs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as fn
from weftline.operators import corrector, fuzzy, pipelines, quantiles, rules, vocabulary


def test_restricted_distance_is_brute_force(spark):
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 7))) for _ in range(260)})
    df = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string").withColumn("d", fn.restricted_distance("a", "b"))
    assert all((-1 if r.d is None else r.d) == fn.edit_distance(r.a, r.b, 2) for r in df.collect())


def test_common_prefix(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("x" * 1000 + "a", "x" * 1000 + "b"), ("éü", "éx"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(fn.common_prefix("a", "b"))
    assert [r[0] for r in df.collect()] == [0, 0, 2, 3, 1000, 1, 0]


def test_small_functions(spark):
    row = spark.createDataFrame([("Foo-bar, baz_Q!", "'x y'", "tokens", "class", "started", "s")], "p string, q string, a string, b string, c string, d string")
    found = row.select(fn.phrase_words("p"), fn.unwrapped("q"), *(fn.plain_form(c) for c in "abcd")).first()
    assert list(found) == [["foo", "bar", "baz", "q"], "x y", "token", "class", "starte", "s"]


def test_dictionary_thresholds(spark):
    words = spark.createDataFrame([("token", 3), ("token", 4), ("rare", 1), ("less", -5), ("less", 9)], "term string, count int")
    assert {r.term: r["count"] for r in fuzzy.build_dictionary(words, 2).collect()} == {"token": 7, "less": 9}
    index = fuzzy.deletes_index(spark.createDataFrame([("ab", 1), ("abcdef", 2)], "term string, count int"), 1, 3)
    assert {r["delete"] for r in index.where("term = 'abcdef'").collect()} == {"abc", "ab", "ac", "bc"}


def test_identifiers_are_fixed(spark):
    names = spark.createDataFrame([(0, "getTokem"), (1, "GET_VALEU_1"), (2, "put")], "id int, name string")
    found = spark.createDataFrame([("tokem", "token", 0.9), ("tokem", "tokem", 0.1), ("valeu", "value", 0.6), ("valeu", "valve", 0.3), ("valeu", "valeu", 0.2), ("put", "put", 1.0)], "token string, candidate string, proba double")
    rows = corrector.identifier_fixes(names, found).orderBy("id", "rank").collect()
    assert [(r.id, r.rank, r.fixed, round(r.confidence, 6)) for r in rows] == [(0, 1, "getToken", 1.0), (1, 1, "GET_VALUE_1", round(0.6 / 0.9, 6)), (1, 2, "GET_VALVE_1", round(0.3 / 0.9, 6))]
    truth = spark.createDataFrame([(0, "getTokem", "getToken"), (1, "GET_VALEU_1", "GET_VALVE_1"), (2, "put", "put"), (3, "sett", "set")], "id int, name string, correct string")
    s = corrector.identifier_scores(truth, corrector.identifier_fixes(names, found)).first()
    assert (s.tp, s.fp, s.fn, s.support) == (2, 0, 1, 3)
    assert (s.fix_accuracy, s.top_fix_accuracy) == (pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_suggestion_scores(spark):
    truth = spark.createDataFrame([(0, "get", "get"), (1, "tokem", "token"), (2, "valeu", "value"), (3, "put", "put")], "id int, token string, correct_token string")
    found = spark.createDataFrame([(0, 1, "gpt"), (1, 1, "token"), (2, 1, "valve"), (2, 2, "value")], "id int, rank int, candidate string")
    by = {r.mode: r for r in corrector.suggestion_scores(truth, found, 1).collect()}
    assert (by["detection"].tp, by["detection"].fp, by["detection"].fn, by["detection"].tn) == (2, 1, 0, 1)
    assert by["correction"].recall == 0.5
    assert {r.mode: r.recall for r in corrector.suggestion_scores(truth, found, 2).collect()}["on_typoed"] == 1.0


def test_candidates_from_every_source(spark):
    words = spark.createDataFrame([("get", 9), ("set", 5), ("token", 7), ("far", 3)], "token string, freq long")
    vectors = spark.createDataFrame([("get", [1.0, 0.0]), ("set", [0.0, 1.0]), ("token", [-1.0, 0.1]), ("far", [0.5, 0.5]), ("gett", [0.9, 0.1])], "token string, embedding array<float>")
    typos = spark.createDataFrame([(0, "gett", "get", "token", ""), (1, "zzzzzz", "far", "", "")], "id int, token string, correct_token string, before string, after string")
    found = corrector.candidate_set(typos, words, vectors, 2, 4, 1, 2)
    assert {(r.id, r.candidate, r.distance) for r in found.collect()} == {(0, "get", 1), (0, "set", 2), (0, "gett", 0), (1, "zzzzzz", 0)}
    rows = {(r.id, r.candidate): r for r in corrector.candidate_features(found, typos, words, vectors, 2).collect()}
    r = rows[0, "get"]
    assert (r.f_typo_freq, r.f_cand_freq, r.f_distance, r.f_known) == (0, 9, 1, 1)
    assert r.f_cand_before == pytest.approx(1 + 1 / 1.01**0.5)
    assert r.f_cand_before == pytest.approx(r.f_cand_before_avg) == pytest.approx(r.f_cand_before_min) == pytest.approx(r.f_cand_context)
    assert (r.f_cand_after, r.f_cand_after_avg, r.f_cand_after_min) == (1.0, 1.0, 1.0)
    assert rows[1, "zzzzzz"].f_known == 0
    assert corrector.labelled(found, typos).where("label = 1").count() == 1
    assert {(r.id, r.distance, r.candidate) for r in corrector.baseline(found, words).collect()} == {(0, 0, "gett"), (0, 1, "get"), (0, 2, "set"), (1, 0, "zzzzzz")}


def test_vectors_of_unknown_words(spark):
    vectors = spark.createDataFrame([("token", [1.0, 0.0]), ("tokens", [3.0, 2.0])], "token string, embedding array<float>")
    asked = spark.createDataFrame([("token",), ("tokem",), ("zz",)], "token string")
    found = {r.token: list(r.embedding) for r in pipelines.word_or_parts(asked, vectors).collect()}
    assert found == {"token": [1.0, 0.0], "tokem": [2.0, 1.0]}


def test_typo_pairs(spark):
    pairs = spark.createDataFrame([("getTokem", "getToken"), ("get_token", "getToken"), ("getTokens", "getToken"), ("a", "b_c"), ("abcd", "wxyz")], "wrong string, correct string")
    lemmas = spark.createDataFrame([("tokens", "token")], "token string, lemma string")
    assert {r.wrong for r in corrector.not_a_typo(pairs, lemmas).collect()} == {"getTokem", "a", "abcd"}
    found = {r.wrong: r.p for r in pairs.select("wrong", corrector.pair_problem("wrong", "correct").alias("p")).collect()}
    assert found["getTokem"] is None
    assert (found["a"], found["abcd"]) == ("different numbers of parts", "parts too far apart")
    unique, rows = corrector.repeated_positions(spark.createDataFrame([("ab",), ("ab",), ("x",)], "name string"), "name")
    assert (unique.count(), rows.count()) == (1, 2)


def test_vocabulary_of_forms(spark):
    freq = spark.createDataFrame([("token", 50), ("tokens", 5), ("tokem", 4), ("valus", 3), ("value", 40), ("zebra", 2)], "token string, freq long")
    english = spark.createDataFrame([("value",)], "token string")
    found = {r.token for r in pipelines.vocabulary_from(freq, english, 1, 0, 0).collect()}
    assert found == {"value", "token", "tokens", "zebra"}


def test_exactly_so_many_are_corrupted(spark):
    df = spark.range(1000).select(F.col("id").alias("rank"), F.concat(F.lit("ab"), F.col("id").cast("string"), F.lit("xy")).alias("token")).withColumn("token_split", F.concat("token", F.lit(" z "), "token"))
    out = vocabulary.corrupt_exactly(df, 0.25, "rank", split="token_split").collect()
    chosen = {r.rank for r in out if r.token != r.correct_token}
    order = sorted(range(1000), key=lambda k: ((k * 1103515245 + 12345) % 2**31, k))
    assert chosen <= set(order[:250])
    assert len(chosen) >= 240
    assert all(r.token_split == f"{r.token} z {r.token}" and r.correct_split == f"{r.correct_token} z {r.correct_token}" for r in out)


def test_ranks_of_all_tokens(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))): rnd.randrange(1, 4) for _ in range(150)}
    found = vocabulary.ranked(spark.createDataFrame(list(words.items()), "token string, freq long")).collect()
    assert {r.token: r["rank"] for r in found} == {w: k + 1 for k, w in enumerate(sorted(words, key=lambda w: (-words[w], w)))}


def test_quantiles_are_exact(spark):
    rnd = random.Random(4)
    rows = [("a", rnd.gauss(0, 1e6)) for _ in range(801)] + [("b", 5.0)] * 10 + [("b", None), ("c", 1e-300), ("c", 1e300)]
    found = {r.g: r for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q1": 0.25, "m": 0.5, "top": 1.0}).collect()}
    own = sorted(v for g, v in rows if g == "a")
    assert (found["a"].q1, found["a"].m, found["a"].top) == (own[200], own[400], own[800])
    assert (found["b"].q1, found["b"].m) == (5.0, 5.0)
    assert found["c"].top == 1e300


def test_pruned_tree(spark):
    """Reduced-error pruning against a plain program over the same tree."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rnd = random.Random(7)
    rows = [(rnd.random() * 10, rnd.random() * 10) for _ in range(900)]
    rows = [(a, b, float((a > 5) != (rnd.random() < 0.25))) for a, b in rows]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.createDataFrame(rows, "a double, b double, y double"))
    train, test = df.limit(600), spark.createDataFrame(rows[600:], "a double, b double, y double")
    model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=5, seed=1).fit(train)
    found = rules.pruned_tree_rules(model, ["a", "b"], test, "y", spark)

    def build(node):
        stats = list(node.impurityStats().stats())
        if node.numDescendants() == 0:
            return {"stats": stats}
        s = node.split()
        return {"stats": stats, "f": s.featureIndex(), "t": s.threshold(), "sides": [build(node.leftChild()), build(node.rightChild())]}

    def answer(node, x):
        while "sides" in node:
            node = node["sides"][x[node["f"]] > node["t"]]
        return max((0, 1), key=lambda c: (node["stats"][c], -c))

    tree = build(model._java_obj.rootNode())
    held = rows[600:]

    def prune(node):
        if "sides" not in node:
            return
        for side in node["sides"]:
            prune(side)
        if all("sides" not in s for s in node["sides"]):
            before = sum(answer(tree, r) == r[2] for r in held)
            sides = node.pop("sides")
            if sum(answer(tree, r) == r[2] for r in held) < before:
                node["sides"] = sides

    prune(tree)

    def leaves(node):
        return sum(map(leaves, node["sides"])) if "sides" in node else 1

    assert found.count() == leaves(tree) < model.numNodes
    predicted = rules.apply_rules(spark.createDataFrame([(k, *r) for k, r in enumerate(held)], "id int, a double, b double, y double"), found, ["id"], ["a", "b"])
    assert {r.id: float(r.prediction) for r in predicted.collect()} == {k: float(answer(tree, r)) for k, r in enumerate(held)}


def test_many_rules_are_joined(spark, monkeypatch):
    many = spark.createDataFrame([(k, [("x", True, float(k))], str(k % 3), 0.5 + k / 100, 1) for k in range(20)], rules.SCHEMA)
    df = spark.createDataFrame([(0, 4.5), (1, -1.0), (2, None)], "id int, x double")
    few = sorted(map(tuple, rules.apply_rules(df, many, ["id"], ["x"]).collect()))
    monkeypatch.setattr(rules, "WRITTEN", 3)
    assert sorted(map(tuple, rules.apply_rules(df, many, ["id"], ["x"]).collect())) == few == [(0, "1", 4), (1, None, None), (2, None, None)]


def test_settings_are_searched(spark):
    rnd = random.Random(3)
    rows = [(a := rnd.random() * 4, rnd.random(), int(a > 2)) for _ in range(240)]
    found = rules.search(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", 2, 2, ranges={"minInstancesPerNode": (2, 150), "maxDepth": (2,), "forest": (False,)})
    assert [s["minInstancesPerNode"] for s, _ in found] == [2, 150]
    assert found[0][1] > 0.9 > found[1][1]


def test_lists_of_suggestions(spark):
    lists = spark.createDataFrame([(1, "a", [("b", 0.9), ("c", 0.1)])], "id int, token string, suggestions array<struct<candidate:string,proba:double>>")
    flat = corrector.flat_suggestions(lists)
    assert [(r["rank"], r.candidate) for r in flat.collect()] == [(1, "b"), (2, "c")]
    assert corrector.listed_suggestions(flat).collect() == lists.collect()


def plain_score(tree: str, x: list[float]) -> float:
    """What a tree, as its debug string tells it, predicts for the numbers x."""
    lines = [line for line in tree.splitlines() if line.strip().startswith(("If", "Else", "Predict"))]
    at = 0
    while not lines[at].strip().startswith("Predict"):
        words = lines[at].strip().strip(")").split()
        depth, value = len(lines[at]) - len(lines[at].lstrip()), float(words[-1])
        if x[int(words[2])] <= value:
            at += 1
        else:
            at = next(k for k in range(at + 1, len(lines)) if lines[k].strip().startswith("Else") and len(lines[k]) - len(lines[k].lstrip()) == depth) + 1
    return float(lines[at].split()[-1])


def test_scores_of_a_trained_ranker_are_those_of_its_trees(spark):
    rows = [(k, f"w{k}", f"c{k}", float((k * 7 % 13 > 6) ^ (k % 5 == 0)), *(float((k * (j + 3)) % 17) for j in range(len(corrector.FEATURES)))) for k in range(120)]
    data = spark.createDataFrame(rows, ["id", "token", "candidate", "label", *(f"f_{name}" for name in corrector.FEATURES)])
    model = corrector.train_ranker(data, rounds=4, depth=3)
    found = {r.id: r.proba for r in corrector.with_probability(model, data).collect()}
    assert len({round(p, 9) for p in found.values()}) > 3
    for k, *_, in rows:
        x = list(rows[k][4:])
        margin = sum(weight * plain_score(tree.toDebugString, x) for weight, tree in zip(model.treeWeights, model.trees, strict=True))
        assert abs(found[k] - 1 / (1 + math.exp(-2 * margin))) < 1e-9


def test_candidates_of_all_words_are_those_of_brute_force(spark):
    """Nearest by vector and by edits, over more words than have a vector of their own."""
    words = [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijkl"]
    vector = {w: [float(k % 7), float(k * 5 % 11), 1.0] for k, w in enumerate(words)}
    vector |= {"aex": [1.0, 2.0, 3.0], "dhx": [0.0, 0.0, 0.0]}
    vocabulary = spark.createDataFrame([(w, 100 - k) for k, w in enumerate(words)], "token string, freq long")
    vectors = spark.createDataFrame(list(vector.items()), "token string, embedding array<float>")
    typos = spark.createDataFrame([(1, "aex", "aei", "bfj"), (2, "dhx", "", "chl"), (3, "nothing", "", "")], "id int, token string, before string, after string")
    found = {(r.id, r.candidate, r.distance) for r in corrector.candidate_set(typos, vocabulary, vectors, 2, 4, 3, 3).collect()}

    def far(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm else 1.0

    expected = set()
    for k, token, before, after in [(1, "aex", "aei", "bfj"), (2, "dhx", "", "chl"), (3, "nothing", "", "")]:
        distances = {w: fn.edit_distance(token, w, 2) for w in words}
        for d in (0, 1, 2):
            near = sorted((w for w in words if distances[w] == d), key=lambda w: (words.index(w), w))
            expected |= {(k, w, d) for w in near[:4]}
        context = [vector[w] for w in (before, after) if w]
        asked = [vector[w] for w in (token,) if w in vector] + ([[sum(x) for x in zip(*context, strict=True)]] if context else [])
        for v in asked:
            expected |= {(k, w, distances[w]) for w in sorted(words, key=lambda w: (far(v, vector[w]), w))[:3] if 0 <= distances[w] <= 2}
        expected.add((k, token, 0))
    assert found == expected


def test_names_whose_second_word_lost_its_only_letter(spark, tmp_path):
    import duckdb

    from tests.conftest import DATA
    from weftline import catalog

    text = " ".join(["thtish"] * 900 + ["c"] * 800 + ["ab"] * 700 + ["thtis"] * 600 + ["s"] * 500 + ["a"] * 400)
    spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("typo_fixes", "identifier_accuracy"):
        found = catalog.queries()[name](spark, str(tmp_path))
        want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, found.collect())) == sorted(want) and want
