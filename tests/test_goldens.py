"""Operators on small cases with known results."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as fn
from weftline.operators import alignment, fixes, fuzzy, labels, metrics, rules, spans, vocabulary
from weftline.sources import tables
from weftline.streaming import review


def test_flatten_and_context(spark):
    df = spark.createDataFrame([(0, "get tokens num"), (1, "use class"), (2, "")], "id int, token_split string")
    flat = vocabulary.flatten(df, fn.split_words("token_split"))
    assert [r.token for r in flat.orderBy("id").collect()] == ["get", "tokens", "num", "use", "class"]
    found = vocabulary.with_context(flat).where("token = 'tokens'").first()
    assert (found.before, found.after) == ("get", "num")


def test_identifiers(spark):
    cases = {"FRAPScase": "frap scase", "getHTTPResponse": "get http response", "snake_case_1": "snake case", "": "", "__x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "name string").select("name", F.array_join(fn.split_identifier("name"), " ").alias("s"))
    assert {r.name: r.s for r in df.collect()} == cases
    row = spark.createDataFrame([("getHTTP_tokem", ["get", "http", "tokem"], ["put", "ftp", "token"])], "n string, a array<string>, b array<string>")
    assert row.select(fn.rebuild_identifier("n", "a", "b")).first()[0] == "putFTP_token"


def test_known_splits(spark):
    df = spark.createDataFrame([(0, "get value"), (1, "put"), (2, "get x"), (3, "")], "id int, s string")
    known = spark.createDataFrame([("get",), ("value",), ("put",)], "token string")
    assert sorted(r.id for r in vocabulary.known_splits(df, known, "id", fn.split_words("s")).collect()) == [0, 1, 3]


def test_edit_distance():
    assert fn.edit_distance("token", "tokem", 1) == 1
    assert fn.edit_distance("token", "tokems", 1) == -1
    assert fn.edit_distance("token", "tokems", 2) == 2
    assert fn.edit_distance("ca", "abc", 3) == 3  # a swapped pair isn't edited again
    assert fn.edit_distance("ab", "ba", 1) == 1
    assert fn.edit_distance("", "", 0) == 0


def test_fuzzy_join_is_brute_force(spark):
    words = sorted({"".join(w) for n in (1, 2, 3, 4) for w in itertools.islice(itertools.product("abc", repeat=n), 0, None, n)})[:60]
    df = spark.createDataFrame([(w, len(w)) for w in words], "term string, count int")
    for k in (1, 2):
        found = fuzzy.fuzzy_join(df.select(F.col("term").alias("query")), df, k).collect()
        assert {(r.query, r.term): r.distance for r in found} == {(a, b): d for a in words for b in words if (d := fn.edit_distance(a, b, k)) >= 0}


def test_compound(spark):
    words = spark.createDataFrame([("token", 9), ("get", 5), ("value", 7), ("tok", 1)], "term string, count int")
    phrases = spark.createDataFrame([("gettoken valu",), ("get value",), ("qqq",)], "phrase string")
    assert {r.phrase: r.corrected for r in fuzzy.compound(phrases, words).collect()} == {"gettoken valu": "get token value", "get value": "get value", "qqq": "qqq"}


def test_ranking(spark):
    rows = [(0, "get", "get", 1.0), (0, "get", "gpt", 0.9), (1, "tokem", "token", 0.9), (1, "tokem", "taken", 0.3), (1, "tokem", "tokem", 0.05), (1, "tokem", "x", 0.01)]
    df = spark.createDataFrame(rows, "id int, token string, candidate string, proba double")
    assert [(r.id, r.candidate, r.proba) for r in fuzzy.rank_candidates(df, 2).orderBy("id", "rank").collect()] == [(0, "get", 1.0), (1, "token", 0.9), (1, "taken", 0.3)]
    assert {r.id for r in fuzzy.rank_candidates(df, 2, return_all=False).collect()} == {1}
    ranked = df.withColumn("rank", F.expr("row_number() over (partition by id order by proba desc)"))
    assert [(r.id, r.candidate) for r in fuzzy.take_confident(ranked, 0.2).orderBy("id", "rank").collect()] == [(0, "get"), (1, "token"), (1, "taken")]


def test_combinations(spark):
    parts = spark.createDataFrame([(0, 0, "a", 0.9), (0, 0, "b", 0.2), (0, 1, "c", 0.5), (0, 1, "d", 0.6), (0, 2, "e", 1.0)], "id int, place int, candidate string, proba double")
    assert [(r.text, round(r.proba, 3)) for r in fuzzy.combinations(parts, 3).orderBy(F.desc("proba")).collect()] == [("a d e", 0.54), ("a c e", 0.45), ("b d e", 0.12)]


def test_scores(spark):
    df = spark.createDataFrame([(True, True), (True, True), (False, True), (False, False)], "t boolean, p boolean")
    got = metrics.scores(df, F.col("t"), F.col("p")).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.75, pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert tuple(metrics.scores(df.where("not t and not p"), F.col("t"), F.col("p")).first()) == (1.0, 0.0, 0.0, 0.0)


def test_aligned():
    assert alignment.counts("a = b", "a=b", "a = b") == (0, 0, 0, 2)
    assert alignment.counts("a = b", "a=b", "a=b") == (0, 2, 0, 0)
    assert alignment.counts("ab", "ab", "a b") == (1, 0, 0, 0)


def test_spans(spark):
    def layer(*rows):
        return spark.createDataFrame([("f", a, b) for a, b in rows], "path string, start long, stop long")

    a, b = layer((0, 3), (5, 5), (300, 620)), layer((0, 5), (2, 4), (5, 5), (4, 6), (600, 700))
    over = {(r.a_start, r.a_stop, r.b_start, r.b_stop) for r in spans.overlap_join(a, b, "path").collect()}
    assert over == {(0, 3, 0, 5), (0, 3, 2, 4), (5, 5, 5, 5), (5, 5, 4, 6), (300, 620, 600, 700)}
    assert {(r.a_start, r.b_start, r.b_stop) for r in spans.cover_join(a, b, "path").collect()} == {(0, 0, 5), (5, 0, 5), (5, 5, 5), (5, 4, 6)}
    assert spans.conflicts(layer((0, 3), (3, 5)), "path").count() == 0
    assert spans.conflicts(layer((0, 4), (3, 5)), "path").count() == 1
    assert spans.bad_spans(layer((0, 4), (5, 3), (-1, 2))).count() == 2


def test_lexer_round_trip_and_fixes(spark):
    df = spark.createDataFrame([(0, 'x = "a"\n  y\n\nz'), (1, "q")], "id int, text string")
    t = labels.lex(df, "id")
    assert {r.id: r.text for r in fixes.text_of(t, "id").collect()} == {0: 'x = "a"\n  y\n\nz', 1: "q"}
    assert [(r.line, r.col) for r in t.where("value = 'y' or value = 'z'").orderBy("idx").collect()] == [(2, 3), (4, 1)]
    guess = t.where("value = '\"'").select("id", "idx", F.lit("'").alias("predicted"), F.lit(0.9).alias("conf"))
    fixed = fixes.line_fixes(fixes.with_labels(t, guess, ["id", "idx"]), "id").collect()
    assert [(r.old, r.new, r.confidence) for r in fixed] == [('x = "a"\n', "x = 'a'\n", 90)]
    assert fixes.comments(spark.createDataFrame(fixed), "id").first().text == "line 1: x = \"a\" -> x = 'a'"


def test_rules_cover_their_tree(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("y", F.when((F.col("a") > 9) & (F.col("b") <= 3), 1.0).otherwise(0.0))
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=3).fit(x)
    found = rules.apply_rules(rows, rules.tree_rules(model, ["a", "b"], spark), ["id"], ["a", "b"])
    both = found.join(model.transform(x).select("id", F.col("prediction").alias("p")), "id").collect()
    assert len(both) == 400
    assert all(float(r.prediction) == r.p for r in both)


def test_sampling(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 3)], "token string, freq int")
    drawn = vocabulary.weighted_sample(df, 400)
    counts = {r.token: r["count"] for r in drawn.groupBy("token").count().collect()}
    assert sum(counts.values()) == 400
    assert "b" not in counts
    assert 0.6 < counts["c"] / 400 < 0.9
    rows = spark.createDataFrame([(f"word{k}", k) for k in range(40)], "token string, rank int")
    assert vocabulary.corrupt_exactly(rows, 0.5, "rank").where("token <> correct_token or correct_token is null").count() >= 15


def test_size_budget(spark):
    files = spark.createDataFrame([(k, "x" * 10) for k in range(3000)] + [(5000, "y" * 900)], "id long, text string")
    kept = vocabulary.size_budget(files, 500, 20_000, "id")
    assert kept.count() == 2000
    assert kept.agg(F.max("running")).first()[0] == 20_000


def test_sources(spark, tmp_path):
    path = str(tmp_path / "f")
    tables.write_frequencies(spark.createDataFrame([("null", 3), ("nan", 9), ("", 1)], "token string, freq long"), path)
    assert {r.token: r.freq for r in tables.read_frequencies(spark, path).collect()} == {"null": 3, "nan": 9, "": 1}
    assert tables.read_vocabulary(spark, path).count() == 3
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.js").write_text("let a\nb")
    assert tables.read_files(spark, str(tmp_path / "a"), "*.js").first().content == "let a\nb"
    given = spark.createDataFrame([(0, [("f", True, 1.0)], "N", 0.9, 3)], "rule_id int, attrs array<struct<feature:string,cmp:boolean,threshold:double>>, cls string, conf double, support long")
    tables.save_rules(given, str(tmp_path / "r"))
    assert tables.load_rules(spark, str(tmp_path / "r")).collect() == given.collect()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) + 0.0 for r in df.select(fn.cosine_distance("a", "b")).collect()] == [1.0, 1.0, 0.0]
    assert df.select(fn.log_ratio(F.lit(2.0), F.lit(1.0))).first()[0] == pytest.approx(-math.log(2), abs=1e-4)


def test_review_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    spark.range(10).repartition(2).write.parquet(str(source))
    stream = review.event_stream(spark, str(source), "id long")
    review.review(stream, str(tmp_path / "check"), lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 10


def test_aligned_where_restyled_lines_look_like_others():
    def restyled(text):
        half = len(text) // 2
        return text, text.replace(", ", ","), text[:half] + text[half:].replace(", ", ",")

    for text in (", ,,", ", ,, ,", "1, 1,1, 1", "x, y\nx,y\nx, y\nx,y\n", "x, " * 1600):
        n, later = text.count(", "), text[len(text) // 2 :].count(", ")
        assert alignment.counts(*restyled(text)) == (0, later, 0, n - later)
