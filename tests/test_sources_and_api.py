"""Readers and writers, settings, the classes, the command line and streams, on files made here."""

import io
import json
import lzma
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline import __main__ as cli
from weftline import api, config
from weftline.operators import pipelines
from weftline.sources import tables
from weftline.streaming import review, store


def test_xz_and_tar(spark, tmp_path):
    (tmp_path / "a.csv.xz").write_bytes(lzma.compress("id,name\n1,é\n2,\"x, y\"\n".encode()))
    assert [tuple(r) for r in tables.read_csv_xz(spark, str(tmp_path / "a.csv.xz"), "id int, name string").collect()] == [(1, "é"), (2, "x, y")]
    (tmp_path / "m.xz").write_bytes(lzma.compress(b"first\0second\nline\0") + lzma.compress(b"third"))
    assert [(r.at, r.value) for r in tables.read_messages(spark, str(tmp_path / "m.xz")).collect()] == [(0, "first"), (1, "second\nline"), (2, "third")]
    (tmp_path / "h.bin").write_bytes(bytes(range(40)))
    assert [(r.at, r.hash[:4]) for r in tables.read_hashes(spark, str(tmp_path / "h.bin")).collect()] == [(0, "0001"), (1, "1415")]
    with tarfile.open(tmp_path / "t.tar.xz", "w:xz") as archive:
        for name, text in (("a/x.js", "var a;"), ("b.txt", "y" * 100)):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    assert {(r.path, r.content) for r in tables.read_tar_xz(spark, str(tmp_path / "t.tar.xz"), 50).collect()} == {("a/x.js", "var a;")}


def test_lists_and_reports(spark, tmp_path):
    (tmp_path / "repos.csv").write_text("from,url,to\nabc,http://x,def\n")
    row = tables.read_by_header(spark, str(tmp_path / "repos.csv"), tables.REPOSITORIES).first()
    assert tuple(row) == ("http://x", "def", "abc", None)
    assert tables.named_lines("-", ["a\n", "\n", " b "]) == ["a", "b"]
    (tmp_path / "l").write_text("p\n\nq\n")
    assert tables.named_lines(str(tmp_path / "l")) == ["p", "q"]
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, x double")
    assert [r.line for r in tables.markdown(rows, ["name"]).orderBy("at").collect()] == ["| name | x |", "|---|---|", "| a | 1.0 |", "| b | 3.0 |"]
    tables.save_reports({"r": rows}, str(tmp_path), {"r": ["name"]})
    assert spark.read.text(str(tmp_path / "r")).count() == 4
    path = str(tmp_path / "report")
    assert tables.append_report(rows, path).count() == 2
    assert tables.append_report(rows, path).count() == 4
    d = tables.describe(rows, ["x"]).first()
    assert (d["column"], d["count"], d["mean"], d["min"], d["max"]) == ("x", 2, 2.0, 1.0, 3.0)
    assert tables.save_table(rows, str(tmp_path / "kept")).count() == 2
    loaded = []
    models = tables.Models(lambda s: loaded.append(s) or len(loaded))
    assert (models.get("a"), models.get("a"), models.get("b")) == (1, 1, 2)


def test_settings():
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6}
    assert config.merged({"a": 1}, None) == {"a": 1}
    assert config.by_language({"global": {"x": 1, "y": 2}, "js": {"y": 3}}, ["js", "py"]) == {"js": {"x": 1, "y": 3}, "py": {"x": 1, "y": 2}}
    with pytest.raises(ValueError, match="unknown setting feature_extractor.x"):
        config.checked(config.FORMAT, {"feature_extractor": {"x": 1}})
    with pytest.raises(ValueError, match="takes int"):
        config.checked(config.TYPOS, {"radius": "far"})


def test_annotations(spark):
    spans = spark.createDataFrame([("f", "token", 0, 3, "get"), ("f", "token", 3, 5, "x"), ("f", "label", 0, 3, "L"), ("g", "token", 0, 3, "y")], "id string, layer string, start int, stop int, value string")
    manager = api.AnnotationManager(spark).add(spans)
    assert (manager.count("token"), manager.get("token", 0, 3).count()) == (3, 2)
    assert [r.value for r in manager.iter_by_type("token", 1).collect()] == ["x"]
    assert {(r.value, r.label) for r in manager.iter_nested("token", "label").collect()} == {("get", "L"), ("x", None), ("y", None)}
    for bad in ([("f", "token", 2, 4, "z")], [("f", "other", 4, 2, "z")], [("f", "token", 0, 3, "again")]):
        with pytest.raises(ValueError, match="span"):
            manager.add(spark.createDataFrame(bad, spans.schema))


class Lengths(api.Reporter):
    def reviews(self, rows):
        return rows.select("id", F.length("text").alias("n"))

    def reports(self, found):
        return {"total": found.agg(F.sum("n").alias("n"), F.count("*").alias("rows"))}


def test_reporters(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "c")], "id int, text string")
    path = str(tmp_path / "reviews")
    assert tuple(Lengths().run(rows, path)["total"].first()) == (3, 2)
    more = spark.createDataFrame([(2, "changed"), (3, "d")], "id int, text string")
    assert tuple(Lengths().run(more, path)["total"].first()) == (4, 3)
    found = spark.createDataFrame([(1, 0, 0, "train"), (2, 1, 0, "test"), (3, 1, -1, "test")], "id int, truth int, prediction int, part string")
    reports = api.ClassReporter().run(found)
    assert set(reports) == {"all", "train", "test"}
    assert api.Reporter.assembled(reports).select("report").distinct().count() == 3


FILES = [("a.js", "if (a) {\n  b = 'x';\n}\n" * 12), ("b.js", "if (c) {\n  d = 'y';\n}\n" * 12)]


def test_style_rules_end_to_end(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    extractor = api.FeatureExtractor({"cutoff_label_support": 5, "select_features_number": 60}, reserved=("{", "}", "(", ")", "=", ";"))
    kept = extractor.index_labels(files)
    assert "<newline><+space><+space>" in extractor.labels
    encoded = extractor.encoded(extractor.extract_features(files))
    names = extractor.select_features(encoded)
    assert 0 < len(names) <= 60
    aliases = {n: f"f{k}" for k, n in enumerate(names)}
    samples = encoded.join(kept.select("y", "label_id"), "y").select("path", "idx", "y", "label_id", *(F.col(f"`{n}`").alias(a) for n, a in aliases.items()))
    trained = api.TrainableRules({"confidence_threshold": 0.5}, leaf=2).fit(samples, list(aliases.values()), "label_id", "path")
    score = trained.full_score(samples, ["path", "idx"], "label_id").first()
    assert score.full_score > 0.6
    table = trained.rules
    table.save(str(tmp_path / "rules"))
    assert api.Rules.load(spark, str(tmp_path / "rules")).table.count() == table.table.count()
    first = table.describe().first()
    assert table.find(first["hash"]).count() >= 1
    assert table.by_feature().count() > 0
    assert table.summary().first().rules == table.table.count()
    labels = {str(r.label_id): r.y for r in kept.collect()}

    class Aliased:
        def extract_features(self, f):
            return f

        def encoded(self, f):
            own = extractor.encoded(extractor.extract_features(f), {c.split("=")[0]: [c.split("=", 1)[1]] for c in names if "=" in c})
            return own.select("path", "idx", "y", *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(a) if n in own.columns else F.lit(0.0).alias(a) for n, a in aliases.items()))

    odd = spark.createDataFrame([("c.js", "if (a) {\n  b  = 'x';\n}\n")], "path string, content string")
    assert pipelines.review_style(odd, table.table, Aliased(), list(aliases.values()), labels).columns == ["path", "line", "old", "new", "confidence", "removed"]


def test_corrector_end_to_end(spark, tmp_path):
    words = ["get", "token", "value", "index", "count", "number", "buffer", "string", "result", "update"]
    vectors = spark.createDataFrame([(w, [float(k == j) for j in range(4)]) for k, w in enumerate(words)], "token string, embedding array<float>")
    known = spark.createDataFrame([(w, 100 + k) for k, w in enumerate(words)], "token string, freq long")
    wrong = [(k, w[:2] + w[3:] if k % 2 else w + w[-1], w, "get", "") for k, w in enumerate(words * 3)]
    typos = spark.createDataFrame(wrong + [(100 + k, w, w, "", "get") for k, w in enumerate(words)], "id int, token string, correct_token string, before string, after string")
    trained = api.TyposCorrector(spark, {"train_rounds": 3, "neighbors_number": 1}).initialize_generator(known, vectors).train(typos)
    scores = {r.mode: r for r in trained.evaluate(typos, 2).collect()}
    assert scores["on_typoed"].recall > 0.8
    trained.save(str(tmp_path / "c"))
    again = api.TyposCorrector.load(spark, str(tmp_path / "c"))
    assert again.settings == trained.settings
    assert again.suggest(typos).count() == trained.suggest_by_batches(typos).count() > 0
    assert again.expand_vocabulary(typos).vocabulary.where("freq = 0").count() > 0
    with pytest.raises(ValueError, match="train"):
        api.TyposCorrector(spark).initialize_generator(known, vectors).suggest(typos)
    base = spark.createDataFrame([("f", 1, "x = get", "get"), ("f", 2, "old", "valeu")], "path string, line int, text string, name string")
    head = base.union(spark.createDataFrame([("f", 3, "y = getTokem", "getTokem")], base.schema))
    found = pipelines.review_typos(base, head, spark.createDataFrame([("tokem", "token", 1.0)], "token string, candidate string, proba double")).collect()
    assert [(r.path, r.line, r.name, r.fixed) for r in found] == [("f", 3, "getTokem", "getToken")]


def test_data_from_identifiers(spark):
    splits = ["get token value", "set token index", "count value", "get index", ""] * 4
    rows = spark.createDataFrame([(k, s, 1 + k % 3) for k, s in enumerate(splits)], "id long, token_split string, freq long")
    english = spark.createDataFrame([("get",), ("value",)], "token string")
    freq, known, tokens = pipelines.prepare(rows, english, 10)
    assert freq.where("token = 'get'").first().freq == sum(1 + k % 3 for k, s in enumerate(splits) if "get" in s)
    assert known.count() == 6
    assert {"before", "after"} <= set(tokens.columns)
    train, test = pipelines.typo_data(tokens, 60, 0.5)
    assert train.count() + test.count() == 60
    assert not {r.correct_token for r in train.collect()} & {r.correct_token for r in test.collect()}


def test_command_line(spark, tmp_path, capsys):
    out = io.StringIO()
    assert cli.main(["queries"], spark, out) == 0
    assert "token_frequency" in out.getvalue().split()
    (tmp_path / "ids.csv").write_text("id,token_split,freq\n1,get token,3\n2,get value,2\n")
    cli.main(["frequencies", str(tmp_path / "ids.csv"), str(tmp_path / "freq")], spark)
    assert {r.token: r.freq for r in tables.read_frequencies(spark, str(tmp_path / "freq")).collect()} == {"get": 5, "token": 3, "value": 2}
    (tmp_path / "english.csv").write_text("get,1\n")
    cli.main(["vocabulary", str(tmp_path / "freq"), str(tmp_path / "english.csv"), str(tmp_path / "voc")], spark)
    assert spark.read.csv(str(tmp_path / "voc")).count() == 3
    (tmp_path / "src").mkdir()
    for name, text in FILES:
        (tmp_path / "src" / name).write_text(text)
    cli.main(["features", str(tmp_path / "src"), str(tmp_path / "features"), "--pattern", "*.js"], spark)
    assert spark.read.parquet(str(tmp_path / "features")).where("y = \"'\"").count() == 48
    for name, x in (("base", 1.0), ("new", 3.0)):
        spark.createDataFrame([("a", x)], "name string, f1 double").write.parquet(str(tmp_path / name))
    out = io.StringIO()
    cli.main(["compare", str(tmp_path / "base"), str(tmp_path / "new"), "--columns", "f1"], spark, out)
    assert json.loads(out.getvalue()) == {"name": "a", "f1": 2.0}


def test_late_rows_of_a_stream(spark, tmp_path):
    """Rows behind the watermark are left out; the first one of each key is kept."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    batches = [[(1, datetime(2024, 1, 1, 0), "a", 1.0), (2, datetime(2024, 1, 3, 0), "a", 1.0)], [(3, datetime(2024, 1, 5, 0), "b", 1.0)], [(4, datetime(2024, 1, 1, 1), "a", 1.0), (5, datetime(2024, 1, 5, 1), "b", 1.0)], [(6, datetime(2024, 1, 20), "a", 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    folder = str(tmp_path / "flat")
    stream = review.event_stream(spark, str(tmp_path / "in" / "*"), schema)
    closed = store.run_to_end(review.window_counts(stream, "1 day", late="1 hour"), folder, "append")
    assert {(r.start.day, r.event_type): r.events for r in closed.collect()}[1, "a"] == 1
    seen = store.run_to_end(review.first_sightings(review.event_stream(spark, str(tmp_path / "in" / "*"), schema), ["event_type"], late="60 days"), str(tmp_path / "seen"), "append")
    assert seen.count() == 2


def test_counters_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x int").write.parquet(str(tmp_path / "in"))
    taken = {}
    listener = review.followed(spark, lambda name, row: taken.update({name: row}))
    try:
        stream = review.counted(spark.readStream.schema("x int").parquet(str(tmp_path / "in")), "seen", rows=F.count("*"), total=F.sum("x"))
        store.run_to_end(stream, str(tmp_path / "out"), "append")
        for _ in range(50):
            if taken:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert taken["seen"] == {"rows": 2, "total": 3}


def test_languages(spark):
    api.register_language("js", ("=>",), ("if", "{"))
    assert dict(api.languages())["js"]["reserved"] == ("if", "{")
    nodes = spark.createDataFrame([("Identifier", ["EXPR"], "a"), (None, None, "=("), (None, None, "(")], "type string, roles array<string>, value string")
    assert {(r.kind, r.name): r.n for r in api.language_statistics(nodes).collect()} == {("type", "Identifier"): 1, ("role", "EXPR"): 1, ("sign", "="): 1, ("sign", "("): 2}
    del api.LANGUAGES["js"]


def test_counts_and_plans(spark):
    df = spark.range(3)
    assert api.checked_count(df, 3) is df
    assert api.checked_count(spark.range(2), 3, lambda: df) is df
    with pytest.raises(ValueError, match="3 rows"):
        api.checked_count(spark.range(2), 3)
    logged = []
    api.profiled(df, logged.append)
    assert "Physical Plan" in logged[0]
    assert json.loads(api.as_json(spark.createDataFrame([(1, "x")], "a int, b string"), ["a"]).first().json) == {"b": "x"}
