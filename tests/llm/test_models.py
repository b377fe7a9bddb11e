"""Models on held-out rows, and the pipeline against its stages' plain forms."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.fixtures import documents, empty, rows, words
from tests.llm.test_tokens_and_repeats import shingle_set
from weftline.llm import langid, lm_mixing, queries, toxicity


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def test_language(spark):
    found = {r.doc_id: r for r in queries.op6_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    held = [d for d in docs if crc(d.doc_id, 5) == 0]
    assert all(found[d.doc_id].held_out == (crc(d.doc_id, 5) == 0) for d in docs)
    assert sum(found[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_awkward_rows(spark):
    df = documents(spark)
    found = langid.identify(df).collect()
    assert len(found) == len(rows())
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {0: "und", 1: "und", 2: "und"}
    assert {r.lang_pred for r in found} <= {"und", "en", "de"}
    assert langid.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_slots_are_counted_one_by_one():
    texts = ["Aé b", "", "123 .", "zz"]
    got = list(langid.slot_counts(texts))
    assert [g is None for g in got] == [False, True, True, False]
    assert [int(g[1].sum()) for g in got if g] == [4 + 3 + 2, 2 + 1]
    alone = next(langid.slot_counts(["zz"]))
    assert alone[0].tolist() == got[3][0].tolist()


def test_temperature():
    rnd = np.random.default_rng(2)
    labels = rnd.integers(0, 3, 3000)
    logits = rnd.normal(size=(3000, 3))
    logits[np.arange(3000), labels] += 1.5
    assert langid._temperature(logits * 4, labels) == pytest.approx(4 * langid._temperature(logits, labels), rel=1e-3)


def test_scores_of_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in lm_mixing.score_texts(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(t for i, text in texts.items() if crc(i, 10) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in texts.items():
        r, own = found[i], tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[t] > 0 for t in own), n, crc(i, 10) == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        assert r.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_awkward_rows(spark):
    found = lm_mixing.score_texts(documents(spark)).collect()
    assert len(found) == len(rows())
    assert all(r.n_tokens == 1 for r in found if r.doc_id in (0, 1, 2))
    assert all(math.isfinite(r.score) for r in found)
    assert len({(r.doc_id, round(r.score, 6)) for r in found if r.doc_id == 6}) == 1
    assert lm_mixing.score_texts(empty(spark)).count() == 0


def test_codes_are_a_distribution():
    code = lm_mixing.Code(np.arange(1, 40, dtype=np.uint64), np.arange(1, 40))
    assert sum(2.0 ** -int(n) for n in code.lengths) == pytest.approx(1)
    total = 0.0
    for k in range(39):
        nodes, bits = (x[code.offsets[k] : code.offsets[k + 1]] for x in (code.nodes, code.bits))
        total += np.prod(np.where(bits, code.p[nodes], 1 - code.p[nodes]))
    assert total == pytest.approx(1)


def test_toxicity(spark):
    bad = ["idiot", "scum", "moron", "loser", "gruml"]
    docs, marks = [], []
    for k in range(600):
        text = words(k, 40).split()
        toxic = k % 6 == 0
        if toxic:
            for j in range(3):
                text[5 + 9 * j] = bad[(k // 6 + j) % 5]
        docs.append((k, " ".join(text), "x"))
        marks.append((k, int(toxic)))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "you idiot, you scum", "x"), (0, docs[0][1], "x")]
    marks += [(0, 0), (3000, 1), (None, 1), (5, None)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.score_documents(df, labels).collect()
    assert len(found) == len(docs)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 3) == 1) for r in found)
    known = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < 600 and r.held_out}
    assert sum(r.predicted == (i % 6 == 0) for i, r in known.items()) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert {r.predicted for r in found if r.doc_id in (1000, 1001)} == {0}
    nothing = toxicity.score_documents(df, labels.where("false")).collect()
    assert len(nothing) == len(docs)
    assert toxicity.score_documents(df.where("false"), labels).count() == 0


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 4, 5], xs, ys).tolist() == [0, 0.5, 0.5, 1, 1]


def test_pipeline(spark):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in queries.op10_toxicity(spark, DATA).collect()}
    given = docs.collect()
    calm = stages["toxicity"](spark, docs, DATA)
    assert calm.columns == docs.columns
    assert {r.doc_id for r in calm.collect()} == {d.doc_id for d in given if not scored[d.doc_id]}
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, DATA)
    assert {r.doc_id for r in clean.collect()} == {d.doc_id for d in given if not any(i and 100 * len(i & shingle_set(d.text)) >= 80 * len(i) for i in items)}
    one = stages["near_duplicates"](spark, docs, DATA)
    assert one.columns == docs.columns
    sets = {d.doc_id: shingle_set(d.text) for d in given}
    kept = {r.doc_id for r in one.collect()}
    gone = set(sets) - kept
    assert gone
    assert all(any(b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets) for a in gone)
    assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in kept for b in kept)
    last = p.run(spark, DATA).collect()
    assert {r.doc_id for r in last} <= kept
    assert all(r.n_tokens == len(r.ids) for r in last)
