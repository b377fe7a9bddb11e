"""Filter audits, formatted chats and hard negatives against plain programs, on awkward rows, and in their SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.fixtures import documents, empty, rows
from tests.test_queries import TABLES, plain
from weftline.llm import hard_negatives as hn
from weftline.llm import queries
from weftline.llm.chat_format import chat_digests, format_chats, read_blocks, read_turns
from weftline.llm.filter_audit import filter_audit, lattice_edges


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_chat_format", "op13_hard_negatives"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


# filters

def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(set(text) & set("#$%&*|"))]


def plain_audit(docs, labels):
    texts = [t or "" for _, t, _ in docs]
    rows_ = []
    for (i, _, lang), text in zip(docs, texts, strict=True):
        copy = i is not None and any(j is not None and j < i and other == text for (j, _, _), other in zip(docs, texts, strict=True))
        said = [x for x in labels if x[0] == i and i is not None]
        rows_.append((lang or "", [*fails(text), copy], any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {r[0] for r in rows_}:
        mine = [r for r in rows_ if r[0] == part]
        table = {}
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in mine) - len(gone)
                alone = sum(r[1][f] and sum(r[1]) == 1 for r in mine)
                table[order, step] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (order, step), v in table.items():
            shapley = sum(w[1] for (o, s), w in table.items() if o[s] == order[step])
            out[part, "".join("ABCDE"[k] for k in order), step + 1] = (*v, shapley)
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in df.collect()}


def test_audit_of_awkward_rows(spark):
    docs = [(r[0], r[1], r[2]) for r in rows()] + [(5, "A#", "en"), (5, "A#", "en"), (3, "A#", "de"), (None, "A#", "en"), (77, " ".join(["w"] * 300), None), (78, " ".join(f"w{k}" for k in range(300)), None)]
    labels = [(5, 1, 0), (5, None, 1), (None, 1, 1), (3, 1, None), (77, 0, 1), (78, 1, 0), (78, 0, 0)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audited(filter_audit(df, said))
    assert found == plain_audit(docs, labels)
    assert len(found) == 600 * len({d[2] or "" for d in docs})


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty(spark), labels).count() == 0
    assert len(audited(filter_audit(documents(spark), labels))) == 600 * 3


def test_a_hot_text_is_counted_before_it_is_shuffled(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = audited(filter_audit(df, labels))
    assert found["en", "EABCD", 1] == (1, 19999, 0, 0, 10000, 0, sum(v[1] for (_, o, s), v in found.items() if o[s - 1] == "E"))
    assert found["en", "AEBCD", 2][:3] == (0, 0, 19999)


def test_edges_of_the_lattice(spark):
    counts = spark.createDataFrame([("", m, False, False, 1) for m in range(8)], "part string, mask int, good boolean, toxic boolean, n long")
    found = lattice_edges(counts, "ABC").collect()
    assert len(found) == 12 and all(r.kept + r.removed + r.redundant + sum(1 for m in range(8) if m & r.subset and not m & r.bit) == 8 for r in found)


# chats

TRICKY = st.lists(st.sampled_from(["#", "<", "/", "\\", ":", "\n", "t", "u", ">", " ", "é", "🤖", "</turn>", "</part>", "### user:\n"]), max_size=12).map("".join)


def test_round_trip_of_awkward_texts(spark):
    rnd = random.Random(5)
    chats = {}

    @settings(max_examples=250, deadline=None, database=None)
    @given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", ":"]), TRICKY), TRICKY), min_size=1, max_size=5))
    def gather(turns):
        chats[len(chats)] = turns

    gather()
    data = [(c, k, role, text) for c, turns in chats.items() for k, (role, text) in enumerate(turns)]
    rnd.shuffle(data)
    made = format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    found = made.select("conv_id", "formatted", "segments", read_turns(F.col("formatted")).alias("turns"), read_blocks(F.col("formatted")).alias("blocks")).collect()
    assert len(found) == len(chats)
    for r in found:
        turns = chats[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns
        merged = [(role, [t for _, t in group]) for role, group in itertools.groupby(turns, key=lambda t: t[0])]
        assert [(b.role, b.texts) for b in r.blocks] == merged
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("</turn>") == len(merged) and r.formatted.count("</part>") == len(turns) - len(merged)
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in turns)


def test_digests_of_awkward_rows(spark):
    data = [
        (1, None, "user", "b"), (1, 0, "assistant", None), (1, 2, "assistant", "x</turn>\\"), (1, 2, "assistant", "###"), (2, 0, None, ""), (None, 1, "user", "n"), (None, 1, "assistant", "m"), (3, 5, "assistant", "é" * 50000),
        *((4, k, "user" if k < 600 or k % 2 else "assistant", f"t{k}") for k in range(1000)),
    ]
    df = spark.createDataFrame([(*d, "extra", 1) for d in data], "conv_id long, turn long, role string, text string, formatted string, segments int")
    found = {r.conv_id: r for r in chat_digests(format_chats(df)).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    for c, r in found.items():
        turns = sorted(((d[1] is not None, d[1] or 0, d[2] or "", d[3] or "") for d in data if d[0] == c))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.n_blocks == len(list(itertools.groupby(t[2] for t in turns)))
    assert format_chats(df.where("false")).count() == 0


def test_chats_stay_in_spark(spark):
    plan = queries.op12_chat_format(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange") <= 2


# negatives

def plain_negatives(vectors, k=5, positives=5, every=100, lowest=80):
    usable = [(i, label, [int(np.floor(256 * c)) for c in v]) for i, label, v in vectors if None not in (i, label, v) and all(c is not None and np.isfinite(c) and np.isfinite(c * 256.0) for c in v)]
    out = []
    for a in (r for r in usable if r[0] % every == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in usable if r[0] != a[0] and len(r[2]) == len(a[2])]
        for p in sorted(s for s in scored if s[2] == a[1])[:positives]:
            fit = sorted(s for s in scored if s[2] != a[1] and lowest * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:k]
            out += [(a[0], p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>"


def mined(df, **more):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **more).collect())


def test_negatives_of_clustered_vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16))
    data = [(int(i), int(rnd.integers(4)), (centres[i % 12] + 0.2 * rnd.normal(size=16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    assert mined(df, every=25) == plain_negatives(data, every=25)
    assert mined(df, every=25, k=2, positives=3, lowest=95, lists=40) == plain_negatives(data, 2, 3, 25, 95)


def test_negatives_of_awkward_rows(spark, monkeypatch):
    rnd = random.Random(9)
    inf, nan = float("inf"), float("nan")
    small = [(i, rnd.choice([0, 1]), [rnd.choice([-1.0, 0.0, 0.004, 1.0]) for _ in range(3)]) for i in range(60)]
    odd = [
        (None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (100, 1, None), (100, 1, [1.0, None, 1.0]), (200, 1, [nan, 1.0, 1.0]), (300, 1, [inf, 0.0, 0.0]), (300, 0, [1e308, 0.0, 0.0]),
        (100, 0, []), (101, 0, []), (102, 1, []), (100, 0, [1.0, 2.0]), (103, 0, [1.0, 2.0]), (104, 1, [1.0, 2.0]), (0, 1, [1.0, 1.0, 0.0]), (5, 1, [1.0, 1.0, 0.0]), (5, 1, [1.0, 1.0, 0.0]), (-100, 1, [1.0, 0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in small + odd], SCHEMA + ", rank string").repartition(3)
    assert mined(df, every=10) == plain_negatives(small + odd, every=10)
    assert hn.hard_negatives(df.where("false")).count() == 0
    monkeypatch.setattr(hn, "BLOCK", 2), monkeypatch.setattr(hn, "TOGETHER", 2), monkeypatch.setattr(hn, "SAMPLE", 7)
    assert mined(df, every=20) == plain_negatives(small + odd, every=20)


def test_negatives_of_large_numbers(spark):
    rnd = random.Random(1)
    data = [(i, i % 2, [float(rnd.randrange(-(10**6), 10**6)) for _ in range(2)]) for i in range(40)]
    assert mined(spark.createDataFrame(data, SCHEMA), every=10) == plain_negatives(data, every=10)


def test_bounds_hold_every_score_and_lists_are_skipped(spark):
    rnd = np.random.default_rng(8)
    centres = 4 * rnd.normal(size=(30, 24))
    data = [(int(i), 0, (centres[i % 30] + 0.05 * rnd.normal(size=24)).tolist()) for i in range(3000)]
    lists = hn.Lists.build(hn._usable(spark.createDataFrame(data, SCHEMA), "vec_id", "label", "embedding", 256.0), 30)
    q = np.floor(256 * np.array([d[2] for d in data[:20]]))
    low, high = lists.bounds(24, q)
    kth = np.sort(q @ np.floor(256 * np.array([d[2] for d in data])).T, axis=1)[:, -5]
    for r in lists.rows.collect():
        s = q @ np.array(r.v)
        assert (low[:, r.list] <= s).all() and (s <= high[:, r.list]).all()
    assert (high >= kth[:, None]).mean() < 0.3  # most lists' bounds lie strictly below the k-th score
