"""Personal data, main text, decontamination and search against plain programs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, rows, words
from tests.llm.test_tokens_and_repeats import shingle_set
from weftline.llm import decontaminate, pii_crf, topk_search, wrapper
from weftline.llm.text import text_bytes

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split(".")) or kind == 2 and 13 <= len(digits) <= 19 and luhn or kind == 3 and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_are_the_expressions():
    texts = [
        "a@b a@b.c x.y+z@d-e.f.g, @q.r a@@b.c a@b.c@d.e.f @", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.2.3.4", "4111 1111 1111 1111 5 4111-1111-1111-1111 1 2 3 4111111111111111",
        "+1 (415) 555-2671 +12 +1 2 +1 (2) 3-4.5 67890123456789012", "é 1.2.3.4 é a@b.de", "", "+" * 50, "a@" * 50 + "b.c", "1" * 40, "9 " * 30,
    ]
    rnd = np.random.default_rng(0)
    texts += ["".join(rnd.choice(list("ab1234567890.@+- ()"), 120)) for _ in range(300)]
    for t in texts:
        assert pii_crf.pattern_spans(t) == plain_spans(t)


def test_field_learns_its_table():
    field = pii_crf.trained_field()
    fresh = pii_crf.labelled_rows(copies=3, seed=99)
    assert sum(got == want for got, (_, want) in zip(field.decode([t for t, _ in fresh]), fresh)) >= 0.97 * len(fresh)


def test_viterbi_is_the_best_path():
    import itertools

    field, sequence = pii_crf.trained_field(), ["12", "(at)", "555-1234"]
    scores = {}
    ids = [[field.index.get(f, len(field.index)) for f in t] for t in pii_crf._features(sequence)]
    for path in itertools.product(range(len(field.labels)), repeat=3):
        if field.first[path[0]]:
            scores[path] = sum(field.emission[i].sum(0)[p] for i, p in zip(ids, path)) + sum(field.transition[a, b] for a, b in zip(path, path[1:]))
    assert tuple(field.decode([sequence])[0]) == max(scores, key=scores.get)


def test_personal_data_rows(spark):
    texts = [(0, "mail a.b@c.de or bob99 (at) mail4.example.com, (415) 555-2671."), (1, None), (2, ""), (None, "é 10.0.0.1"), (2, ""), (3, "card 4111.1111.1111.1111 for him")]
    df = spark.createDataFrame([(*r, "x", 7) for r in texts], "doc_id long, text string, spans string, n_chars long")
    found = {(r.doc_id, r.spans): r for r in pii_crf.find_personal_data(df, with_text=True).collect()}
    assert found[0, "email:5:13,email:17:45,phone:47:61"].masked == "mail <email> or <email>, <phone>."
    assert found[None, "ip:2:10"].n_ip == 1
    assert found[3, "card:5:24"].n_card == 0
    assert found[1, ""].masked is None
    masked = pii_crf.mask_personal_data(df)
    assert masked.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in masked.collect()} >= {(None, "é <ip>", 6), (1, None, None)}
    assert pii_crf.find_personal_data(empty(spark)).count() == 0
    assert pii_crf.find_personal_data(documents(spark)).count() == len(rows())


def test_spans_count_code_points():
    text = "ünï 日本 (at) x.example.com 415-555-2671 €"
    spans = pii_crf.added_spans(pii_crf.trained_field(), *text_bytes(pa.array(["", text])))[1]
    assert (3, text.index("415"), text.index(" €")) in spans


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Menu {k}</a></li></ul></nav>
<div class="ad">Buy {k}</div><div class="cookie-notice">We use cookies</div>{open}<h1>Title {k} &amp; co</h1><p>First   {k}<br>line<p>Second &eacute; <b>bold<i>er</b></i> end</p>
<!-- no --><aside>side {k}</aside><form><input name=q>Find</form><p>&nbsp;</p><div class="comments"><p>I say {k}</p></div>{close}<footer>&copy; {k}</footer>"""
WANT = "Title {k} & co\n\nFirst {k} line\n\nSecond é bolder end"


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ('<div class="c1">', "</div>"), ("<main><section>", "")])
def test_main_text(spark, open_, close):
    pages = [(k, f"http://h{k % 2}.org/{k}", PAGE.format(k=f"text{k} " + words(k, 30), open=open_, close=close)) for k in range(12)]
    pages += [(20, None, None), (21, "http://x", ""), (22, "bad url", "plain text"), (22, "bad url", "plain text"), (23, "http://h0.org", "<p>other <div"), (24, "http://h0.org/", "<div>" * 400 + "deep")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    found = wrapper.extract_main_text(df).collect()
    assert len(found) == len(pages)
    got = {r.page_id: r for r in found}
    for k in range(12):
        assert got[k].text == WANT.format(k=f"text{k} " + words(k, 30))
        assert got[k].n_chars == len(got[k].text)
    assert [got[k].text for k in (20, 21, 22, 23, 24)] == ["", "", "plain text", "other", "deep"]


def test_main_text_with_joined_pivots(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "SMALL", -1)
    test_main_text(spark, "<article>", "</article>")


def test_tree_matching():
    a = ["x", [["p", []], ["d", [["q", []]]], ["p", []]]]
    b = wrapper._tree("<x><p>1</p><e></e><d><q>2</q></d></x>").children[0]
    assert [(n[0], m.key) for n, m in wrapper.matched(a, b)] == [("x", "x"), ("p", "p"), ("d", "d")] or len(wrapper.matched(a, b)) >= 3


def test_decontamination_is_exact(spark, monkeypatch):
    items = [(0, words(1, 36)), (1, words(77, 20)), (2, "Two words"), (3, None), (4, ""), (5, words(3, 12)), (0, words(1, 36)), (6, words(88, 90))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = words(77, 20).split()
    docs = rows() + [(500, words(9, 3000) + " " + words(77, 20) + " " + words(10, 2000), *rows()[0][2:]), (501, " ".join(near[:19]) + " q " + words(8, 900), *rows()[0][2:]), (502, words(88, 90)[:250], *rows()[0][2:])]
    df = spark.createDataFrame(docs, documents(spark).schema)
    want = {(r[0], i) for r in docs for i, t in items if (s := shingle_set(t)) and 100 * len(s & shingle_set(r[1])) >= 80 * len(s)}
    for limit in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", limit)
        found = decontaminate.contaminated(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert len(found) == len(want)
    left = decontaminate.drop_contaminated(df, bench)
    held = [r for r in docs if any((s := shingle_set(t)) and 100 * len(s & shingle_set(r[1])) >= 80 * len(s) for _, t in items)]
    assert left.count() == len(docs) - len(held)
    assert left.columns == df.columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 100)
    monkeypatch.setattr(topk_search, "BLOCK", 3)
    rnd = np.random.default_rng(3)
    x = np.vstack((rnd.normal(size=(400, 64)), np.tile(rnd.normal(size=64), (150, 1)))).astype(np.float32)
    data = [(k, v.tolist(), "s") for k, v in enumerate(x)] + [(50, x[7].tolist(), "s"), (None, x[1].tolist(), "s"), (1000, None, "s"), (1001, [None] * 64, "s"), (1050, [float("nan")] * 64, "s"), (1100, [float("inf")] * 64, "s"), (1150, [1.0] * 3, "s"), (1200, [], "s")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:5]
            want += [(i, j, -s) for s, j in best]
    found = topk_search.exact_top_k(df).collect()
    once = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found}
    for i, _ in ok:
        if i % 50 == 0 and i != 50:  # 50 asks twice
            assert [once.get((i, k)) for k in range(1, 6) if (i, k) in once] == [(j, s) for a, j, s in want if a == i]
    assert topk_search.exact_top_k(df.where("false")).count() == 0
    assert df.select(F.max("vec_id")).first()[0] == 1200
