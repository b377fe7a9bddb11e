"""Matching of trees and deep pages, newer letters, exact scores of any size, shared shingles, and counts in half the numbers."""

import functools
import random
import time
from array import array

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tests.llm.fixtures import documents, empty, words
from weftline.llm import jaccard_join, lm_mixing, pii_crf, state, topk_search, wrapper
from weftline.llm.bpe import BpeCodec


def _tree(rnd, depth):
    return [rnd.choice("ab"), [_tree(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))] if depth else []]


def _node(tree):
    out = wrapper.Node.__new__(wrapper.Node)
    out.key, out.children, out.elements, out.index = tree[0], [_node(c) for c in tree[1]], [], -1
    return out


def _largest(x, y):
    if x[0] != y[0]:
        return 0

    @functools.cache
    def rest(i, j):
        if i == len(x[1]) or j == len(y[1]):
            return 0
        both = _largest(x[1][i], y[1][j])
        return max(rest(i + 1, j), rest(i, j + 1), both + rest(i + 1, j + 1) if both else 0)

    return 1 + rest(0, 0)


def test_tree_matching_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        x, y = _tree(rnd, 3), _tree(rnd, 3)
        pairs = wrapper.matched(x, _node(y))
        assert len(pairs) == _largest(x, y)
        assert all(a[0] == b.key for a, b in pairs)


def test_many_children_are_matched_in_seconds():
    inner = "".join(f"<p>a{k}</p><h2>b</h2>" for k in range(8000))
    skeleton = wrapper._tree(f"<article>{inner}</article>").skeleton()
    other = wrapper._tree(f"<article><pre>q</pre>{inner}<ul></ul></article>")
    began = time.time()
    assert len(wrapper.matched(skeleton, other)) >= 16_000
    assert time.time() - began < 30


def test_deep_menus_and_names_of_text():
    deep = "<body>" + "<div>" * 300 + "<nav><p>MENU</p><div>x</div></nav><p>real <b>bold <i>it</i></b> end</p>after<div>one</div>two" + "</div>" * 300
    flat = deep.replace("<div>" * 300, "<div>").replace("</div>" * 300, "</div>")
    assert wrapper.blocks([wrapper.parse(deep)]) == wrapper.blocks([wrapper.parse(flat)]) == ["real bold it end", "after", "one", "two"]
    page = '<article><p class="side">kept</p><p class="advert">gone</p><div class="share">gone</div><nav>gone</nav><p class="alert">x</p></article>'
    assert wrapper.blocks([wrapper.parse(page)]) == ["kept", "x"]


def test_newer_letters_are_no_letters():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), BpeCodec(path)
    for code in (0x558, 0x58B, 0x58C, 0x88F, 0xC5C, 0x1C89, 0x323B0, 0x41, 0x660):
        text = f"a{chr(code)}b {chr(code)}{chr(code)} x{chr(code)}1"
        assert array("I", own.encode(text)[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_scores_of_any_size(spark):
    rows = [(0, [1e16, 3.0]), (1, [1e16, 5.0]), (2, [2.0**40, -1.0]), (3, [1.0, 1.0]), (4, [1e300, 1.0]), (50, [-1e300, 2.0]), (100, [1e308, 1.0]), (7, [1e307, 1.0])]
    found = topk_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in rows if all(abs(256 * x) != float("inf") for x in v)}
    want = {}
    for i, q in whole.items():
        if i % 50 == 0:
            best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in whole.items() if j != i)
            want |= {(i, k + 1): -s for k, (s, _) in enumerate(best[:5])}
    assert {(r.query_id, r.rank): r.score for r in found} == want
    assert 100 not in {r.query_id for r in found}


@pytest.mark.parametrize("near", [False, True])
def test_a_common_shingle_makes_no_pairs(spark, near):
    """Thousands of texts that share one passage, and don't link, ask nothing of each other; near copies are one component."""
    shared = words(1, 12)
    texts = [f"{words(100 + k, 30)} {shared}" for k in range(1500)]
    if near:
        base = words(7, 200).split()
        for k in range(300):
            own = list(base)
            own[k % 200], own[(k * 7 + 3) % 200] = f"x{k}", f"y{k}"
            texts.append(" ".join(own))
    asked = []
    whole = jaccard_join._searched

    def counted(rows, keys, percent):
        asked.append(rows.count())
        return whole(rows, keys, percent)

    jaccard_join._searched = counted
    try:
        found = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        jaccard_join._searched = whole
    parts = {}
    for r in found:
        parts.setdefault(r.component_id, []).append(r.doc_id)
    assert sum(asked) <= 4 * len(texts)
    sets = {r.doc_id: set(zip(*(texts[r.doc_id].split()[i:] for i in range(5)), strict=False)) for r in found if r.doc_id >= 1500}
    assert all(len(p) == 1 for c, p in parts.items() if c < 1500)
    if near:  # brute force over the near copies
        group = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((group[a], group[b]))
                    group = {k: low if v == high else v for k, v in group.items()}
        assert {r.doc_id: r.component_id for r in found if r.doc_id >= 1500} == group


def test_counts_off_the_path():
    rnd = np.random.default_rng(6)
    code = lm_mixing.Code(np.arange(1, 80, dtype=np.uint64), rnd.integers(1, 900, 79))
    keys, n = np.unique((rnd.integers(0, 9, 4000).astype(np.uint64) << np.uint64(lm_mixing.LEAF_BITS)) | rnd.integers(0, 79, 4000).astype(np.uint64), return_counts=True)
    offsets, zeros, ones = lm_mixing.node_counts(code, keys, n)
    for got, want in zip(lm_mixing.on_path(code, keys, *lm_mixing.off_path(code, keys, offsets, zeros, ones)), (offsets, zeros, ones), strict=True):
        assert np.array_equal(got, want)


def test_all_spans_are_counted(spark):
    found = pii_crf.find_personal_data(documents(spark)).collect()
    for r in found:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert r.n_spans == len(kinds) == r.n_all_email + r.n_all_ip + r.n_all_card + r.n_all_phone
        assert r.n_all_email >= r.n_email
        assert r.n_all_ip >= r.n_ip
    assert pii_crf.find_personal_data(empty(spark)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        state.shared_dir(Session())
