"""BPE against the tokenizers library, repeats and links against brute force."""

import hashlib
import random
import re
from array import array

import numpy as np
import public_tokenizers
import pytest

from tests.llm.fixtures import documents, empty, rows
from weftline.llm import bpe, jaccard_join, suffix_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_codec_is_the_library(library):
    rnd, codec = random.Random(2), bpe.codec(PATH)
    texts = [r[1] or "" for r in rows()] + ["it's 'tis I'LL don't <|endoftext|>x <|startoftext|>", "ΣΑΣ İstanbul ½ ²３ 日本語 ́a", "\x1c\x1da\x85b\xa0c"]
    texts += ["".join(rnd.choice("abcdeotihns '-") for _ in range(200)) for _ in range(50)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False)
        ids, decoded = codec.encode(text)
        assert list(array("I", ids)) == want.ids
        assert decoded == codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_automaton_is_merging():
    merges = [("a", "a"), ("aa", "a"), ("a", "b"), ("aa", "ab"), ("b", "aa")]
    automaton = bpe.MergeAutomaton(["a", "b"], merges)

    def merged(word):
        parts = list(word)
        for u, v in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k] == u and parts[k + 1] == v:
                    parts[k : k + 2] = [u + v]
                k += 1
        return parts

    for n in range(1, 2**9):
        path = merged(bin(n)[3:].replace("0", "a").replace("1", "b"))
        numbers = [automaton.labels.index(p) for p in path]
        assert all(automaton.has_arc(u, v) for u, v in zip(numbers, numbers[1:]))


def test_codec_rows(spark, library):
    found = bpe.bpe_encode(documents(spark), PATH).collect()
    assert len(found) == len(rows())
    want = sorted((str(r[0]), hashlib.sha256(np.array(library.encode(r[1] or "", add_special_tokens=False).ids, np.uint32).tobytes()).hexdigest()) for r in rows())
    assert sorted((str(r.doc_id), r.ids_sha256) for r in found) == want
    assert all(r.n_tokens == len(r.ids) for r in found)
    decoded = bpe.bpe_decode(bpe.bpe_encode(documents(spark), PATH), PATH).collect()
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in decoded)
    assert bpe.bpe_encode(empty(spark), PATH).count() == 0


def brute_repeats(docs, length):
    """Per (id, text): the kept bytes. Documents in order of their id, those without one last; a repeated row is its first."""
    order = sorted({(i if i is not None else 1 << 63, t or "") for i, t in docs}, key=lambda r: r[0])
    first = {}
    for i, t in order:
        data = t.encode()
        for p in range(len(data) - length + 1):
            first[data[p : p + length]] = min(first.get(data[p : p + length], (1 << 64, 0)), (i, p))
    out = {}
    for i, t in order:
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i, t] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("many", [0, 256])
def test_repeats_are_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    found = suffix_dedup.remove_repeats(documents(spark)).collect()
    want = brute_repeats([r[:2] for r in rows()], 100)
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted((str(i), *want[i if i is not None else 1 << 63, t or ""]) for i, t in (r[:2] for r in rows()))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        suffix_dedup.remove_repeats(empty(spark), length=10)


def test_interval_expansion():
    rnd = random.Random(4)
    text = np.array([rnd.choice((1, 2, 3)) for _ in range(600)] + [0], np.uint16)
    text[200:260] = text[20:80]
    order, classes = suffix_dedup.suffix_classes(text, 12)
    kind = dict(zip(order.tolist(), classes.tolist()))
    for a in range(0, 580, 7):
        for b in range(580):
            assert (kind[a] == kind[b]) == (text[a : a + 12].tolist() == text[b : b + 12].tolist())


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components_are_brute_force(spark):
    docs = [r[:2] for r in rows()]
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    def first(k):
        ids = [i for (i, _), g in zip(docs, group) if g == group[k] and i is not None]
        return docs[k][0] if not sets[k] else min(ids)

    want = sorted((str(i), len(s), str(first(k))) for k, ((i, _), s) in enumerate(zip(docs, sets)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(documents(spark)).collect()) == want
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_t_occurrence_search():
    rnd = np.random.default_rng(1)
    base = np.unique(rnd.integers(0, 2**63, 150, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[rnd.random(len(base)) > rnd.choice([0.01, 0.05, 0.1, 0.2])], rnd.integers(0, 2**63, rnd.integers(0, 20), dtype=np.uint64)))) for _ in range(60)]
    sets += [np.zeros(0, np.uint64), base[:3], base]
    lists = jaccard_join.Lists(sets)
    for q in sets:
        both = [len(np.intersect1d(q, s)) for s in sets]
        assert sorted(lists.search(q)) == [(k, n) for k, (n, s) in enumerate(zip(both, sets)) if n and 100 * n >= 80 * len(np.union1d(q, s))]
    assert jaccard_join.Lists([]).search(base) == []


def test_a_group_of_near_copies(spark):
    """Copies of one text with more and more changes, and others that hold parts of it, in several clusters."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    base, other = [rnd.choice(vocabulary) for _ in range(90)], [rnd.choice(vocabulary) for _ in range(90)]
    docs = []
    for k in range(220):
        text = list(base if k % 3 else base[:45] + other[45:])
        for _ in range(rnd.choice((0, 1, 2, 2, 3, 4, 6))):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        docs.append((k, " ".join(text[: 90 - rnd.choice((0, 0, 3, 10))])))
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(group))
    assert 1 < len(set(group)) < 150
