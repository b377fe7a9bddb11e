"""Words within two edits, met by hashes in arrays, against brute force; what is shuffled and found twice on the way."""

import random

import numpy as np
import pytest

from tests.test_growth import plan
from weftline.functions.text import edit_distance
from weftline.operators import fuzzy, spelling


def words(n, letters, most, seed):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(0, most))) for _ in range(n)})


@pytest.mark.parametrize("prefix", [None, 7])
def test_array_join_is_brute_force(spark, monkeypatch, prefix):
    monkeypatch.setattr(spelling, "PAIRS", 500)
    monkeypatch.setattr(spelling, "MADE", 300)
    monkeypatch.setattr(spelling, "WHOLE", 5)
    asked, known = words(220, "abc", 9, 1) + ["é", "éüa", "aéü", "x" * 40, "y" + "x" * 39, "€" * 3], words(220, "abcd", 9, 2) + ["ü", "éü", "x" * 39, "€€", "x" * 38 + "yx"]
    queries = spark.createDataFrame([(w,) for w in [*asked, asked[0], None]], "query string")
    rows = [(w, len(w)) for w in known] + [("ab", 99), ("null", None), (None, 3)]
    found = [tuple(r) for r in fuzzy.fuzzy_join(queries, spark.createDataFrame(rows, "term string, count int"), 2, prefix).collect()]
    wanted = [(q, t, c, d) for q in set(asked) for t, c in set(rows) if t is not None and (d := edit_distance(q, t, 2)) >= 0]
    assert len(found) == len(set(found)) and not set(found) ^ set(wanted)


def test_neither_words_nor_deletes_are_shuffled_as_rows(spark):
    known = spark.createDataFrame([("abc", 1), ("abd", 2)], "term string, count long")
    text = plan(fuzzy.fuzzy_join(known.selectExpr("term AS query"), known, 2))
    assert "Generate" not in text and "SortMergeJoin" not in text and "label" in text


def test_words_of_one_edit_are_given_by_one_bucket():
    """Such words share a delete for each other letter, which lie in many buckets."""
    codes = np.frombuffer(b"abcdefghijabcdefghix", np.uint8)
    ends = spelling._Ends(codes, np.array([0, 10, 20]), None)
    a, b = np.array([0], np.int32), np.array([1], np.int32)
    assert sum(not ends.elsewhere(a, b, k, 16)[0] for k in range(16)) == 1
