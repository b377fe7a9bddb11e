"""The pipeline's near-duplicate stage drops rows, not ids."""

from collections import Counter

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.fixtures import documents, rows, words
from tests.llm.test_tokens_and_repeats import shingle_set


def stay(given):
    """Brute force: the places of the rows that stay."""
    sets, group = [shingle_set(t) for _, t in given], list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for k in sorted(range(len(given)), key=lambda k: (given[k][0] is None, given[k][0] or 0, k)):
        first.setdefault(group[k], k)
    return set(first.values())


def check(spark, df, given):
    kept = corpus_pipeline.near_duplicates(spark, df, DATA)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(given[k] for k in stay(given))


def test_awkward_rows(spark):
    check(spark, documents(spark), [(r[0], r[1]) for r in rows()])


def test_missing_and_repeated_ids(spark):
    a, b, c, d, e = (words(k, 40) for k in range(50, 55))
    given = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (3, d), (9, words(60, 30)), (9, words(60, 30)), (None, None), (None, "")]
    check(spark, spark.createDataFrame(given, "doc_id long, text string"), given)
