"""Samples of very many rows, and words that are written with combining marks."""

import unicodedata

from pyspark.sql import functions as F

from weftline.llm import toxicity
from weftline.llm.state import hash_limit


def test_a_share_below_a_millionth_is_one():
    assert hash_limit(1.0) == 2**63 - 1 and hash_limit(0.0) == -(2**63)
    for share in (1e-3, 1e-7, 1e-12):
        assert abs((hash_limit(share) + 2**63) / 2**64 - share) < 1e-6 * share


def test_shares_of_rows(spark):
    ids = spark.range(200_000)
    for share in (1.0, 0.1, 0.003):
        n = ids.where(F.xxhash64("id") <= F.lit(hash_limit(share)).cast("long")).count()
        assert abs(n - share * 200_000) <= 5 * (share * 200_000) ** 0.5 * (share < 1)


def test_decomposed_words_are_the_composed_ones():
    text = "espèce de crétin, tu es dégoûtant"
    apart = unicodedata.normalize("NFD", text)
    assert apart != text
    lexicon = toxicity.Lexicon({})
    assert toxicity.features(apart, lexicon) == toxicity.features(text, lexicon)


def test_what_is_learned_is_what_is_looked_up(spark):
    """The lexicon's words are those that features() looks up, whatever marks they carry."""
    marked = "q̃uib x̂yz"  # marks that no letter is composed with
    rows = spark.createDataFrame([(f"{marked} you {k}", 1, k % 2) for k in range(40)] + [(f"plain you {k}", 0, k % 2) for k in range(40)], "text string, toxic int, fold int")
    counts = toxicity._count(rows)
    words = toxicity._words(toxicity._composed(marked))[1]
    assert words == marked.split()
    for word in words:
        assert set(toxicity.grams(word)) <= set(counts)
