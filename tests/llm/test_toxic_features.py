"""Features of texts in other alphabets, and of words that are masked more than once."""

import time

from weftline.llm import toxicity

CAPITALS, UPPER, MASKED = -10, -9, -2


def features(text):
    return toxicity.features(text, toxicity.Lexicon({}))


def test_capitals_of_other_alphabets():
    for text in ("ТЫ ДУРАК уйди", "ΕΙΣΑΙ ΒΛΑΚΑΣ φυγε", "JESTEŚ ŻAŁOSNY ględa", "ČERTŮV KŮŇ běží", "YOU FOOL go"):
        words, found = text.split(), features(text)
        assert found[CAPITALS] == sum(w.isupper() for w in words) / len(words) == 2 / 3
        assert found[UPPER] == sum(map(str.isupper, text)) / sum(map(len, words))


def test_masked_words_count_each_time():
    assert features("1d10t and 1d10t")[MASKED] == 2
    assert [features(" ".join(["you", *["m0ron"] * k]))[MASKED] for k in range(4)] == [0, 1, 2, 3]
    assert features("m0r0n!! (idi0t) l@st l@st")[MASKED] == 2


def test_combining_marks_stay_in_words():
    assert round(features("café is̈ open")[-1], 6) == round(features("cafe is open")[-1], 6)


def test_long_runs_are_linear():
    began = time.time()
    features("a1" * 300_000)
    assert time.time() - began < 10
