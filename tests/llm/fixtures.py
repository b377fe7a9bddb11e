"""A small awkward table of documents: nulls, empty, white and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, row string, score string, key string"


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def rows():
    base = words(1, 120).split()
    texts = [
        None, "", " \n\t ", "Two words", "two WORDS", "one two three four five", words(2, 80), words(2, 80), words(3, 4000),
        " ".join(base), " ".join([*base[:60], "changed", *base[61:]]), " ".join([*base[:30], "x", *base[31:90], "y", *base[91:]]),
        words(4, 50) + " " + " ".join(base[:70]) + " " + words(5, 40), " ".join(base[:70]), "é" * 300 + " ü ß €", "a" * 250, "\x00\x01 ￿ 🤖 " * 30,
    ]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(6, words(2, 80)), (None, words(2, 80)), (None, None), (900, "z" * 99), (901, "z" * 100), (902, "z" * 101)]
    return [(i, t, [None, "en", "de"][k % 3], None if k % 4 else "s", None, "c", "r", "s", "k") for k, (i, t) in enumerate(out)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
