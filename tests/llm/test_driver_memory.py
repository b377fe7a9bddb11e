"""What the driver holds of the corpus pipeline's lexicons: columns, not objects for every entry."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from weftline.llm import toxicity


def test_entries_of_the_lexicon_are_columns_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 1)
    texts = [" ".join("".join(chr(97 + int(c)) for c in f"{(k * 97 + j * 7919) % 99_991:05d}{j:03d}") for j in range(200)) for k in range(60)]
    rows = spark.createDataFrame([(t, k % 2, k // 2 % 2) for k, t in enumerate(texts)], "text string, toxic int, fold int").repartition(4)
    rows.count()
    tracemalloc.start()
    counts = toxicity._count(rows)
    lexicon = counts.lexicon((0, 1), 30, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts.grams) > 10_000
    assert peak < 120 * len(counts.grams)
    there = pickle.loads(pickle.dumps(lexicon))
    word = texts[1].split()[0]
    assert there.of(word) == lexicon.weights[word] > 0 and isinstance(there.weights, dict)


def test_log_odds_of_columns():
    grams = ["a", "b", "c", "d"]
    n = np.array([[1, 2, 3, 4], [0, 5, 0, 0], [0, 4, 0, 9], [7, 0, 0, 1]])
    counts = toxicity.Counts(pa.table({"gram": grams} | {f"n{k}": n[:, k] for k in range(4)}))
    assert list(counts) == grams
    odds = lambda a, b, toxic, clean: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    assert counts.lexicon((0,), 20, 30).weights == {"b": odds(5, 0, 20, 30), "d": odds(0, 7, 20, 30)}
    assert counts.lexicon((0, 1), 50, 60).weights == {g: odds(r[1] + r[3], r[0] + r[2], 50, 60) for g, r in zip(grams, n.tolist(), strict=True)}
