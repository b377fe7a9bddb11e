"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

A text's n-grams (1 to 3 letters, lower-cased, all else counting as a space) are hashed into 2**16 slots;
a slot's weight is (1 + log count) * idf, and a text's vector has length 1. The inverse document frequencies
are counted over all training documents; the weights are trained by FTRL-proximal with an elastic net (L1 and
L2) on at most `sample` of them, spread evenly over the languages; the temperature of the softmax is then
fitted on a fifth of these that training didn't see.

Defined cases: a text that is null or holds no letter gets the language und and the score 0; documents
without an id or a language aren't learned from; without anything to learn from all are und; equal
probabilities go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import hash_limit
from weftline.llm.text import U64, mix, releasing, text_slices

SLOTS, ORDERS, SAMPLE, EPOCHS = 1 << 16, 3, 6000, 4
_seeds = mix(np.arange(11, 11 + ORDERS * ORDERS, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
    return _tables["letter"]


def slot_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """For each text its slots and their counts, in slot order; None without a letter."""
    letter = _letters()
    folded = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letter[codes]
    values = np.where(known, codes, 32).astype(np.uint64)
    hashed = []
    for order in range(1, ORDERS + 1):
        total = np.zeros(max(0, len(values) - order + 1), np.uint64)
        for k in range(order):
            total += values[k : len(total) + k] * _seeds[order * (order - 1) // 2 + k]
        hashed.append((mix(total + U64(order)) & U64(SLOTS - 1)).astype(np.int64))
    at = 0
    for t in folded:
        stop = at + len(t)
        if known[at:stop].any():
            counts = np.bincount(np.concatenate([h[at : max(at, stop - k)] for k, h in enumerate(hashed)]), minlength=SLOTS)
            slots = np.flatnonzero(counts)
            yield slots, counts[slots]
        else:
            yield None
        at = stop + 1


def _vector(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[slots]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for a softmax over sparse vectors."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((SLOTS, classes)), np.zeros((SLOTS, classes))

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[slots]
        more = n + g * g
        self.z[slots] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = more


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section over its logarithm."""

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean())

    a, b, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


#: Languages that are told apart, at most: the ones with the most documents.
LANGUAGES = 1000


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for found in slot_counts(texts):
            if found is None or not self.languages:
                out.append(("und", 0.0))
                continue
            p = _softmax(_vector(*found, self.idf) @ self.weights[found[0]] / self.temperature)
            best = int(p.argmax())
            out.append((self.languages[best], float(p[best])))
        return out


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """docs (doc_id, text, lang): what may be learned from; a null lang isn't."""
    docs = docs.where("doc_id is not null and lang is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    docs = docs.where(F.col("lang").isin(list(sizes)))
    languages = sorted(sizes)
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for batch in text_slices(whole):
                for found in slot_counts(batch.column("text").to_pylist()):
                    if found is not None:
                        total[found[0]] += 1
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(total[filled])], schema=schema)

    frequency = np.zeros(SLOTS)
    for slot, n in docs.select("text").mapInArrow(releasing(count), "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        frequency[slot] = n
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((SLOTS, 0)), 1.0)

    each = max(20, sample // len(languages))
    share = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(hash_limit(min(1.0, each / sizes[name]))).cast("long"))))
    picked = docs.where(F.xxhash64("doc_id") <= share[F.col("lang")])
    fields = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                rows = [(lang, order, f[0].astype(np.uint16).tobytes(), f[1].astype(np.uint32).tobytes()) for lang, order, f in zip(batch.column("lang").to_pylist(), batch.column("order").to_pylist(), slot_counts(batch.column("text").to_pylist()), strict=True) if f is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)

    rows = picked.select("text", "lang", F.xxhash64("doc_id", F.lit(3)).alias("order")).mapInArrow(releasing(vectors), "lang string, order long, slots binary, counts binary").collect()
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    seen = [(np.frombuffer(s, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float64), languages.index(lang)) for lang, _, s, c in rows]
    seen = [(s, _vector(s, c, idf), label) for s, c, label in seen]
    held, own = seen[::5] if len(seen) >= 20 else seen, [r for k, r in enumerate(seen) if k % 5 or len(seen) < 20]
    model = Ftrl(len(languages))
    for _ in range(EPOCHS):
        for s, x, label in own:
            model.learn(s, x, label)
    weights = model.weights(slice(None))
    temperature = _temperature(np.array([x @ weights[s] for s, x, _ in held]), np.array([label for *_, label in held])) if held else 1.0
    return LanguageModel(languages, idf, weights, temperature)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred and score. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found = shared.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    return docs.mapInArrow(releasing(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only rows that aren't held out are learned from."""
    from weftline.llm.toxicity import held_out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_languages(own.where(~held_out(5, 0)), sample)
    return predict_languages(own.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
