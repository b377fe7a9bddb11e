"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: densities of lexicon words (a seed list, and a lexicon learned from the labelled
rows: whole words and word beginnings with their log-odds, the longest known one deciding), how near they
stand to the second person, and rates of capitals, punctuation and obfuscated spellings. The learned
lexicon's features of a training row come from the other half of the training rows. Trees are grown on
histograms with the logistic loss; the scores are calibrated by isotonic regression on out-of-fold margins.

The labels are learned from at most `sample` labelled rows, picked by a hash of the id; every text is
scored whole. Defined cases: null and empty texts are scored as empty ones; rows without an id or label
aren't learned from; of repeated labels the larger counts; without labels of both kinds the score is the
share of texts like it in the seed lexicon's sense: 0.9 with two seed words or more, else 0.1.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import hash_limit, small_batches, written
from weftline.llm.text import release, releasing, text_slices

SEED = frozenset("""asshole bastard bitch clown crap creep cretin degenerate disgusting dumbass filth freak fool garbage hate hateful
idiot idiotic imbecile jerk loser lunatic moron moronic pathetic pig scum scumbag shit stupid trash ugly vermin worthless
abruti connard crétin débile imbécile merde ordure pourriture abschaum arschloch blödmann dreck dummkopf idiota imbécil basura
estúpido estúpida escoria mierda asqueroso""".split())
SECOND = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti usted ustedes vosotros".split())
_MARKED = SEED | SECOND
#: The combining marks, which belong to words, as ranges of a pattern's class.
_MARKS = {k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"}
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(sorted(k for k in _MARKS if k - 1 not in _MARKS), sorted(k for k in _MARKS if k + 1 not in _MARKS), strict=True))
_WORD = re.compile(r"[^\W\d_]+")
_MARK, _WORD_WITH_MARKS = re.compile(f"[{_MARKS}]"), re.compile(rf"(?:[^\W\d_]+|[{_MARKS}]+)+")
_INSIDE = re.compile(r"[^\W\d_][0-9@$*#!]+(?=[^\W\d_])")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .\-_*][^\W\d_]\b){3,}")
_REPEATED = re.compile(r"([^\W\d_])\1{3}")
_RUN = re.compile(r"(?:[^\W_]|[@$!*])+")
_CAPITAL, _CAPITALS = re.compile(r"[A-Z]"), re.compile(r"[A-Z]{2}")
_PLAIN = str.maketrans("013457@$!", "oieastasi")
#: Labelled rows that are learned from, at most; documents that a lexicon entry must occur in; entries kept at most.
SAMPLE, LEAST, MOST = 16_000, 5, 200_000
REMEMBERED = 200_000


def grams(word: str) -> list[str]:
    """The lexicon entries that a lower-cased word has: its beginnings of 4 to 8 letters, marked, and itself, longest last."""
    return [f"^{word[:k]}" for k in range(4, min(8, len(word)) + 1)] + [word]


class Lexicon:
    """Log-odds of toxic documents by word, from the longest entry that is known of it."""

    def __init__(self, known: dict[str, float] | tuple[pa.Array, np.ndarray]):
        """known: the entries' log-odds, as a dictionary or two columns."""
        self.known = known
        self.memory: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"known": self.known, "memory": {}}

    @property
    def weights(self) -> dict[str, float]:
        """The log-odds by entry; made from columns where words are first looked up, which isn't the driver."""
        if isinstance(self.known, tuple):
            entries, values = self.known
            self.known = dict(zip(entries.to_pylist(), values.tolist(), strict=True))
        return self.known

    def of(self, word: str) -> float:
        if (known := self.memory.get(word)) is None:
            known, weights = 0.0, self.weights
            for gram in reversed(grams(word)):
                if (weight := weights.get(gram)) is not None:
                    known = weight
                    break
            if len(self.memory) < REMEMBERED:  # a full memory keeps what it has: frequent words come early
                self.memory[word] = known
        return known


def _distance(hits: list[int], places: list[int]) -> float:
    """1 / (1 + words between), for the nearest hit and second person; 0 without either."""
    if not hits or not places:
        return 0.0
    best = 1 << 30
    for h in hits:
        k = bisect_right(places, h)
        for p in places[max(0, k - 1) : k + 1]:
            best = min(best, abs(p - h))
    return 1.0 / (1 + best)


def _masked(text: str, inside: list[int]) -> list[str]:
    """The words with digits or marks for letters that hold the places, once for each that stands in the text, up to their last letter."""
    out, done = [], 0
    for at in inside:
        if at < done:
            continue
        start, done = at, _RUN.match(text, at).end()
        while start and (text[start - 1].isalnum() or text[start - 1] in "@$!*"):
            start -= 1
        stop = done
        while not text[stop - 1].isalpha():
            stop -= 1
        if stop > at + 1 and any(not c.isalpha() for c in text[at:stop]):
            out.append(text[start:stop])
    return out


def _marked(text: str) -> bool:
    """Whether the text has a combining mark; what Latin-1 can write has none."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _MARK.search(text) is not None
    return False


def _composed(text: str | None) -> str:
    """The text with letters and their marks as one where Unicode has them so, as the seed words are."""
    text = text or ""
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _words(text: str) -> tuple[list[str], list[str]]:
    """The words of a composed text, as they are and lower-cased: the lexicon is learned from the same ones as it is looked up for."""
    found = (_WORD if text.isascii() or not _marked(text) else _WORD_WITH_MARKS).findall(text)
    return found, [w.lower() for w in found] if len(found) < 3 else " ".join(found).lower().split(" ")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = _composed(text)
    plain = text.isascii()
    found, words = _words(text)
    n = len(words)
    per = 1.0 / max(n, 1)
    marked = [k for k, w in enumerate(words) if w in _MARKED]
    seeds, second = [k for k in marked if words[k] in SEED], [k for k in marked if words[k] in SECOND]
    get, of = lexicon.memory.get, lexicon.of
    known = list(map(get, words))
    weights = np.array([of(w) if x is None else x for x, w in zip(known, words, strict=True)] if None in known else known, np.float64)
    strong = np.flatnonzero(weights > 3.0)
    kinds = len({words[k] for k in strong.tolist()})
    top = np.sort(weights)[::-1][:8]
    tops = np.zeros(8)
    tops[: len(top)] = top
    letters = sum(map(len, found))
    capitals = 0 if plain and not _CAPITALS.search(text) else sum(map(str.isupper, found)) - sum(map(str.isupper, [w for w in found if len(w) == 1]))
    upper = len(_CAPITAL.findall(text)) if plain else sum(map(str.isupper, text))
    inside = [m.start() for m in _INSIDE.finditer(text)]
    odd = len(inside) + len(_SPACED.findall(text)) + len(_REPEATED.findall(text))
    masked = 0
    if inside:  # words with marks or digits for letters, read as the letters that they look like
        masked = sum(w in SEED or lexicon.of(w) > 3.0 for w in (m.lower().translate(_PLAIN) for m in _masked(text, inside)))
    size = max(len(text), 1)
    return [
        len(seeds), len(seeds) * per, _distance(seeds, second),
        *((weights > t).sum() * per for t in (1.0, 2.0, 3.0, 4.0)), float((weights > 2.0).sum()), float(len(strong)), float(kinds),
        tops[0], tops[1], tops[3], tops.mean(), float(np.clip(weights, 0, None).sum()) * per, float(weights.sum()) * per, _distance(strong.tolist(), second),
        len(second) * per, capitals * per, upper / max(letters, 1),
        text.count("!") / size, text.count("?") / size, sum(map(text.count, ",.;:")) / size, sum(map(text.count, "*$%&#@|")) / size,
        odd * per, masked * per, masked, np.log1p(n),
    ]


class Boosting:
    """Gradient-boosted trees for a 0/1 label: histograms of up to 64 bins, the logistic loss, Newton leaves."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.12, l2: float = 2.0, least: float = 3.0, bins: int = 64):
        self.trees, self.depth, self.rate, self.l2, self.least, self.bins = trees, depth, rate, l2, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        rows, width = x.shape
        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        margin = np.full(rows, self.base)
        self.grown = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._tree(binned, g, h)
            self.grown.append(tree)
            margin += tree["value"][leaf]
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            here = node - first
            open_rows = here >= 0
            gain_of = np.full(count, 1e-6)
            best = [(-1, 0)] * count
            slot = here[open_rows]
            go, ho = g[open_rows], h[open_rows]
            for j in range(binned.shape[1]):
                if not len(self.edges[j]):
                    continue
                key = slot * self.bins + binned[open_rows, j]
                gs = np.bincount(key, go, count * self.bins).reshape(count, -1).cumsum(1)
                hs = np.bincount(key, ho, count * self.bins).reshape(count, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                at = gain[:, :-1].argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), at] > gain_of).tolist():
                    gain_of[k], best[k] = gain[k, at[k]], (j, int(at[k]))
            for k, (j, b) in enumerate(best):
                if j >= 0 and b < len(self.edges[j]):
                    feature[first + k], cut[first + k] = j, self.edges[j][b]
                    rows = node == first + k
                    node[rows] = 2 * (first + k) + 1 + (binned[rows, j] > b)
        gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
        value = -self.rate * gs / (hs + self.l2)
        return {"feature": feature, "cut": cut, "value": value}, node

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.grown:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = tree["feature"][node]
                inner = j >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(j, 0)] > tree["cut"][node]), node)
            out += tree["value"][node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The knots of the non-decreasing least-squares fit of y on the margin, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first margin, last margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            total, weight, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][3] = last
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ys


class Counts:
    """Lexicon entries, and the documents with each by (fold, toxic): columns, as so many Python objects take a large part of the driver's memory."""

    def __init__(self, table: pa.Table):
        self.grams = pa.concat_arrays([pa.array([], pa.string()), *table.column("gram").chunks])
        self.n = np.stack([table.column(f"n{k}").to_numpy() for k in range(4)], 1)

    def __iter__(self) -> Iterator[str]:
        return (g.as_py() for g in self.grams)

    def lexicon(self, folds: tuple[int, ...], toxic: int, clean: int) -> Lexicon:
        """The log-odds of the entries that at least LEAST documents of the folds have; toxic, clean: documents of the folds."""
        a, b = (sum(self.n[:, 2 * f + k] for f in folds) for k in (1, 0))
        kept = a + b >= LEAST
        return Lexicon((self.grams.filter(pa.array(kept)), np.log((a[kept] + 0.5) / (toxic + 1)) - np.log((b[kept] + 0.5) / (clean + 1))))


def _count(sample: DataFrame) -> Counts:
    """For each lexicon entry of at least LEAST documents: documents by (fold, toxic)."""
    schema = pa.schema([("gram", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = [Counter() for _ in range(4)]
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                counted[2 * fold + toxic].update({g for w in set(_words(_composed(text))[1]) for g in grams(w)})
        for slot, counter in enumerate(counted):
            if counter:
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array([slot] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())], schema=schema)

    counts = sample.mapInArrow(releasing(run), "gram string, slot int, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)))
    counts = counts.where(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") >= LEAST).where((F.col("n1") + F.col("n3") > 0))
    return Counts(counts.orderBy(F.desc(F.col("n1") + F.col("n3")), F.desc(F.col("n0") + F.col("n2")), "gram").limit(MOST).toArrow())


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Boosting | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], np.float64).reshape(len(texts), -1)
        if self.trees is None:
            return np.where(x[:, 0] >= 2, 0.9, 0.1) if len(x) else np.zeros(0)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, toxic): what may be learned from."""
    small_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = min(1.0, sample / max(n, 1))
    picked = F.xxhash64("doc_id") <= F.lit(hash_limit(share)).cast("long")
    rows = docs.where(picked).join(labels.where(picked), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    rows = written(rows)
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "toxic").count().collect()}
    size = lambda fold, toxic: sizes.get((fold, toxic), 0)
    if min(size(f, t) for f in (0, 1) for t in (0, 1)) < 2:
        return ToxicityModel(Lexicon({}), None, None)
    counts = _count(rows)
    shared = docs.sparkSession.sparkContext.broadcast([counts.lexicon((f,), size(f, 1), size(f, 0)) for f in (0, 1)])
    schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32()), ("fold", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            x = [features(t, shared.value[1 - f]) for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], schema=schema)

    got = rows.mapInArrow(releasing(run), "x array<double>, toxic int, fold int").toArrow()
    x = np.concatenate([c.flatten().to_numpy() for c in got.column("x").chunks]).reshape(got.num_rows, -1)
    y = got.column("toxic").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order: fits must not depend on it
    x, y = x[order], y[order]
    part = np.arange(len(y)) % 3
    margin = np.empty(len(y))
    for k in range(3):
        margin[part == k] = Boosting().fit(x[part != k], y[part != k]).margin(x[part == k])
    lexicon = counts.lexicon((0, 1), size(0, 1) + size(1, 1), size(0, 0) + size(1, 0))
    model = ToxicityModel(lexicon, Boosting().fit(x, y), isotonic(margin, y))
    release()
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score and predicted, 1 from the threshold on. Narrow."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                score = shared.value.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return docs.mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores under the threshold; a null or empty text has a score too. Narrow."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                yield batch.filter(pa.array(shared.value.score(batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(releasing(run), docs.schema)


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only rows that aren't held out are learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_toxicity(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)), sample)
    return toxicity_scores(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
