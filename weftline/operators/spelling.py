"""Words within two edits of each other, met by hashes of their deletes in arrays.

Every word that is asked for or known is one row. A batch of rows makes the hashes of all deletes of its words at once and sends each bucket of hashes one message: the
words that have deletes there, each once, and four bytes for each delete. A bucket's task sorts its hashes, so that what is asked meets what is known, drops pairs
whose lengths or letters differ too much, and takes the restricted distance of the rest, many pairs at a time. The number of buckets follows from the
number of deletes, so that a task's memory doesn't grow with the tables. Hashes only bring words together: what is reported has been compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.streaming.store import kept

#: Deletes of a bucket; deletes that are made at once, and pairs that are compared at once.
BUCKET, MADE, PAIRS = 4_000_000, 2_000_000, 1_000_000
#: Letters of a word that are always taken.
WHOLE = 24
#: Letters that two words of distance 2 can differ in; a distance beyond all that count.
_LETTERS, _FAR = 4, 9
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_ASKED, _KNOWN, _NULL = 1, 2, 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, shuffled."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _valued(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _codes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words whose UTF-8 bytes lie one behind the other, and where each word's begin."""
    if not (data >= 128).any():
        return data, starts
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first[starts]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each one's begin."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _delete_hashes(codes: np.ndarray) -> np.ndarray:
    """Of words of one length, one a row: the hashes of each word and of all that one or two letters less leave of it, in order."""
    n, size = codes.shape
    powers = np.cumprod(np.full(max(size, 1), _BASE, np.uint64), dtype=np.uint64)[:size]
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_valued(codes) * powers, axis=1, dtype=np.uint64, out=sums[:, 1:])
    back = sums * np.uint64(_BACK)
    twice = back * np.uint64(_BACK)
    one = np.arange(size)
    i, j = np.triu_indices(size, 1)
    out = np.empty((n, 1 + size + len(i)), np.uint64)
    out[:, 0] = sums[:, size]
    out[:, 1 : 1 + size] = sums[:, one] - back[:, one + 1] + back[:, size:]
    out[:, 1 + size :] = (sums[:, :-1] - back[:, 1:])[:, i] + (back[:, :-1] - twice[:, 1:])[:, j] + twice[:, size:]
    out = _mixed(out)
    out.sort(axis=1)
    return out


def _deletes(codes: np.ndarray, starts: np.ndarray, prefix: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of all distinct deletes of the words' first letters, a bounded number of words at a time."""
    sizes = np.diff(starts)
    sizes = sizes if prefix is None else np.minimum(sizes, prefix)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        step = max(1, MADE // (1 + size + size * (size - 1) // 2))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            found = _delete_hashes(codes[starts[some][:, None] + np.arange(size)])
            new = np.ones(found.shape, bool)
            new[:, 1:] = found[:, 1:] != found[:, :-1]
            yield np.repeat(some.astype(np.int32), new.sum(1)), found[new]


def _messages(words: DataFrame, prefix: int | None, labels: list[int]) -> DataFrame:
    """(label, text, sizes, flags, counts, n, hashes): what each batch of words has for each bucket."""
    buckets = len(labels)
    named = np.array(labels, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = _bytes(batch.column("word"))
            flags, counts = batch.column("flags").to_numpy().astype(np.uint8), batch.column("count").to_numpy()
            made = list(_deletes(*_codes(data, at), prefix))
            word, hashes = (np.concatenate(x) for x in zip(*made, strict=True))
            bucket = _bucket(hashes, buckets)
            low = hashes.astype(np.uint32)
            # a bucket's deletes word by word
            order = np.lexsort((word, bucket)) if buckets > 65535 else np.argsort(word, kind="stable")
            if buckets <= 65535:
                order = order[np.argsort(bucket[order].astype(np.uint16), kind="stable")]
            word, low, ends = word[order], low[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                mine = word[ends[b] : ends[b + 1]]
                if not len(mine):
                    continue
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                w, n = mine[first], np.diff(np.append(first, len(mine)))
                sizes = (at[w + 1] - at[w]).astype(np.int32)
                text = data[np.repeat(at[w] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                parts = [text, sizes, flags[w], counts[w], n.astype(np.int32), low[ends[b] : ends[b + 1]]]
                yield pa.RecordBatch.from_arrays([pa.array(named[b : b + 1]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["label", "text", "sizes", "flags", "counts", "n", "hashes"])

    return words.mapInArrow(run, "label int, text binary, sizes binary, flags binary, counts binary, n binary, hashes binary")


def _letters(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sets of the words' characters as bits; some characters share a bit."""
    out = np.zeros(len(starts) - 1, np.uint64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.bitwise_or.reduceat(np.uint64(1) << (codes & 63).astype(np.uint64), starts[some])
    return out


def distances(codes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The restricted Damerau-Levenshtein distances of words a and b, where at most 2; else more. The lengths differ by 2 at most."""
    sizes = np.diff(starts)
    out = np.full(len(a), _FAR, np.uint8)
    longest = np.maximum(sizes[a], sizes[b])
    top = 8
    while len(a) and top // 2 < max(longest.max(), 8):
        own = np.flatnonzero((longest <= top) & ((longest > top // 2) | (top == 8)))
        step = max(1, 16 * 32768 // top)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            out[some] = _banded(codes, starts[a[some]], starts[b[some]], sizes[a[some]], sizes[b[some]])
        top *= 2
    return out


def _banded(codes: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The five diagonals of the table of distances, row by row, for all pairs at once. a, b: where the words begin; m, n: their lengths. What lies behind a
    word is read, too, but has no part in the cell that is taken."""
    count, rows, last = len(a), int(m.max(initial=0)), max(len(codes) - 1, 0)
    far = np.full(count, _FAR, np.uint8)
    out = far.copy()
    before, row, alike = [far] * 5, [far, far, *(np.full(count, s, np.uint8) for s in range(3))], [np.zeros(count, bool)] * 5
    letters = [codes[np.minimum(b + j, last)] for j in range(min(2, rows + 2))] if len(codes) else []

    def take(i: int) -> None:
        own = np.flatnonzero(m == i)
        if len(own):
            out[own] = np.stack([r[own] for r in row])[(n - m)[own] + 2, np.arange(len(own))]

    take(0)
    for i in range(1, rows + 1):
        x = codes[np.minimum(a + i - 1, last)]
        letters.append(codes[np.minimum(b + i + 1, last)])
        two, before, was, row, alike = before, row, alike, [], []
        for s in range(-2, 3):
            j = i + s
            if j < 0:
                row.append(far)
                alike.append(was[0] & False)
                continue
            if j == 0:
                row.append(np.full(count, min(i, _FAR), np.uint8))
                alike.append(was[0] & False)
                continue
            same = x == letters[j - 1]
            alike.append(same)
            best = before[s + 2] + ~same
            if s < 2:
                best = np.minimum(best, before[s + 3] + 1)
            if s > -2:
                best = np.minimum(best, row[-1] + 1)
            if -2 < s < 2 and i > 1 and j > 1:
                best = np.where(alike[s + 1] & was[s + 3], np.minimum(best, two[s + 2] + 1), best)
            row.append(np.minimum(best, _FAR))
        take(i)
    return out


class _Ends:
    """What words of a bucket have in common at both ends, and the hash of that."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, prefix: int | None):
        self.codes, self.starts, sizes = codes, starts, np.diff(starts)
        self.sizes = (sizes if prefix is None else np.minimum(sizes, prefix)).astype(np.int32)
        place = np.arange(len(codes)) - np.repeat(starts[:-1], sizes)
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), _BASE, np.uint64), dtype=np.uint64)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_valued(codes) * powers[place], dtype=np.uint64, out=self.sums[1:])

    def elsewhere(self, a: np.ndarray, b: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
        """Whether words a and b differ in a middle of two letters at most, and what is left without it is a delete of another bucket: they are met there, and
        nearly everywhere, as one edit leaves them a delete for each other letter."""
        x, y, m, n = self.starts[a], self.starts[b], self.sizes[a], self.sizes[b]
        least, last = np.minimum(m, n), max(len(self.codes) - 1, 0)
        head, tail = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        alike = np.ones(len(a), bool)
        for i in range(int(least.max(initial=0))):
            alike &= (self.codes[np.minimum(x + i, last)] == self.codes[np.minimum(y + i, last)]) & (i < least)
            head += alike
        alike[:] = True
        for i in range(int((least - head).max(initial=0))):
            alike &= (self.codes[x + m - 1 - np.minimum(i, m - 1)] == self.codes[y + n - 1 - np.minimum(i, n - 1)]) & (i < least - head)
            tail += alike
        middle = m - head - tail
        narrow = (middle <= 2) & (n - head - tail <= 2)
        back = np.array([1, _BACK, _BACK * _BACK % 2**64], np.uint64)[np.minimum(middle, 2)]
        left = self.sums[x + head] - self.sums[x] + (self.sums[x + m] - self.sums[x + m - tail]) * back
        return narrow & (_bucket(_mixed(left), buckets) != bucket)


def _met(parts: list[dict[str, np.ndarray]], prefix: int | None, bucket: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a bucket: parts are its messages."""
    text, sizes, flags, counts, n, hashes = (np.concatenate([p[c] for p in parts]) for c in ("text", "sizes", "flags", "counts", "n", "hashes"))
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    codes, starts = _codes(text, ends)
    letters, length = _letters(codes, starts), np.diff(starts).astype(np.int32)
    outside = _Ends(codes, starts, prefix)
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(text))
    numbers = pa.array(counts, mask=(flags & _NULL) > 0)
    both = (hashes.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(n), dtype=np.uint64), n)
    del hashes, n, parts
    both.sort()
    high = (both >> np.uint64(32)).astype(np.uint32)
    same = high[1:] == high[:-1]
    shared = np.zeros(len(both), bool)  # most deletes are one word's
    shared[1:] = same
    shared[:-1] |= same
    both, high = both[shared], high[shared]
    word = both.astype(np.uint32).astype(np.int32)
    known, asked = (flags[word] & _KNOWN) > 0, (flags[word] & _ASKED) > 0
    term, key = word[known], high[known]
    query, wanted = word[asked], high[asked]
    first = np.searchsorted(key, wanted, "left")
    much = np.searchsorted(key, wanted, "right") - first
    del both, high, word, known, asked, key, wanted
    # a word's deletes one behind the other, so that it meets another word once here, however many they share
    some = np.flatnonzero(much)
    some = some[np.argsort(query[some], kind="stable")]
    query, first, much = query[some], first[some], much[some]
    total = np.cumsum(much)
    at = 0
    while at < len(query):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * PAIRS, "right")))
        if end < len(query):  # to a word's end, if it began here
            begin = int(np.searchsorted(query, query[end - 1], "left"))
            end = begin if begin > at else end
        m = much[at:end]
        a = np.repeat(query[at:end], m)
        b = term[np.repeat(first[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        at = end
        near = (a != b) & (np.abs(length[a] - length[b]) <= 2) & (np.bitwise_count(letters[a] ^ letters[b]) <= _LETTERS)
        pairs = (a[near].astype(np.int64) << 32) | b[near]
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        a, b = (pairs >> 32).astype(np.int32), pairs.astype(np.uint32).astype(np.int32)
        here = np.concatenate([~outside.elsewhere(a[k : k + 32768], b[k : k + 32768], bucket, buckets) for k in range(0, len(a), 32768)] or [np.zeros(0, bool)])
        a, b = a[here], b[here]
        distance = distances(codes, starts, a, b)
        near = (distance > 0) & (distance <= 2)  # a word itself isn't met but in its own row
        a, b, distance = a[near], b[near], distance[near]
        for k in range(0, len(a), 100_000):
            x, y = pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])
            yield pa.RecordBatch.from_arrays([words.take(x).cast(pa.string()), words.take(y).cast(pa.string()), numbers.take(y), pa.array(distance[k : k + 100_000].astype(np.int32))], names=["query", "term", "count", "distance"])


_KINDS = {"text": np.uint8, "sizes": np.int32, "flags": np.uint8, "counts": np.int64, "n": np.int32, "hashes": np.uint32}


def near_words(queries: DataFrame, dictionary: DataFrame, tasks: int, prefix: int | None = None) -> DataFrame:
    """(query, term, count, distance): the words of a dictionary (term, count) within the restricted distance 2 of each query. prefix: of longer words only the deletes of
    so many first letters are made, but of WHOLE letters at least, as more words meet then and all meet more often. A job, which counts deletes, runs while this is called."""
    prefix = None if prefix is None else max(prefix, WHOLE)
    spark, kind = dictionary.sparkSession, dictionary.schema["count"].dataType
    asked = queries.where("query is not null").select(F.col("query").alias("word"), F.lit(True).alias("asked")).distinct()
    known = dictionary.where("term is not null").select(F.col("term").alias("word"), "count", F.lit(True).alias("known")).distinct()
    flags = F.when(F.col("asked"), _ASKED).otherwise(0) + F.when(F.col("known"), _KNOWN).otherwise(0) + F.when(F.col("count").isNull(), _NULL).otherwise(0)
    words = kept(asked.join(known, "word", "full").select("word", flags.cast("int").alias("flags"), F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("count")))
    size = F.length("word") if prefix is None else F.least(F.length("word"), F.lit(prefix))
    made = words.agg(F.sum(1 + size + size * (size - 1) / 2)).first()[0] or 0
    buckets = max(tasks, -(-int(made) // BUCKET))
    # one number for each task, which Spark deals to it
    dealt = spark.range(64 * buckets).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(buckets)).alias("task")).groupBy("task").agg(F.min("label"))
    labels = sorted(r[1] for r in dealt.collect())
    places = {label: at for at, label in enumerate(labels)}
    messages = _messages(words.repartition(max(tasks, buckets)), prefix, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["label"] != label:
                    yield from _met(parts, prefix, places[label], buckets)
                    parts = []
                label = row["label"]
                parts.append({c: np.frombuffer(row[c], kind) for c, kind in _KINDS.items()})
        if parts:
            yield from _met(parts, prefix, places[label], buckets)

    found = messages.repartition(buckets, "label").sortWithinPartitions("label").mapInArrow(run, "query string, term string, count long, distance int").distinct()
    own = words.where(F.col("flags").bitwiseAND(_ASKED | _KNOWN) == (_ASKED | _KNOWN))
    count = F.when(F.col("flags").bitwiseAND(_NULL) == 0, F.col("count"))
    own = own.select(F.col("word").alias("query"), F.col("word").alias("term"), count.alias("count"), F.lit(0).alias("distance"))
    return found.unionByName(own).withColumn("count", F.col("count").cast(kind))
