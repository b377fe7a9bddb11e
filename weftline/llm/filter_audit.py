"""How filters overlap: what each removes in every order in which they could be applied.

The subsets of the filters are a lattice; an edge (subset already applied, next filter) tells all that a step of an order does. Documents are
first counted by what they fail, then contribute to every edge (80 of five filters), and the aggregated edges are joined to the steps of
all permutations (600), which are the lattice's paths. A document is read once, in a narrow scan; what is shuffled behind it is its id, the hash
of its text and a few bits, and copies of a text are counted together before they are shuffled by it.

Defined cases: a null text is an empty one, and a null part the empty string; a row without an id has no labels and is no copy of an earlier one, and no other is
a copy of it; rows that repeat an id count each, and aren't copies of one another unless an id is smaller; labels that repeat an id count if any
of them says 1; an empty table gives no rows; texts are told apart by SHA-256; further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A filter's letter is its bit in a mask of failures, in this order; the last one is that of copies.
LETTERS = "ABCDE"
_COPY = 1 << 4
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The mask of filters A to D that a text fails: under 200 words, under half of them distinct, over 3 % capitals, or one of #$%&*|."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), F.regexp_like(text, F.lit(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters, by their labels."""
    text = F.coalesce("text", F.lit(""))
    # a row without an id joins nothing, and gets a place of its own so that many of them don't meet
    known, place = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())
    rows = documents.select(place.alias("place"), known.alias("known"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("content"), text_failures(text).alias("mask"))
    rows = rows.groupBy("place", "known", "part", "content", "mask").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("place"), F.lit(True).alias("known"))
    said = said.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = rows.join(said, ["place", "known"], "left").fillna(False, ["good", "toxic"])
    first = F.min(F.when(F.col("known"), F.struct("place", "n")))
    alike = rows.groupBy("content", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("nameless"), first.alias("first"))
    lowest = F.min("first.place").over(Window.partitionBy("content"))
    originals = F.col("nameless") + F.when(F.col("first.place") == lowest, F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - originals).alias("n")))
    told = alike.select("part", "good", "toxic", both.alias("both")).select("part", "good", "toxic", F.explode("both").alias("b"))
    return told.where("b.n > 0").groupBy("part", F.col("b.mask").alias("mask"), "good", "toxic").agg(F.sum("b.n").alias("n"))


def lattice_edges(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, subset, bit, kept, removed, ...): of each part's documents, what the filter `bit` does behind the filters of `subset`. counts:
    (part, mask, good, toxic, n)."""
    edges = [(subset, 1 << k) for subset in range(1 << len(letters)) for k in range(len(letters)) if not subset >> k & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(b).alias("bit")) for s, b in edges))).alias("edge")
    rows = counts.select("part", "mask", "good", "toxic", "n", edge).select("part", "edge.subset", "edge.bit", "mask", "good", "toxic", "n")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("subset")) > 0
    met = {
        "kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": fails & ~gone & F.col("good"), "toxic_lost": fails & ~gone & F.col("toxic"),
    }
    return rows.groupBy("part", "subset", "bit").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in met.items()))


def filter_audit(documents: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for each part, order and step."""
    orders = ["".join(p) for p in itertools.permutations(letters)]
    steps = [(o, k + 1, sum(1 << letters.index(c) for c in o[:k]), 1 << letters.index(c)) for o in orders for k, c in enumerate(o)]
    paths = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, bit int")
    rows = lattice_edges(failure_counts(documents, labels), letters).join(F.broadcast(paths), ["subset", "bit"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return rows.select("part", "filter_order", "step", *_MEASURES, shapley.alias("shapley"))
