"""Tokens, frequencies, vocabularies, corruption, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import context, lower_words, plain_form, split_words


def flatten(df: DataFrame, words: Column, name: str = "token") -> DataFrame:
    """One row per element; rows without any vanish."""
    return df.withColumn(name, F.explode(words))


def with_context(df: DataFrame, split: str = "token_split", token: str = "token") -> DataFrame:
    before, behind = context(split_words(split), token)
    return df.withColumn("before", before).withColumn("after", behind)


def token_frequency(df: DataFrame, words: Column, freq: Column | None = None) -> DataFrame:
    return df.select(F.explode(words).alias("token"), (F.lit(1) if freq is None else freq).alias("n")).groupBy("token").agg(F.sum("n").cast("long").alias("freq"))


def word_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return token_frequency(docs, lower_words(text))


def top_tokens(frequencies: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens with their ranks; a top-k sort, not a sort of all."""
    top = frequencies.orderBy(F.desc("freq"), "token").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "token")))


def ranked(frequencies: DataFrame) -> DataFrame:
    """All tokens with their rank by frequency, then name. Two levels: counts by frequency give every frequency's first rank, and tokens of one
    frequency and hash bucket are numbered among themselves, so no task holds all tokens of the frequency 1."""
    bucket = F.substring("token", 1, 2)
    parts = frequencies.withColumn("_part", bucket)
    sizes = parts.groupBy("freq", "_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy(F.desc("freq"), "_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("freq", "_part").orderBy("token"))
    return parts.withColumn("_at", inside).join(starts.select("freq", "_part", "_start"), ["freq", "_part"]).select("token", "freq", (F.coalesce("_start", F.lit(0)) + F.col("_at")).cast("long").alias("rank"))


#: Words of a vocabulary up to which it is sent to the rows as one array.
SMALL = 100_000


def known_splits(df: DataFrame, vocabulary: DataFrame, id_col: str, words: Column) -> DataFrame:
    """The rows all of whose words are in the vocabulary. A vocabulary of SMALL words at most goes to the rows, and nothing else moves;
    a larger one meets the distinct words of the rows."""
    if vocabulary.limit(SMALL + 1).count() <= SMALL:
        known = vocabulary.agg(F.collect_set("token").alias("_known"))
        return df.join(F.broadcast(known)).where(F.size(F.array_except(words, "_known")) == 0).drop("_known")
    words_of = df.select(id_col, F.explode(F.array_distinct(words)).alias("token"))
    unknown = words_of.join(vocabulary.select("token"), "token", "left_anti").select(id_col).distinct()
    return df.join(unknown, id_col, "left_anti")


def nearest_frequent(pairs: DataFrame) -> DataFrame:
    """For each token the most frequent word within its distance 1, itself included: correction, rel = its frequency
    over the token's, and stable where that is 1. pairs: (token, freq, other, other_freq)."""
    best = pairs.groupBy("token", "freq").agg(F.max(F.struct(F.col("other_freq"), F.col("other"))).alias("best"))
    rel = F.col("best.other_freq") / F.col("freq")
    kept = F.when(F.col("best.other_freq") > F.col("freq"), F.col("best.other")).otherwise(F.col("token"))
    return best.select("token", "freq", kept.alias("correction"), F.greatest(rel, F.lit(1.0)).alias("rel"), (F.greatest(rel, F.lit(1.0)) == 1).alias("stable"))


def generator(column: Column, seed: int = 0) -> Column:
    """A linear congruential step, the same in every engine: 0 to 2**31 - 1."""
    return F.pmod((column.cast("long") + seed) * 1103515245 + 12345, F.lit(2147483648))


def corrupt(df: DataFrame, token: str = "token") -> DataFrame:
    """One edit per token, by (length + first letter's code) % 4: drop, double, swap or replace its middle letter; the old one stays in correct_token."""
    t, n = F.col(token), F.length(token)
    at = F.floor(n / 2).cast("int") + 1
    head, letter, tail = F.substring(t, F.lit(1), at - 1), F.substring(t, at, F.lit(1)), F.substring(t, at + 1, n)
    kind = F.pmod(n + F.ascii(t), F.lit(4))
    typo = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, letter, letter, tail)).when(kind == 2, F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), letter, F.substring(tail, F.lit(2), n))).otherwise(F.concat(head, F.lit("x"), tail))
    return df.withColumn("correct_token", t).withColumn(token, typo)


def _smallest(df: DataFrame, value: Column, n: int) -> tuple[int, int]:
    """(limit, ties): of the whole numbers value, 0 to 2**31 - 1, those under the limit and so many of those that are equal to it are
    the n smallest. Two counts by 2**16 buckets each; no sort and no window."""
    low = 0
    for shift in (16, 0):
        inside = F.lit(True) if shift else F.shiftright(value, 16) == low >> 16
        counts = sorted(map(tuple, df.where(inside).groupBy(F.shiftright(value, shift).alias("bucket")).count().collect()))
        for bucket, size in counts:
            if n < size:
                low = bucket << shift
                break
            n -= size
        else:
            return 2**31, 0
    return low, n


def corrupt_exactly(df: DataFrame, share: float, rank: str, token: str = "token", split: str | None = None) -> DataFrame:
    """Corrupts the int(share * n) rows with the smallest generator(rank) and leaves the others; correct_token keeps the old one. Each
    rank, a whole number, occurs once. split: a column in which each place of the token is replaced too, its old value in correct_split."""
    value = generator(F.col(rank))
    limit, ties = _smallest(df, value, int(share * df.count()))
    chosen = value < limit
    if ties:  # ranks that are 2**31 apart
        tied = [r[0] for r in df.where(value == limit).select(rank).orderBy(rank).limit(ties).collect()]
        chosen = chosen | F.col(rank).isin(tied)
    out = corrupt(df, token).withColumn(token, F.when(chosen, F.col(token)).otherwise(F.col("correct_token")))
    if split:
        out = out.withColumn("correct_split", F.col(split)).withColumn(split, F.replace(F.col(split), F.col("correct_token"), F.col(token)))
    return out


def hash_bucket(column: Column | str, digits: int = 4) -> Column:
    """The first hexadecimal digits of the column's md5 as a number: the same in every engine."""
    column = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def weighted_sample(df: DataFrame, n: int, weight: str = "freq", order: str = "token") -> DataFrame:
    """n draws with replacement, in proportion to the weight: draw k goes to the row whose range of the summed weights, in the order of
    (md5 bucket, order), holds its number. The ranges come from two levels of sums: 4 096 buckets, and windows inside a
    bucket; the draws find their bucket in an array of 4 096 starts, and their row among its rows."""
    parted = df.where(F.col(weight) > 0).withColumn("bucket", hash_bucket(order, 3))
    sizes = parted.groupBy("bucket").agg(F.sum(weight).cast("double").alias("size"))
    starts = sizes.withColumn("start", F.sum("size").over(Window.orderBy("bucket")) - F.col("size"))
    known = starts.orderBy("bucket").collect()
    total = known[-1]["start"] + known[-1]["size"] if known else 0.0
    inside = Window.partitionBy("bucket").orderBy(order, *(c for c in df.columns if c != order)).rowsBetween(Window.unboundedPreceding, 0)
    ranges = parted.join(F.broadcast(starts.select("bucket", "start")), "bucket").withColumn("high", F.col("start") + F.sum(weight).over(inside)).withColumn("low", F.col("high") - F.col(weight))
    places = F.array(*(F.struct(F.lit(r["start"]).alias("start"), F.lit(r["bucket"]).alias("bucket")) for r in known)) if known else None
    draws = df.sparkSession.range(n if known else 0).select(F.col("id").alias("draw"), F.floor(generator(F.col("id") + 1) / 2147483648.0 * total).alias("at"))
    bucket = F.array_max(F.filter(places, lambda p: p["start"] <= F.col("at")))["bucket"] if known else F.lit(None).cast("long")
    draws = draws.withColumn("bucket", bucket)
    return draws.join(ranges, "bucket").where((F.col("low") <= F.col("at")) & (F.col("at") < F.col("high"))).select("draw", *df.columns)


def hash_split(df: DataFrame, key: str, share: int = 90) -> DataFrame:
    """part: train for the keys of a fixed hash share in 100, else test; rows of one key stay together."""
    return df.withColumn("part", F.when(hash_bucket(key, 8) % 100 < share, "train").otherwise("test"))


def pick_subset(df: DataFrame, share: float, key: str, weight: str | None = None) -> DataFrame:
    """The rows whose hash is under the share, or under the share times the weight over its mean."""
    chance = F.lit(share)
    if weight:
        mean = df.agg(F.avg(weight)).first()[0] or 1.0
        chance = share * F.col(weight) / mean
    return df.where(hash_bucket(key, 8) / 4294967296.0 < chance)


def stems(pairs: DataFrame, english: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """pairs (token, freq, correction, rel, stable) with english, the token, and english_correction, and word: whether the token and
    its correction are forms of one word, by equal lemmas (lemmas: token, lemma) or by the token's plain form."""
    known = english.select("token").distinct()
    rows = pairs.join(known.withColumn("english", F.lit(True)), "token", "left").join(known.toDF("correction").withColumn("english_correction", F.lit(True)), "correction", "left")
    rows = rows.fillna(False, ["english", "english_correction"])
    same = plain_form("token") == F.col("correction")
    if lemmas is not None:
        rows = rows.join(lemmas.toDF("token", "lemma"), "token", "left").join(lemmas.toDF("correction", "correction_lemma"), "correction", "left")
        lemma, other = F.coalesce("lemma", "token"), F.coalesce("correction_lemma", "correction")
        same = same | (lemma == other) | (lemma == F.col("correction")) & (~F.col("english_correction") | F.col("correction").endswith("ing"))
    return rows.withColumn("word", ~F.col("stable") & ~F.col("english") & same).select(*pairs.columns, "english", "english_correction", "word")


def generate_vocabulary(pairs: DataFrame, english: DataFrame, stable: int, suspicious: int, other: int, lemmas: DataFrame | None = None) -> DataFrame:
    """(token, freq): the English words; the tokens and corrections that are forms of one word; and of the rest the most frequent
    tokens: `stable` without a more frequent neighbour, `suspicious` whose neighbour is English, `other` whose isn't."""
    rows = stems(pairs, english, lemmas)
    good = rows.where("word").select(F.explode(F.array("token", "correction")).alias("token")).distinct()
    rest = rows.where("not english").join(good, "token", "left_anti")

    def most(kind: Column, n: int) -> DataFrame:
        return rest.where(kind).orderBy(F.desc("freq"), "token").limit(n).select("token")

    kinds = (F.col("stable"), stable), (~F.col("stable") & F.col("english_correction"), suspicious), (~F.col("stable") & ~F.col("english_correction"), other)
    kept = rows.where("english").select("token").union(good)
    for kind in kinds:
        kept = kept.union(most(*kind))
    return pairs.select("token", "freq").join(kept.distinct(), "token", "left_semi")


def size_budget(files: DataFrame, longest_line: int, budget: int, order: str, text: str = "text") -> DataFrame:
    """The files without a line over longest_line, as long as their summed sizes keep within the budget, in order.
    The running sum has two levels: sums of buckets of the order, and windows inside a bucket."""
    fit = files.where(F.array_max(F.transform(F.split(text, "\n"), F.length)) <= longest_line).withColumn("size", F.length(text).cast("long"))
    fit = fit.withColumn("bucket", F.floor(F.col(order) / 1024))
    starts = fit.groupBy("bucket").agg(F.sum("size").alias("all"))
    starts = starts.withColumn("start", F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).where(F.col("start") <= budget).select("bucket", "start")
    running = F.col("start") + F.sum("size").over(Window.partitionBy("bucket").orderBy(order))
    return fit.join(starts, "bucket").withColumn("running", running).where(F.col("running") <= budget).drop("bucket", "start")


def enough(samples: DataFrame, key: str, least: int) -> DataFrame:
    """The samples of the keys that have at least so many: one count, and a join with the keys that stay."""
    kept = samples.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return samples.join(kept, key, "left_semi")


def size_split(files: DataFrame, key: str, size: str, share: float) -> DataFrame:
    """part: test for the files that come first by hash bucket and key until they hold the share of all sizes, else train; the file that reaches it is
    the last of the test part. Two levels of sums: 4 096 buckets, and a window inside the one in which the share is reached."""
    parted = files.withColumn("_b", hash_bucket(key, 3))
    sums = parted.groupBy("_b").agg(F.sum(size).alias("_s"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_start")
    total = files.agg(F.sum(size)).first()[0] or 0
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parted.join(F.broadcast(starts), "_b").withColumn("_before", F.col("_start") + before)
    return rows.withColumn("part", F.when(F.col("_before") < share * total, "test").otherwise("train")).drop("_b", "_start", "_before")


def overlap(a: DataFrame, b: DataFrame, column: str = "token") -> DataFrame:
    """One row: the distinct values of either side, and of both."""
    sides = a.select(column, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(column, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = sides.where(F.col(column).isNotNull()).groupBy(column).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("left"), F.coalesce(F.sum("b"), F.lit(0)).alias("right"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"))


def zipped(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """The rows of both tables side by side, within each key the first with the first and so on, as far as both go. Their other columns must
    have different names."""
    def placed(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order)))

    return placed(a, order_a).join(placed(b, order_b), [key, "_at"]).drop("_at")
