"""Exact quantiles of a report's groups without a sort: narrower and narrower histograms."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def order_statistics(df: DataFrame, group: str, value: str, ranks: dict[object, set[int]]) -> dict[tuple[object, int], float]:
    """The values at the given ranks, from 0, of each group's numbers in order. Each pass counts BINS bins of what is left of every rank's
    range, by partial sums over the rows, which are never moved; a few passes leave one value."""
    numbers = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = {r["_g"]: (r["low"], r["high"]) for r in numbers.groupBy("_g").agg(F.min("_v").alias("low"), F.max("_v").alias("high")).collect()}
    found: dict[tuple[object, int], float] = {}
    open_ = {(g, r): (*ends[g], 0) for g, some in ranks.items() for r in some}
    kind = df.schema[group].dataType.simpleString()
    while open_:
        found |= {at: low for at, (low, high, _) in open_.items() if low == high}
        open_ = {at: o for at, o in open_.items() if at not in found}
        spans = sorted({(g, low, high) for (g, _), (low, high, _) in open_.items()}, key=str)
        if not spans:
            break
        table = df.sparkSession.createDataFrame(spans, f"_g {kind}, low double, high double")
        rows = numbers.join(F.broadcast(table), numbers["_g"].eqNullSafe(table["_g"])).where("_v >= low and _v <= high")
        bin_ = F.least(F.floor((F.col("_v") / BINS - F.col("low") / BINS) / (F.col("high") / BINS - F.col("low") / BINS) * BINS), F.lit(BINS - 1))
        counts = rows.groupBy(table["_g"].alias("g"), "low", "high", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b")).collect()
        by: dict[tuple, list] = {}
        for r in counts:
            by.setdefault((r["g"], r["low"], r["high"]), []).append((r["bin"], r["n"], r["a"], r["b"]))
        for (g, rank), (low, high, below) in list(open_.items()):
            for _, n, a, b in sorted(by[g, low, high]):
                if rank < below + n:
                    open_[g, rank] = (a, b, below)
                    break
                below += n
    return found


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name...): of each group's numbers the quantiles at the named shares, between two neighbours in proportion; groups are few."""
    sizes = {r[0]: r[1] for r in df.where(F.col(value).isNotNull()).groupBy(group).count().collect()}
    places = {(g, name): (n - 1) * p for g, n in sizes.items() for name, p in shares.items()}
    ranks: dict[object, set[int]] = {g: set() for g in sizes}
    for (g, _), h in places.items():
        ranks[g] |= {floor(h), ceil(h)}
    found = order_statistics(df, group, value, ranks)

    def at(g: object, name: str) -> float:
        h = places[g, name]
        low, high = found[g, floor(h)], found[g, ceil(h)]
        return low + (high - low) * (h - floor(h))

    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, *(at(g, name) for name in shares)) for g in sizes], f"`{group}` {kind}, " + ", ".join(f"`{name}` double" for name in shares))
