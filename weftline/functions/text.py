"""Column functions over text, tokens and vectors; all stay on the JVM but for the named UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: Column | str) -> Column:
    """The runs of text that isn't white space."""
    return F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")


def lower_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+"), F.lit(0))


def split_identifier(name: Column | str) -> Column:
    """Lower-cased parts of an identifier: delimiters, digits and changes of case divide; the last capital of a run
    belongs to the lower-case letters behind it."""
    spaced = F.regexp_replace(_col(name), "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z]+", " ")), " "), lambda w: w != "")


def rebuild_identifier(name: Column | str, old: Column | str, new: Column | str) -> Column:
    """The identifier with its parts replaced in order, each in the old part's case. old and new: arrays of equal length. An empty old part stands at
    the end: behind a delimiter the new one goes as it is, else with a capital."""
    name, old, new = _col(name), _col(old), _col(new)
    start = F.struct(F.lit("").alias("done"), name.alias("rest"))

    def step(state: Column, pair: Column) -> Column:
        none = pair["old"] == ""
        at = F.when(none, F.length(state["rest"]) + 1).otherwise(F.instr(F.lower(state["rest"]), pair["old"]))
        was = F.substring(state["rest"], at, F.length(pair["old"]))
        cased = F.when(none & (state["rest"] != ""), pair["new"]).when((was == F.upper(was)) & (was != F.lower(was)), F.upper(pair["new"])).when(F.substring(was, 1, 1) == F.upper(F.substring(was, 1, 1)), F.initcap(pair["new"])).otherwise(pair["new"])
        return F.struct(
            F.concat(state["done"], F.substring(state["rest"], F.lit(1), at - 1), cased).alias("done"),
            F.substring(state["rest"], at + F.length(pair["old"]), F.length(state["rest"])).alias("rest"),
        )

    pairs = F.zip_with(old, new, lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.aggregate(pairs, start, step, lambda s: F.concat(s["done"], s["rest"]))


def context(words: Column | str, token: Column | str) -> tuple[Column, Column]:
    """The words before and behind the token's first place, joined by spaces."""
    words, at = _col(words), F.array_position(_col(words), _col(token)).cast("int")
    before = F.when(at > 1, F.array_join(F.slice(words, F.lit(1), at - 1), " ")).otherwise("")
    behind = F.when((at > 0) & (at < F.size(words)), F.array_join(F.slice(words, at + 1, F.size(words)), " ")).otherwise("")
    return before, behind


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """The length of the longest common beginning: smaller and smaller powers of two are added while the next so many characters
    agree, so a comparison reads either text once for each power. A null text is as an empty one."""
    a, b = _col(a), _col(b)
    least = F.least(F.length(a), F.length(b))
    highest = F.floor(F.log2(F.greatest(least, F.lit(1)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2.0), e).cast("int"))

    def longer(done: Column, step: Column) -> Column:
        return F.when((done + step <= least) & (F.substring(a, done + 1, step) == F.substring(b, done + 1, step)), done + step).otherwise(done)

    return F.aggregate(steps, F.lit(0), longer)


#: The rewrites of artificial styles, as patterns and replacements.
STYLES = {
    "comma_tight": (", ", ","),
    "comma_wide": (",([^ ])", ", $1"),
    "double_to_single_quote": ('"', "'"),
    "equal_wide": ("([^ ])=([^ ])", "$1 = $2"),
    "round_tight": (r"\( | \)", "|"),
    "curly_wide": (r"\{([^ ])", "{ $1"),
    "tag_newline": ("><", ">\n<"),
    "tight_end": (r"\. ", "."),
}


def rewrite(text: Column | str, style: str) -> Column:
    return F.regexp_replace(_col(text), *STYLES[style])


def clip(value: Column, top: int = 255) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(top))


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norm)


def log_ratio(a: Column | str, b: Column | str) -> Column:
    return -F.log((_col(a) + 1e-5) / (_col(b) + 1e-5))


def once_deleted(word: Column | str) -> Column:
    """The word and all words with one letter less."""
    word = _col(word)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), shorter))


def deletes(word: Column | str, depth: int) -> Column:
    """The word and all words with up to depth letters less."""
    out = F.array(_col(word))
    for _ in range(depth):
        out = F.array_distinct(F.flatten(F.transform(out, once_deleted)))
    return out


def letter_mask(word: Column | str) -> Column:
    """The set of a word's characters as bits of a long; some characters share a bit."""
    bits = F.transform(F.split(_col(word), ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def edit_distance(a: str, b: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance (a pair of letters is swapped at most once), -1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return -1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most and min(before) > most:
            return -1
    return row[-1] if row[-1] <= most else -1


def edit_distance_udf(most: int):
    """edit_distance as an Arrow UDF of two string columns."""
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32")

    return distance


#: Two words with a mark between them, as patterns: the second is the first with a pair of neighbours swapped; with two such pairs; with one and
#: one more letter replaced, put in or left out.
_MARK = "\u0001"
_ANY, _ONE, _MANY = f"[^{_MARK}]", f"([^{_MARK}])", f"([^{_MARK}]*)"
_SWAPPED = f"^{_MANY}{_ONE}{_ONE}{_MANY}{_MARK}\\1\\3\\2\\4$"
_TWICE = "|".join([
    f"^{_MANY}{_ONE}{_ONE}{_MANY}{_ONE}{_ONE}{_MANY}{_MARK}\\1\\3\\2\\4\\6\\5\\7$",
    *(f"^{_MANY}{_ONE}{_ONE}{_MANY}{x}{_MANY}{_MARK}\\1\\3\\2\\4{y}\\5$" for x, y in ((_ANY, _ANY), ("", _ANY), (_ANY, ""))),
    *(f"^{_MANY}{x}{_MANY}{_ONE}{_ONE}{_MANY}{_MARK}\\1{y}\\2\\4\\3\\5$" for x, y in ((_ANY, _ANY), ("", _ANY), (_ANY, ""))),
])


def _numbered(pattern: str) -> str:
    """Alternatives whose back references count from their own first group, as one pattern."""
    out, groups = [], 0
    for part in pattern.split("|"):
        out.append(re.sub(r"\\(\d)", lambda m, n=groups: f"(?:\\{int(m[1]) + n})", part))
        groups += part.count("([")
    return "|".join(out)


def restricted_distance(a: Column | str, b: Column | str, letters: Column | None = None) -> Column:
    """The restricted distance of words that are at most 2 apart, else null, without a UDF: the plain one, but for swaps. letters: in how many bits the words'
    letter_mask() differ, if known; a swap changes none and another edit two at most, so that few words have to be tried for swaps."""
    a, b = _col(a), _col(b)
    both, apart = F.concat(a, F.lit(_MARK), b), F.abs(F.length(a) - F.length(b))
    letters = F.lit(0) if letters is None else letters

    def told(plain: Column) -> Column:
        swapped = (plain == 2) & (letters == 0) & (apart == 0) & both.rlike(_SWAPPED)
        # two swaps are 4 plain edits, a swap and another edit 3
        twice = (plain > 2) & (apart <= 4 - plain) & both.rlike(_numbered(_TWICE))
        return F.when((plain >= 0) & (plain <= 1), plain).when(swapped, 1).when((plain == 2) | twice, 2)

    most = F.when((letters == 0) & (apart == 0), 4).when((letters <= 2) & (apart <= 1), 3).otherwise(2)
    # an array's only element: branches that repeat an expression would take the plain distance once each; and nothing is taken of words that are
    # too far apart by what is cheap, wherever the optimizer puts this
    plain = F.get(F.transform(F.array(F.call_function("levenshtein", a, b, most)), told), F.lit(0))
    return F.when((apart <= 2) & (letters <= 4), plain).cast("int")


def one_edit(a: Column | str, b: Column | str, letters: Column | None = None) -> Column:
    """The restricted distance of words that are at most 1 apart, else null: plain expressions without a loop, each taken once. letters: as
    restricted_distance() has it."""
    a, b = _col(a), _col(b)
    swapped = (F.lit(0) if letters is None else letters) == 0
    swapped &= (F.length(a) == F.length(b)) & F.concat(a, F.lit(_MARK), b).rlike(_SWAPPED)
    return F.when(a == b, 0).when((F.levenshtein(a, b, 1) >= 0) | swapped, 1).cast("int")


def with_distance(pairs: DataFrame, a: str, b: str, depth: int, name: str = "distance", letters: Column | None = None) -> DataFrame:
    """The pairs of words a and b whose restricted distance is at most depth, with it. letters: as restricted_distance() has it."""
    if depth == 1:
        return pairs.withColumn(name, one_edit(a, b, letters)).where(F.col(name) <= depth)
    if depth == 2:
        return pairs.withColumn(name, restricted_distance(a, b, letters)).where(F.col(name) <= depth)
    near = pairs.where((F.abs(F.length(a) - F.length(b)) <= depth) & (F.levenshtein(F.col(a), F.col(b), 2 * depth) >= 0))
    return near.withColumn(name, edit_distance_udf(depth)(a, b)).where(F.col(name) >= 0)


#: What separates the words of a phrase, beside spaces. Fixed values.
PHRASE_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def phrase_words(text: Column | str) -> Column:
    """The lower-cased words of a phrase, at spaces and PHRASE_MARKS."""
    spaced = F.translate(F.lower(_col(text)), PHRASE_MARKS, " " * len(PHRASE_MARKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def plain_form(word: Column | str) -> Column:
    """A word without the last letter of -ed and -er, or without a plural s."""
    word = _col(word)
    last, two = F.right(word, F.lit(1)), F.right(word, F.lit(2))
    ends = two.isin("ed", "er") | (last == "s") & (F.substring(word, -2, 1) != "s")
    return F.when((F.length(word) > 1) & ends, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def unwrapped(token: Column | str) -> Column:
    """A quoted literal's inside; other tokens as they are."""
    token = _col(token)
    quoted = (F.length(token) >= 2) & F.left(token, F.lit(1)).isin("'", '"') & (F.left(token, F.lit(1)) == F.right(token, F.lit(1)))
    return F.when(quoted, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def merged_map(base: Column | str, own: Column | str) -> Column:
    """Both maps as one; where both have a key, the second one's value."""
    base, own = _col(base), _col(own)
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.coalesce(F.map_concat(rest, own), base, own)
