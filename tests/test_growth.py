"""Plans that must not bring to the driver what grows with the input."""

import io
from contextlib import redirect_stdout

import pytest

from tests.conftest import DATA
from weftline import catalog


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["span_cover_join", "span_exact_join", "span_overlap_join", "line_fixes", "lexer_roundtrip"])
def test_tokens_are_not_broadcast(spark, name):
    found = plan(catalog.queries()[name](spark, DATA))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def test_hardly_more_words_meet_by_first_letters_than_by_whole_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.operators import fuzzy
    from weftline.plans import dictionary

    asked, join = [], fuzzy.fuzzy_join
    monkeypatch.setattr(fuzzy, "fuzzy_join", lambda *args: asked.append(args[3]) or join(*args))
    catalog.queries()["fuzzy_join_k2"](spark, DATA)

    def pairs(prefix):
        return fuzzy.deletes_index(dictionary.dictionary(spark, DATA), 2, prefix).groupBy("delete").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert pairs(asked[0]) < 1.5 * pairs(None)


def test_a_word_meets_itself_once_and_words_are_counted_once(spark):
    """The candidates' plan neither reads the texts again nor joins the words twice."""
    from weftline.operators import fuzzy
    from weftline.plans import dictionary

    words = spark.createDataFrame([("abcdefghij" * 3, 5), ("zyxwvuts", 4), ("zyxwvust", 3), ("q", 2), ("", 1)], "term string, count long")
    found = fuzzy.fuzzy_join(words.selectExpr("term AS query"), words)
    assert sorted((r["query"][:8], r.term[:8], r.distance) for r in found.collect()) == sorted([("abcdefgh", "abcdefgh", 0), ("zyxwvuts", "zyxwvuts", 0), ("zyxwvuts", "zyxwvust", 1), ("zyxwvust", "zyxwvust", 0), ("zyxwvust", "zyxwvuts", 1), ("q", "q", 0), ("", "", 0), ("q", "", 1), ("", "q", 1)])
    text = plan(dictionary.candidates(spark, DATA))
    assert "documents.parquet" not in text and text.count("SortMergeJoin") == 1


def test_composites_shuffle_one_number_a_token(spark):
    """Neither the texts nor the classes' names of tokens are shuffled, sorted and collected."""
    from weftline.operators import labels

    pages = spark.createDataFrame([(1, 'a \n"" b'), (2, ""), (3, None), (4, '" \n\n'), (5, " ")], "page_id long, html string")
    found = labels.composites(labels.lex(pages, "page_id", "html"), "page_id")
    assert sorted((r.page_id, r["first"], r.label) for r in found.collect()) == [(1, 1, "space+newline"), (1, 3, "quote"), (1, 4, "quote"), (1, 5, "space"), (4, 0, "quote"), (4, 1, "space+newline"), (5, 0, "space")]
    assert "collect_list(struct" not in plan(found) and "collect_list(pos" in plan(found)
