"""Fuzzy lookup, vectors, candidates and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import cosine_distance
from weftline.operators import fuzzy, pipelines, vocabulary
from weftline.plans.registry import query
from weftline.plans.texts import TOKENS_SQL
from weftline.sources.tables import table
from weftline.streaming.store import kept

_TOP_SQL = f"SELECT token AS term, freq AS count FROM ({TOKENS_SQL})"
_DELETES = "list_distinct(list_concat([{0}], list_transform(range(1, length({0}) + 1), lambda k: {0}[1:k - 1] || {0}[k + 1:])))"
_NEAR = f"""WITH t AS ({_TOP_SQL}), e AS (SELECT term, count, unnest({_DELETES.format('term')}) AS del FROM t),
 f AS (SELECT DISTINCT a.term AS query, b.term AS term, b.count AS count, a.count AS query_count FROM e a JOIN e b USING (del)),
 near AS (SELECT query, term, count, query_count, damerau_levenshtein(query, term) AS distance FROM f WHERE damerau_levenshtein(query, term) <= 1)"""


def dictionary(spark, d, threshold=1):
    """All words of the documents with enough occurrences."""
    return fuzzy.build_dictionary(vocabulary.word_frequency(table(spark, d, "documents")).select(F.col("token").alias("term"), F.col("freq").alias("count")), threshold)


def near(words):
    """The words of a dictionary within distance 1 of each of them."""
    return fuzzy.fuzzy_join(words.select(F.col("term").alias("query")), words.select("term", "count"))


def counted(spark, d):
    """The dictionary, written to the shared folder: both sides of a fuzzy join read it, and the texts are read and counted once."""
    return kept(dictionary(spark, d))


@query(f"SELECT term, count, unnest({_DELETES.format('term')}) AS delete FROM ({_TOP_SQL})")
def deletes_index(spark, d):
    return fuzzy.deletes_index(dictionary(spark, d).select("term", "count"))


@query(f"{_NEAR} SELECT query, term, count, CAST(distance AS INTEGER) AS distance FROM near")
def fuzzy_join_k1(spark, d):
    return near(counted(spark, d))


_CUT = "coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, least(length({a}), length({b})))"


def restricted(a: str, b: str, k: str) -> str:
    """The restricted distance up to 2 of two SQL columns, else null; k: the column of their common beginning's length."""
    def near(i: int, j: int) -> str:
        return f"damerau_levenshtein({a}[{k} + {i}:], {b}[{k} + {j}:]) <= 1"

    swapped = f"({a}[{k} + 1] = {b}[{k} + 2] AND {a}[{k} + 2] = {b}[{k} + 1] AND {near(3, 3)})"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN damerau_levenshtein({a}, {b}) = 1 THEN 1 WHEN {near(2, 2)} OR {near(2, 1)} OR {near(1, 2)} OR {swapped} THEN 2 END"


_DELETES_2 = f"list_distinct(flatten(list_transform({_DELETES.format('term')}, lambda w: {_DELETES.format('w')})))"


#: The first letters of a word whose deletes are indexed where two edits are allowed; those by which all words meet: with 7 letters, ten times as
#: many pairs meet as with whole words (204 075 words: 278 and 29 million), for little more than half as many rows of the index.
PREFIX, MEET = 7, 11


@query(f"""WITH t AS ({_TOP_SQL}), e AS (SELECT term, count, unnest({_DELETES_2}) AS del FROM t), p AS (SELECT DISTINCT a.term AS query, b.term AS term, b.count AS count FROM e a JOIN e b USING (del) WHERE abs(length(a.term) - length(b.term)) <= 2),
 k AS (SELECT *, {_CUT.format(a="query", b="term")} AS k FROM p WHERE damerau_levenshtein(query, term) <= 2), r AS (SELECT query, term, count, {restricted("query", "term", "k")} AS distance FROM k)
SELECT query, term, count, CAST(distance AS INTEGER) AS distance FROM r WHERE distance IS NOT NULL""")
def fuzzy_join_k2(spark, d):
    """All words against all words, by the deletes of their first letters; the SQL takes those of whole words."""
    words = counted(spark, d)
    return fuzzy.fuzzy_join(words.select(F.col("term").alias("query")), words, 2, MEET)


@query(f"SELECT length(term) AS size, count(*) AS words, CAST(sum(len({_DELETES_2.replace('term', 'term[:7]')}) + CASE WHEN length(term) <= 2 AND NOT list_contains({_DELETES_2.replace('term', 'term[:7]')}, '') THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM ({_TOP_SQL}) GROUP BY length(term)")
def prefix_index_size(spark, d):
    """How many words of each length there are, and how many rows they have in the index of the deletes of first letters."""
    index = fuzzy.deletes_index(dictionary(spark, d), 2, PREFIX)
    return index.groupBy(F.length("term").alias("size")).agg(F.count_distinct("term").alias("words"), F.count("*").alias("rows"))


@query("""WITH b AS (SELECT token AS term, doc_id % 3 AS part, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER (PARTITION BY term ORDER BY part) AS total FROM b)
SELECT term, CAST(sum(n) AS BIGINT) AS count, sum(n) >= 5 AS known, CAST(min(CASE WHEN total >= 5 THEN part END) AS INTEGER) AS entered FROM c GROUP BY term""")
def staged_dictionary(spark, d):
    """A dictionary built in three batches of documents: a word enters in the batch in which its fifth occurrence comes, until then it is staged."""
    docs = table(spark, d, "documents")
    state = None
    for part in range(3):
        words = vocabulary.word_frequency(docs.where(F.col("doc_id") % 3 == part)).select(F.col("token").alias("term"), F.col("freq").alias("count"))
        after = fuzzy.add_words(state, words, 5)
        entered = F.when(F.col("enters"), F.lit(part))
        before = F.lit(None).cast("int")
        if state is not None:
            after, before = after.join(state.select("term", F.col("entered").alias("earlier")), "term", "left"), F.col("earlier")
        state = after.select("term", "count", "known", F.coalesce(before, entered).alias("entered"))
    return state


for _level, _name in ((0, "lookup_top"), (1, "lookup_closest"), (2, "lookup_all")):
    _pick = {
        0: "SELECT query, term, CAST(distance AS INTEGER) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, count DESC, term) = 1",
        1: "SELECT query, term, CAST(distance AS INTEGER) AS distance FROM near QUALIFY distance = min(distance) OVER (PARTITION BY query)",
        2: "SELECT query, term, CAST(distance AS INTEGER) AS distance FROM near",
    }[_level]

    def _lookup(spark, d, level=_level):
        return fuzzy.best_terms(near(counted(spark, d)), level).select("query", "term", "distance")

    _lookup.__name__ = _name
    query(f"{_NEAR} {_pick}")(_lookup)


@query(f"{_NEAR} SELECT query, term, CAST(distance AS INTEGER) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY query, distance ORDER BY count DESC, term) <= 4")
def top_m_per_distance(spark, d):
    return fuzzy.most_per_distance(near(counted(spark, d)), 4).select("query", "term", "distance")


@query()
def lookup_compound(spark, d):
    """The first two words of every part's name, by turns run together, with a letter less, cut at another place and as they are, corrected by the
    names' words; held against a plain program in the tests."""
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    words = vocabulary.token_frequency(parts, F.col("w")).select(F.col("token").alias("term"), F.col("freq").alias("count"))
    a, b = F.col("w")[0], F.col("w")[1]
    forms = F.concat(a, b), F.concat(F.substring(a, F.lit(2), F.length(a)), F.lit(" "), b), F.concat(F.left(a, F.lit(3)), F.lit(" "), F.substring(a, F.lit(4), F.length(a)), F.lit(" "), b), F.concat(a, F.lit(" "), b)
    phrase = F.coalesce(*(F.when(F.col("p_partkey") % 4 == k, f) for k, f in enumerate(forms)))
    return fuzzy.compound(parts.select(phrase.alias("phrase")), words)


@query(f"""{_NEAR}, best AS (SELECT query AS token, query_count AS freq, arg_max(term, struct_pack(c := count, t := term)) AS term, max(count) AS top FROM near GROUP BY query, query_count)
SELECT token, freq, CASE WHEN top > freq THEN term ELSE token END AS correction, round(greatest(top / freq, 1.0), 9) AS rel, greatest(top / freq, 1.0) = 1 AS stable FROM best""")
def vocabulary_stable_unstable(spark, d):
    found = pipelines.corrections(kept(vocabulary.word_frequency(table(spark, d, "documents"))))
    return found.withColumn("rel", F.round("rel", 9))


_BEST = f"""{_NEAR}, b AS (SELECT query AS token, query_count AS freq, arg_max(term, struct_pack(c := count, t := term)) AS term, max(count) AS top FROM near GROUP BY query, query_count),
 c AS (SELECT token, freq, CASE WHEN top > freq THEN term ELSE token END AS correction, greatest(top / freq, 1.0) = 1 AS stable FROM b),
 eng AS (SELECT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents WHERE lang = 'en') GROUP BY token HAVING count(*) >= 5),
 s AS (SELECT *, token IN (SELECT token FROM eng) AS english, correction IN (SELECT token FROM eng) AS english_correction,
  CASE WHEN length(token) > 1 AND (token[-2:] IN ('ed', 'er') OR token[-1:] = 's' AND token[-2:-2] <> 's') THEN token[:-2] ELSE token END AS plain FROM c),
 w AS (SELECT *, NOT stable AND NOT english AND plain = correction AS word FROM s), g AS (SELECT token FROM w WHERE word UNION SELECT correction FROM w WHERE word),
 r AS (SELECT * FROM w WHERE NOT english AND token NOT IN (SELECT token FROM g))"""


def english_words(spark, d):
    """The words that occur five times in English documents."""
    return vocabulary.word_frequency(table(spark, d, "documents").where("lang = 'en'")).where("freq >= 5").select("token")


@query(f"""{_BEST} SELECT token, freq FROM c WHERE token IN (SELECT token FROM eng UNION SELECT token FROM g UNION (SELECT token FROM r WHERE stable ORDER BY freq DESC, token LIMIT 1000)
 UNION (SELECT token FROM r WHERE NOT stable AND english_correction ORDER BY freq DESC, token LIMIT 500) UNION (SELECT token FROM r WHERE NOT stable AND NOT english_correction ORDER BY freq DESC, token LIMIT 500))""")
def generated_vocabulary(spark, d):
    """The English words, forms of one word, and the most frequent of the other tokens by kind."""
    pairs = kept(pipelines.corrections(kept(vocabulary.word_frequency(table(spark, d, "documents")))))
    return vocabulary.generate_vocabulary(pairs, kept(english_words(spark, d)), 1000, 500, 500)


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"""WITH v AS ({_VECTORS}), p AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, round(1 - list_cosine_similarity(q.v, r.v), 9) AS distance FROM v q JOIN v r ON q.vec_id % 25 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 5""")
def cosine_knn(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return fuzzy.nearest(rows.where("vec_id % 25 = 0"), rows, 5).withColumn("distance", F.round("distance", 6))


@query("""WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, i - 1 AS i, round(sum(CAST(x AS DOUBLE)), 5) AS s FROM e GROUP BY label, i""")
def compound_vector(spark, d):
    """The sum of the vectors of each label, by dimension."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return long.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("s"))


@query(f"""WITH v AS ({_VECTORS}), p AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM v a JOIN v b ON b.vec_id BETWEEN a.vec_id - 2 AND a.vec_id + 2 AND a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(dist), 6) AS mean, round(least(min(dist), 2.0), 6) AS least FROM p GROUP BY vec_id""")
def context_cosine(spark, d):
    """The mean and the least cosine distance to the two vectors on either side."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    around = v.select("vec_id", "embedding", F.explode(F.array(*(F.col("vec_id") + k for k in (-2, -1, 1, 2)))).alias("other"))
    pairs = around.join(v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e")), "other")
    dist = cosine_distance("embedding", "e")
    return pairs.groupBy("vec_id").agg(F.round(F.avg(dist), 6).alias("mean"), F.round(F.least(F.min(dist), F.lit(2.0)), 6).alias("least"))


@query(f"""{_NEAR} SELECT query, term, CAST(distance AS INTEGER) AS distance, query_count AS query_freq, count AS term_freq, round(0.0 - ln((query_count + 1e-5) / (count + 1e-5)), 9) AS log_ratio, length(query) = length(term) AS same_length FROM near""")
def frequency_features(spark, d):
    words = counted(spark, d)
    found = fuzzy.candidate_features(near(words).select("query", "term", "distance"), words.select(F.col("term").alias("token"), F.col("count").alias("freq")))
    return found.withColumn("log_ratio", F.round("log_ratio", 9))


_CAND = f"""{_NEAR}, cand AS (SELECT query AS id, query AS token, term AS candidate, round(count / (1 + 99 * distance) / max(count) OVER (), 9) AS proba FROM near),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY proba DESC, candidate) AS rank, first_value(candidate) OVER (PARTITION BY id ORDER BY proba DESC, candidate) AS best FROM cand)"""


def candidates(spark, d):
    words = counted(spark, d)
    found, top = near(words), words.agg(F.max("count").alias("top"))  # every word is near to itself
    p = F.round(F.col("count") / (1 + 99 * F.col("distance")) / F.col("top"), 9)
    return found.join(F.broadcast(top)).select(F.col("query").alias("id"), F.col("query").alias("token"), F.col("term").alias("candidate"), p.alias("proba"))


@query(f"""{_CAND} SELECT id, candidate, proba, CAST(rank AS INTEGER) AS rank FROM ranked WHERE best <> token AND rank <= 3 UNION ALL SELECT id, candidate, 1.0, 1 FROM ranked WHERE best = token AND rank = 1""")
def rank_candidates(spark, d):
    return fuzzy.rank_candidates(candidates(spark, d), 3).select("id", "candidate", "proba", "rank")


@query(f"""{_CAND}, ended AS (SELECT *, coalesce(bool_or(proba < 0.0005 OR candidate = token) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM ranked)
SELECT id, candidate, proba FROM ended WHERE NOT over AND proba >= 0.0005""")
def suggestion_take_while(spark, d):
    ranked = candidates(spark, d).withColumn("rank", F.expr("row_number() over (partition by id order by proba desc, candidate)"))
    return fuzzy.take_confident(ranked, 0.0005).select("id", "candidate", "proba")


@query(f"{_CAND} SELECT id, candidate, round(proba / nullif(sum(proba) OVER (PARTITION BY id), 0), 9) AS share FROM cand")
def normalise_confidence(spark, d):
    return fuzzy.normalised(candidates(spark, d)).select("id", "candidate", F.round("share", 9).alias("share"))


#: Candidates of every place of every order: its lines, likelier by quantity. Equal ones are told apart by their text.
_PARTS = "SELECT DISTINCT l_orderkey AS id, l_linenumber AS place, l_returnflag || l_suppkey AS candidate, l_quantity / 64.0 AS proba FROM lineitem WHERE l_linenumber <= 2"


@query(f"""WITH p AS ({_PARTS}), a AS (SELECT * FROM p WHERE place = 1), b AS (SELECT * FROM p WHERE place = 2), n AS (SELECT id FROM p GROUP BY id HAVING count(DISTINCT place) = 1),
 c AS (SELECT a.id, a.candidate || ' ' || b.candidate AS text, a.proba * b.proba AS proba FROM a JOIN b ON a.id = b.id UNION ALL SELECT p.id, candidate, proba FROM p JOIN n ON p.id = n.id)
SELECT id, text, round(proba, 9) AS proba FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY proba DESC, text) <= 2""")
def identifier_product(spark, d):
    """The two likeliest combinations of the candidates of the first two places of each order."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2")
    parts = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.concat("l_returnflag", "l_suppkey").alias("candidate"), (F.col("l_quantity") / 64.0).alias("proba")).distinct()
    return fuzzy.combinations(parts, 2).withColumn("proba", F.round("proba", 9))
