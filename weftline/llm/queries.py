"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, per document."""
    import public_tokenizers

    from weftline.llm.bpe import bpe_encode

    return bpe_encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that start earlier."""
    from weftline.llm.suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from weftline.llm.pii_crf import find_personal_data

    return find_personal_data(_documents(spark, sf_dir))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from weftline.llm.wrapper import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    from weftline.llm.decontaminate import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from weftline.llm.langid import identify

    return identify(_documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-mixing log10 probabilities of every document."""
    from weftline.llm.lm_mixing import score_texts

    return score_texts(_documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and the components of 80 % similarity, per document."""
    from weftline.llm.jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every fiftieth vector."""
    from weftline.llm.topk_search import exact_top_k

    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity scores of every document."""
    from weftline.llm.toxicity import score_documents

    return score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    from weftline.llm.filter_audit import filter_audit

    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what formatted conversations give back; among them one whose texts hold the template's own marks."""
    from weftline.llm.chat_format import chat_digests, format_chats

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat_digests(format_chats(turns.unionByName(marked)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh has another's label."""
    from weftline.llm.hard_negatives import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (SELECT {key}, regexp_extract_all({_LOWER}, '[^ \t-\r]+') AS w FROM {table}) WHERE len(w) > 0)"""


ORACLES = {
    "op5_decontaminate": f"""WITH d AS ({_shingles_sql("documents", "doc_id")}),
  b AS ({_shingles_sql("benchmark", "item_id")}),
  n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
  m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item""",
    "op8_jaccard_join": f"""WITH RECURSIVE d AS ({_shingles_sql("documents", "doc_id")}),
  n AS (SELECT doc_id, count(*) AS n_shingles FROM d GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM d AS x JOIN d AS y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
  links AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
  reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op9_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}

ORACLES["op11_filter_audit"] = r"""WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
  f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
  n AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
  c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM c AS a, c AS b, c AS x, c AS y, c AS z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
  s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS mine, list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
  r AS (SELECT part, filter_order, step, mine, n, good, toxic, fails[mine] AS fails, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS one FROM n, s),
  m AS (SELECT part, filter_order, step, mine, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND one THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM m"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</', '<\/')"
ORACLES["op12_chat_format"] = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
  o AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  p AS (SELECT *, CASE WHEN opens THEN '### ' || replace({_ESCAPED.format('role')}, ':' || chr(10), ':\' || chr(10)) || ':' || chr(10) ELSE '</part>' END || {_ESCAPED.format('text')} || CASE WHEN opens THEN '</turn>' || chr(10) ELSE '' END AS piece FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars, count(*) FILTER (opens) AS n_blocks FROM p GROUP BY conv_id"""

ORACLES["op13_hard_negatives"] = """WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.k AS a, a.vec_id AS anchor_id, c.k AS c, c.vec_id AS vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_codec": op1_bpe_codec,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_pii": op3_pii,
        "op4_main_text": op4_main_text,
        "op5_decontaminate": op5_decontaminate,
        "op6_language_id": op6_language_id,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_topk_search": op9_topk_search,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_chat_format": op12_chat_format,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
