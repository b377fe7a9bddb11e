"""Tokens, identifiers, vocabularies, files and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import STYLES, common_prefix, context, lower_words, merged_map, rebuild_identifier, rewrite, split_identifier, split_words
from weftline.operators import metrics, vocabulary
from weftline.operators.quantiles import quantiles
from weftline.plans.registry import query
from weftline.sources.tables import embedded_json, pipe_table, table

WORDS_SQL = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents"
TOKENS_SQL = f"SELECT token, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY token"
SPLIT_SQL = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z]+', ' ', 'g')), ' '), lambda w: w <> '')"


def identifiers(spark, d):
    """(id, name): part names as camelCase or snake_case, by turns, with the brand in front of it."""
    words = F.split("p_name", " ")
    camel = F.concat(words[0], F.initcap(words[1]), F.upper(F.substring("p_type", 1, 3)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("_", words[0], words[1], "p_brand")).otherwise(camel).alias("name"))


IDENT_SQL = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat_ws('_', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand)
  ELSE split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || upper(p_type[1:3]) END AS name FROM part"""


@query(TOKENS_SQL)
def token_frequency(spark, d):
    return vocabulary.word_frequency(table(spark, d, "documents"))


@query(f"SELECT id, name, array_to_string({SPLIT_SQL.format('name')}, ' ') AS parts FROM ({IDENT_SQL})")
def identifier_split(spark, d):
    return identifiers(spark, d).withColumn("parts", F.array_join(split_identifier("name"), " "))


@query(f"SELECT id, unnest({SPLIT_SQL.format('name')}) AS token FROM ({IDENT_SQL})")
def explode_splits(spark, d):
    return vocabulary.flatten(identifiers(spark, d), split_identifier("name")).select("id", "token")


@query(f"""WITH s AS (SELECT id, {SPLIT_SQL.format('name')} AS w FROM ({IDENT_SQL})), t AS (SELECT DISTINCT id, w, unnest(w) AS token FROM s)
SELECT id, token, array_to_string(w[1:list_position(w, token) - 1], ' ') AS before, array_to_string(w[list_position(w, token) + 1:], ' ') AS after FROM t""")
def context_before_after(spark, d):
    words = identifiers(spark, d).select("id", split_identifier("name").alias("w"))
    before, after = context("w", "token")
    return words.withColumn("token", F.explode(F.array_distinct("w"))).select("id", "token", before.alias("before"), after.alias("after"))


@query(f"SELECT id, name, translate(name, 'aeiouAEIOU', 'eiouaEIOUA') AS rebuilt FROM ({IDENT_SQL})")
def identifier_rebuild(spark, d):
    """An identifier with every part replaced by one of other vowels."""
    parts = split_identifier("name")
    return identifiers(spark, d).select("id", "name", rebuild_identifier("name", parts, F.transform(parts, lambda p: F.translate(p, "aeiou", "eioua"))).alias("rebuilt"))


@query(f"""WITH v AS (SELECT token FROM ({TOKENS_SQL}) ORDER BY freq DESC, token LIMIT 3000), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM w WHERE token NOT IN (SELECT token FROM v))""")
def filter_splits_by_vocabulary(spark, d):
    docs = table(spark, d, "documents")
    known = vocabulary.top_tokens(vocabulary.word_frequency(docs), 3000)
    return vocabulary.known_splits(docs.select("doc_id", "source", "text"), known, "doc_id", lower_words("text")).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 500")
def file_filter_line_length(spark, d):
    fits = F.array_max(F.transform(F.split("text", "\n"), F.length)) <= 500
    return table(spark, d, "documents").where(fits).select("doc_id", "n_chars")


@query("""WITH f AS (SELECT doc_id, length(text) AS size FROM documents WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 2000)
SELECT doc_id, size, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id) AS running FROM f) WHERE running <= 500000""")
def file_filter_size_budget(spark, d):
    return vocabulary.size_budget(table(spark, d, "documents"), 2000, 500_000, "doc_id").select("doc_id", "size", "running")


def turns(spark, d, role):
    return table(spark, d, "conversations").where(F.col("role") == role).select("conv_id", "turn", F.explode(lower_words("text")).alias("token"))


_TURNS = "SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations WHERE role = '{0}'"


@query(f"SELECT DISTINCT token FROM ({_TURNS.format('assistant')}) WHERE token NOT IN (SELECT token FROM ({_TURNS.format('user')}))")
def new_identifiers_anti_join(spark, d):
    return turns(spark, d, "assistant").select("token").distinct().join(turns(spark, d, "user").select("token"), "token", "left_anti")


@query(f"SELECT token, count(*) AS uses FROM ({_TURNS.format('assistant')}) WHERE token IN (SELECT token FROM ({_TURNS.format('user')})) GROUP BY token")
def known_tokens_semi_join(spark, d):
    known = turns(spark, d, "assistant").join(turns(spark, d, "user").select("token").distinct(), "token", "left_semi")
    return known.groupBy("token").agg(F.count("*").alias("uses"))


@query("""SELECT h.conv_id, h.turn, length(h.text) AS head, length(b.text) AS base, b.text IS NULL AS is_new
FROM conversations h LEFT JOIN conversations b ON b.conv_id = h.conv_id AND b.turn = h.turn - 1""")
def base_head_left_join(spark, d):
    head = table(spark, d, "conversations")
    base = head.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("base_text"))
    return head.join(base, ["conv_id", "turn"], "left").select("conv_id", "turn", F.length("text").alias("head"), F.length("base_text").alias("base"), F.col("base_text").isNull().alias("is_new"))


@query("""WITH h AS (SELECT conv_id, line, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE turn % 2 = 1) GROUP BY ALL),
 b AS (SELECT conv_id, line, count(*) AS m FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE turn % 2 = 0) GROUP BY ALL),
 c AS (SELECT h.conv_id, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS changed FROM h LEFT JOIN b ON h.conv_id = b.conv_id AND h.line = b.line GROUP BY h.conv_id)
SELECT conv_id, lines, changed, changed / greatest(lines, 1) > 0.2 AS retrain FROM c""")
def changed_line_ratio(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    changed = metrics.change_ratio(lines.where("turn % 2 = 0"), lines.where("turn % 2 = 1"), "conv_id")
    return changed.withColumn("retrain", F.col("changed") / F.greatest("lines", F.lit(1)) > 0.2)


def _style_sql(pattern: str, to: str) -> str:
    pattern, to = pattern.replace("'", "''"), to.replace("$", "\\").replace("'", "''")
    return f"regexp_replace(text, '{pattern}', '{to}', 'g')"


@query(" UNION ALL ".join(f"SELECT doc_id, '{name}' AS style, length({_style_sql(*rule)}) AS n, {_style_sql(*rule)} <> text AS changed FROM documents" for name, rule in STYLES.items()))
def style_rewrites(spark, d):
    rows = F.array(*(F.struct(F.lit(name).alias("style"), rewrite("text", name).alias("new")) for name in STYLES))
    return table(spark, d, "documents").select("doc_id", "text", F.explode(rows).alias("r")).select("doc_id", "r.style", F.length("r.new").alias("n"), (F.col("r.new") != F.col("text")).alias("changed"))


@query("SELECT doc_id, CASE WHEN strpos(text, ', ') > 0 THEN strpos(text, ', ') + length(regexp_extract(text, ', ( *)', 1)) ELSE length(text) END AS same FROM documents")
def first_changed_offset(spark, d):
    """Where a text and its rewritten form begin to differ."""
    return table(spark, d, "documents").select("doc_id", common_prefix("text", rewrite("text", "comma_tight")).cast("long").alias("same"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(license|token|mail)') AND NOT regexp_matches(text, '(?i)(idiot|scum)')""")
def commit_message_filter(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("(?i)(license|token|mail)") & ~F.col("text").rlike("(?i)(idiot|scum)")).select("doc_id")


@query("""SELECT page_id, array_to_string(string_split(split_part(url, '?', 1), '/')[-3:], '@') AS name, string_split(split_part(url, '?', 1), '/')[-1] AS last FROM pages""")
def url_name(spark, d):
    parts = F.split(F.substring_index("url", "?", 1), "/")
    return table(spark, d, "pages").select("page_id", F.array_join(F.slice(parts, -3, 3), "@").alias("name"), F.element_at(parts, -1).alias("last"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0""")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k % 7 = 0")


@query("SELECT user_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_event, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_type FROM events GROUP BY user_id")
def earliest_per_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
 round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY event_type""")
def describe_report(spark, d):
    events = table(spark, d, "events")
    plain = events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    middle = quantiles(events, "event_type", "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(middle, "event_type", "left").select("event_type", "n", "mean", "std", "low", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "high")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def date_parse(spark, d):
    """A date of a text in the one known form, else null."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date").alias("day"))


_RANKED = f"SELECT token, row_number() OVER (ORDER BY freq DESC, token) AS rank FROM ({TOKENS_SQL})"
_CORRUPT = f"""SELECT correct_token, rank, CASE kind WHEN 0 THEN correct_token[1:pos - 1] || correct_token[pos + 1:] WHEN 1 THEN correct_token[1:pos] || correct_token[pos:]
 WHEN 2 THEN correct_token[1:pos - 1] || correct_token[pos + 1:pos + 1] || correct_token[pos:pos] || correct_token[pos + 2:] ELSE correct_token[1:pos - 1] || 'x' || correct_token[pos + 1:] END AS token
 FROM (SELECT token AS correct_token, rank, (length(token) + ascii(token)) % 4 AS kind, CAST(floor(length(token) / 2) AS INTEGER) + 1 AS pos FROM ({_RANKED}))"""


def ranked(spark, d):
    """(token, freq, rank) of all words: a report of the vocabulary, which is sorted as one for its ranks."""
    return vocabulary.ranked(vocabulary.word_frequency(table(spark, d, "documents")))


@query(f"SELECT correct_token, rank, token FROM ({_CORRUPT})")
def corrupt_tokens(spark, d):
    return vocabulary.corrupt(ranked(spark, d)).select("correct_token", "rank", "token")


@query(f"""WITH c AS ({_CORRUPT}), o AS (SELECT *, row_number() OVER (ORDER BY (rank * 1103515245 + 12345) % 2147483648, rank) AS place, count(*) OVER () AS n FROM c)
SELECT rank, correct_token, CASE WHEN place <= CAST(floor(0.25 * n) AS BIGINT) THEN token ELSE correct_token END AS token FROM o""")
def corrupt_exactly(spark, d):
    """Exactly a quarter of the tokens is corrupted; a swap of two equal letters may leave one as it was."""
    return vocabulary.corrupt_exactly(ranked(spark, d), 0.25, "rank").select("rank", "correct_token", "token")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_tax = 0")
def set_operations(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    large = orders.join(lines.where("l_quantity > 45"), orders["o_orderkey"] == lines["l_orderkey"], "left_semi").select("o_orderkey")
    return large.intersect(orders.where("o_orderstatus = 'F'").select("o_orderkey")).subtract(lines.where("l_tax = 0").select("l_orderkey"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.w AS x, b.w AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1), 9) AS jaccard FROM p""")
def token_jaccard(spark, d):
    """Of neighbours by id."""
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(lower_words("text")).alias("w"))
    a, b = t.select(F.col("doc_id").alias("a"), F.col("w").alias("x")), t.select(F.col("doc_id").alias("b"), F.col("w").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1)), 9).alias("jaccard"))


_PIPES = """SELECT n_nationkey AS n, '| ' || n_name || ' | ' || n_regionkey || ' | ' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE CAST(n_nationkey * 2 AS VARCHAR) END || ' |' AS line FROM nation
 UNION ALL SELECT 100, '|---|---|---|' UNION ALL SELECT 101, 'text around it'"""


@query(f"SELECT n, trim(string_split(line, '|')[2]) AS name, try_cast(trim(string_split(line, '|')[4]) AS INTEGER) AS value FROM ({_PIPES}) WHERE n < 100")
def pipe_table_scan(spark, d):
    nation = table(spark, d, "nation")
    cell = F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise((F.col("n_nationkey") * 2).cast("string"))
    lines = nation.select(F.col("n_nationkey").alias("n"), F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" | "), cell, F.lit(" |")).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([(100, "|---|---|---|"), (101, "text around it")], "n int, line string"))
    return pipe_table(lines).select("n", F.col("cells")[0].alias("name"), F.expr("try_cast(cells[2] as int)").alias("value"))


@query("SELECT r_regionkey AS k, r_regionkey / 8.0 AS f1 FROM region")
def json_in_markdown(spark, d):
    text = F.concat(F.lit("# report\n```json\n{\"f1\": 9}\n```\n</summary>\n```json\n{\"f1\": "), (F.col("r_regionkey") / 8.0).cast("string"), F.lit("}\n```\n"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("k"), embedded_json(text, "f1 double")["f1"].alias("f1"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(split_words("text")).cast("long").alias("n"))


@query("WITH n AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10) SELECT doc_id FROM documents WHERE source IN (SELECT source FROM n)")
def sources_with_enough(spark, d):
    """The documents of sources that have ten."""
    return vocabulary.enough(table(spark, d, "documents").select("doc_id", "source"), "source", 10).select("doc_id")


@query("""WITH f AS (SELECT doc_id, length(text) AS size, md5(CAST(doc_id AS VARCHAR))[1:3] AS b FROM documents), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY b, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM f)
SELECT doc_id, CASE WHEN before < 0.2 * total THEN 'test' ELSE 'train' END AS part FROM r""")
def size_split(spark, d):
    """Documents dealt to test until they hold a fifth of the characters."""
    return vocabulary.size_split(table(spark, d, "documents").select("doc_id", F.length("text").alias("size")), "doc_id", "size", 0.2).select("doc_id", "part")


@query(f"""WITH a AS (SELECT DISTINCT token FROM ({_TURNS.format('assistant')})), u AS (SELECT DISTINCT token FROM ({_TURNS.format('user')}))
SELECT (SELECT count(*) FROM a) AS "left", (SELECT count(*) FROM u) AS "right", (SELECT count(*) FROM a WHERE token IN (SELECT token FROM u)) AS both""")
def vocabulary_overlap(spark, d):
    """The words of either role, and of both."""
    return vocabulary.overlap(turns(spark, d, "assistant"), turns(spark, d, "user"))


@query("""WITH a AS (SELECT conv_id, turn AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at_ FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at_ FROM conversations WHERE role = 'assistant')
SELECT conv_id, a, b FROM a JOIN b USING (conv_id, at_)""")
def zipped_turns(spark, d):
    """The first question of a conversation with its first answer, and so on."""
    rows = table(spark, d, "conversations")
    a, b = (rows.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name)) for role, name in (("user", "a"), ("assistant", "b")))
    return vocabulary.zipped(a, b, "conv_id", "a", "b")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'base' END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 1 THEN 'odd' END AS kind FROM orders""")
def merged_maps(spark, d):
    """Settings of two maps, of which the second wins."""
    base = F.create_map(F.lit("status"), F.lit("base"), F.lit("priority"), F.col("o_orderpriority"))
    own = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus"))).otherwise(F.create_map(F.lit("kind"), F.lit("odd")))
    rows = table(spark, d, "orders").select("o_orderkey", merged_map(base, own).alias("m"))
    return rows.select("o_orderkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("status", "priority", "kind")))


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def json_rows(spark, d):
    """Rows as JSON texts."""
    from weftline.api import as_json

    return as_json(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_id"])
