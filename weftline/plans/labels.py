"""Lexing, places, white-space labels, neighbours, spans and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import fixes, labels, spans
from weftline.plans.registry import query
from weftline.sources.tables import table

_LEX = r"[A-Za-z_0-9]+|\n+|[^\S\n]+|[^A-Za-z_0-9\s]"
_T0 = f"SELECT page_id, unnest(range(0, len(t))) AS idx, unnest(t) AS value FROM (SELECT page_id, regexp_extract_all(html, '{_LEX}') AS t FROM pages)"
TOKENS = f"""t0 AS ({_T0}),
 t1 AS (SELECT *, CAST(coalesce(sum(length(value)) OVER w, 0) AS BIGINT) AS start, CAST(1 + coalesce(sum(CASE WHEN value[1] = chr(10) THEN length(value) ELSE 0 END) OVER w, 0) AS BIGINT) AS line FROM t0 WINDOW w AS (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t2 AS (SELECT *, start + length(value) AS stop FROM t1),
 tok AS (SELECT *, 1 + start - coalesce(max(CASE WHEN value[1] = chr(10) THEN stop END) OVER w, 0) AS col,
  CASE WHEN value[1] = chr(10) THEN 'newline' WHEN regexp_matches(value, '^\\s') THEN 'space' WHEN value = '"' THEN 'quote' ELSE 'none' END AS class FROM t2
  WINDOW w AS (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def tokens(spark, d):
    return labels.lex(table(spark, d, "pages").select("page_id", "html"), "page_id", "html")


@query(f"WITH {TOKENS} SELECT page_id, count(*) AS n, CAST(max(stop) AS BIGINT) AS size, CAST(max(line) AS BIGINT) AS lines, count(DISTINCT value) AS kinds FROM tok GROUP BY page_id")
def lexer_token_counts(spark, d):
    return tokens(spark, d).groupBy("page_id").agg(F.count("*").alias("n"), F.max("stop").alias("size"), F.max("line").alias("lines"), F.count_distinct("value").alias("kinds"))


@query(f"WITH {TOKENS} SELECT page_id, CAST(idx AS BIGINT) AS idx, value, CAST(start AS BIGINT) AS start, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col FROM tok")
def token_offsets_lines(spark, d):
    return tokens(spark, d).select("page_id", F.col("idx").cast("long").alias("idx"), "value", "start", "line", "col")


@query(f"WITH {TOKENS} SELECT page_id, md5(string_agg(value, '' ORDER BY idx)) AS digest, count(*) AS n FROM tok GROUP BY page_id")
def lexer_roundtrip(spark, d):
    """The tokens, joined again; the tests hold them against the text."""
    rows = tokens(spark, d)
    text, sizes = fixes.text_of(rows, "page_id"), rows.groupBy("page_id").agg(F.count("*").alias("n"))
    return text.join(sizes.hint("merge"), "page_id").select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n")


@query(f"WITH {TOKENS} SELECT class, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM tok GROUP BY class")
def whitespace_classes(spark, d):
    return labels.white_classes(tokens(spark, d)).groupBy("class").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


_COMPOSITE = f"""WITH {TOKENS}, m AS (SELECT * FROM tok WHERE class <> 'none'),
 b AS (SELECT *, idx <> coalesce(lag(idx) OVER w, -2) + 1 OR class = 'quote' OR coalesce(lag(class) OVER w, '') = 'quote' AS brk FROM m WINDOW w AS (PARTITION BY page_id ORDER BY idx)),
 r AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS run FROM b),
 g AS (SELECT page_id, min(idx) AS first, string_agg(class, '+' ORDER BY idx) AS label FROM r GROUP BY page_id, run)"""


@query(f"{_COMPOSITE} SELECT page_id, CAST(first AS BIGINT) AS first, label FROM g")
def composite_labels(spark, d):
    return labels.composites(tokens(spark, d), "page_id").withColumn("first", F.col("first").cast("long"))


@query(f"{_COMPOSITE}, s AS (SELECT label, count(*) AS support FROM g GROUP BY label HAVING count(*) >= 20) SELECT label, support, CAST(row_number() OVER (ORDER BY support DESC, label) - 1 AS INTEGER) AS label_id FROM s")
def label_support_cutoff(spark, d):
    return labels.support(labels.composites(tokens(spark, d), "page_id"), "label", 20)


@query(f"""WITH {TOKENS}, b AS (SELECT *, lag(class) OVER w AS before, lead(class) OVER w AS behind FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY idx)),
 n AS (SELECT page_id, start AS pos FROM b WHERE class = 'none' AND (before = 'none' OR before IS NULL) UNION ALL SELECT page_id, stop FROM b WHERE class = 'none' AND behind IS NULL)
SELECT page_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM n GROUP BY page_id""")
def noop_gaps(spark, d):
    return labels.noops(tokens(spark, d), "page_id").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


_LINES = "SELECT doc_id, unnest(range(0, len(l))) AS line, repeat(' ', 2 * (unnest(range(0, len(l))) % 4)) || unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"""WITH l AS (SELECT *, length(text) - length(ltrim(text, ' ')) AS indent FROM ({_LINES}) WHERE trim(text, ' ') <> ''),
 c AS (SELECT *, indent - coalesce(lag(indent) OVER (PARTITION BY doc_id ORDER BY line), 0) AS d FROM l)
SELECT doc_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS inc, CAST(sum(greatest(-d, 0)) AS BIGINT) AS dec FROM c GROUP BY doc_id""")
def indentation_changes(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.concat(F.repeat(F.lit(" "), (2 * F.pmod("line", F.lit(4))).cast("int")), "text"))
    return labels.indentation(lines, "doc_id").groupBy("doc_id").agg(F.sum("inc").cast("long").alias("inc"), F.sum("dec").cast("long").alias("dec"))


@query(f"""WITH {TOKENS}, q AS (SELECT *, lead(value, 1) OVER w AS content, lead(value, 2) OVER w AS close FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY idx))
SELECT page_id, content, count(*) AS n FROM q WHERE value = '"' AND close = '"' AND content <> '"' GROUP BY ALL""")
def quote_pairs(spark, d):
    return labels.quote_pairs(tokens(spark, d), "page_id").groupBy("page_id", "content").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, k AS (SELECT * FROM tok WHERE class NOT IN ('space', 'newline')),
 n AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lead(value, 1) OVER w AS r1, lead(value, 2) OVER w AS r2, least(coalesce(abs(start - lag(start) OVER w), 0), 255) AS diff_start, least(coalesce(abs(line - lag(line) OVER w), 0), 255) AS diff_line, least(coalesce(abs(col - lag(col) OVER w), 0), 255) AS diff_col FROM k WINDOW w AS (PARTITION BY page_id ORDER BY idx))
SELECT page_id, CAST(idx AS BIGINT) AS idx, l1, l2, r1, r2, CAST(diff_start AS BIGINT) AS diff_start, CAST(diff_line AS BIGINT) AS diff_line, CAST(diff_col AS BIGINT) AS diff_col FROM n""")
def neighbour_window_features(spark, d):
    return labels.neighbours(tokens(spark, d), "page_id").select("page_id", F.col("idx").cast("long").alias("idx"), "l1", "l2", "r1", "r2", *(F.col(f"diff_{c}").cast("long").alias(f"diff_{c}") for c in ("start", "line", "col")))


_RESERVED = ["<", ">", "=", "/", "div", "p"]


@query(f"WITH {TOKENS} SELECT page_id, " + ", ".join(f"count(*) FILTER (value = '{v}') AS n_{k}" for k, v in enumerate(_RESERVED)) + " FROM tok GROUP BY page_id")
def one_hot_reserved(spark, d):
    hot = labels.one_hot(tokens(spark, d), _RESERVED)
    return hot.groupBy("page_id").agg(*(F.sum(f"is_{k}").alias(f"n_{k}") for k in range(len(_RESERVED))))


@query(f"WITH {TOKENS} SELECT page_id, " + ", ".join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in ("space", "newline", "quote")) + " FROM tok GROUP BY page_id")
def bag_of_labels(spark, d):
    return labels.bag(tokens(spark, d), "page_id", ["space", "newline", "quote"])


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS error_before,
 first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS error_behind FROM events""")
def nearest_left_right_node(spark, d):
    node = F.when(F.col("event_type") == "error", F.col("event_id"))
    return labels.carried(table(spark, d, "events"), "user_id", "event_id", node, "error_before", "error_behind").select("event_id", "error_before", "error_behind")


def tree(spark, d):
    """(node, parent): regions over nations over customers."""
    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    regions = table(spark, d, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, d, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    return regions.unionByName(nations).unionByName(table(spark, d, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")))


@query("""SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent_1, 'r' || n_regionkey AS parent_2 FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region""")
def parent_chain(spark, d):
    return spans.parents(tree(spark, d), 2)


@query("""SELECT 'c' || a.c_custkey AS a, 'c' || b.c_custkey AS b, CASE WHEN a.c_nationkey = b.c_nationkey THEN 'n' || a.c_nationkey WHEN x.n_regionkey = y.n_regionkey THEN 'r' || x.n_regionkey END AS ancestor
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey""")
def lca(spark, d):
    custom = table(spark, d, "customer").select("c_custkey")
    later = custom.select((F.col("c_custkey") - 1).alias("c_custkey"))
    pairs = custom.join(later, "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string")).alias("b"))
    return spans.common_ancestor(pairs, tree(spark, d), 2)


def layers(spark, d):
    """Two layers per page, from the tokens: all single tokens, and every 40th token with its 9 followers."""
    rows = tokens(spark, d).select("page_id", "idx", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    long = rows.groupBy("page_id", F.floor(F.col("idx") / 40).alias("k")).agg(F.min("start").alias("start"), F.max(F.when(F.col("idx") % 40 < 10, F.col("stop"))).alias("stop"))
    return rows.select("page_id", "start", "stop"), long.select("page_id", "start", "stop")


_LAYERS = f"""WITH {TOKENS}, a AS (SELECT page_id, CAST(start AS BIGINT) AS a_start, CAST(stop AS BIGINT) AS a_stop FROM tok),
 b AS (SELECT page_id, CAST(min(start) AS BIGINT) AS b_start, CAST(max(CASE WHEN idx % 40 < 10 THEN stop END) AS BIGINT) AS b_stop FROM tok GROUP BY page_id, idx // 40)"""


@query(f"{_LAYERS} SELECT page_id, a_start, a_stop, b_start, b_stop FROM a JOIN b USING (page_id) WHERE b_start <= a_start AND a_stop <= b_stop")
def span_cover_join(spark, d):
    return spans.cover_join(*layers(spark, d), "page_id")


@query(f"{_LAYERS} SELECT page_id, a_start, a_stop, b_start, b_stop FROM a JOIN b USING (page_id) WHERE a_start < b_stop AND b_start < a_stop")
def span_overlap_join(spark, d):
    return spans.overlap_join(*layers(spark, d), "page_id")


@query(f"""WITH {TOKENS}, m AS MATERIALIZED (SELECT page_id, value, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, lag(value) OVER (PARTITION BY page_id ORDER BY idx) AS before FROM tok),
 words AS (SELECT DISTINCT page_id, start, stop FROM m WHERE regexp_matches(value, '^[A-Za-z_0-9]')) SELECT page_id, m.start, m.stop FROM m JOIN words USING (page_id, start, stop) WHERE before = '<'""")
def span_exact_join(spark, d):
    """What stands behind an opening bracket, a tag's name or its slash, where the layer of words has the very same span."""
    rows = tokens(spark, d)
    behind = rows.withColumn("before", F.expr("lag(value) over (partition by page_id order by idx)")).where("before = '<'")
    return spans.exact_join(behind.select("page_id", "start", "stop"), rows.where(F.col("value").rlike("^[A-Za-z_0-9]")), "page_id")


@query(f"""WITH {TOKENS}, f AS (SELECT page_id, line, idx, value AS old, CASE WHEN value = '"' THEN '`' ELSE value END AS new, 0.5 + (idx % 4) / 8.0 AS conf FROM tok),
 l AS (SELECT page_id, line, string_agg(old, '' ORDER BY idx) AS old, string_agg(new, '' ORDER BY idx) AS new, CAST(round_even(100 * avg(CASE WHEN old <> new THEN conf END), 0) AS INTEGER) AS confidence FROM f GROUP BY page_id, line)
SELECT page_id, CAST(line AS BIGINT) AS line, length(old) AS old_size, length(new) AS new_size, confidence FROM l WHERE old <> new""")
def line_fixes(spark, d):
    """Lines that change if every quote becomes a back quote."""
    t = tokens(spark, d)
    guess = t.where("value = '\"'").select("page_id", "idx", F.lit("`").alias("predicted"), (0.5 + F.col("idx") % 4 / 8.0).alias("conf"))
    return fixes.line_fixes(fixes.with_labels(t, guess, ["page_id", "idx"]), "page_id").select("page_id", F.col("line").cast("long").alias("line"), F.length("old").cast("long").alias("old_size"), F.length("new").cast("long").alias("new_size"), "confidence")


@query("""WITH texts AS (SELECT page_id, html AS text FROM pages) SELECT page_id FROM texts WHERE length(replace(text, '(', '')) <> length(replace(text, ')', '')) OR length(replace(text, '[', '')) <> length(replace(text, ']', '')) OR length(replace(text, '{', '')) <> length(replace(text, '}', '')) OR (length(text) - length(replace(text, '"', ''))) % 2 = 1""")
def bracket_balance(spark, d):
    """The pages whose brackets or quotes don't pair up."""
    return fixes.unbalanced(table(spark, d, "pages").withColumnRenamed("html", "text"), "page_id")


#: The greedy choice step by step: of each page's spans in order the first, then the next that begins at its end or behind it.
_SPANS = "SELECT page_id, k * 7 % 50 AS start, k * 7 % 50 + k % 6 + 1 AS stop FROM pages, range(0, 20) r(k)"


@query(f"""WITH RECURSIVE s AS ({_SPANS}), k AS (SELECT page_id, min(struct_pack(a := start, b := -stop)) AS m FROM s GROUP BY page_id UNION ALL
 SELECT k.page_id, (SELECT min(struct_pack(a := start, b := -stop)) FROM s WHERE s.page_id = k.page_id AND s.start >= -k.m.b) FROM k WHERE k.m IS NOT NULL)
SELECT page_id, CAST(m.a AS BIGINT) AS start, CAST(-m.b AS BIGINT) AS stop FROM k WHERE m IS NOT NULL""")
def kept_spans(spark, d):
    """Spans of each page without those that overlap the one kept before them."""
    rows = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    start = (F.col("k") * 7 % 50).cast("long")
    return spans.kept_spans(rows.select("page_id", start.alias("start"), (start + F.col("k") % 6 + 1).alias("stop")), "page_id")
