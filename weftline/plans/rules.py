"""Rules over order lines, feature selection and learners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.text import lower_words
from weftline.operators import alignment, metrics, pipelines, rules
from weftline.plans.registry import query
from weftline.sources.tables import table

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: (rule, [(feature, above, threshold)], class, confidence, support). Fixed values.
RULES = [
    (0, [("l_quantity", True, 20.0), ("l_quantity", True, 30.0), ("l_tax", False, 0.05)], "N", 0.93, 120),
    (1, [("l_discount", True, 0.04), ("l_discount", False, 0.08), ("l_discount", False, 0.07)], "R", 0.9, 300),
    (2, [("l_tax", True, 0.06)], "A", 0.85, 80),
    (3, [("l_quantity", False, 10.0)], "R", 0.95, 60),
    (4, [("l_linenumber", True, 4.0), ("l_quantity", True, 40.0)], "N", 0.85, 90),
    (5, [("l_tax", True, 0.06)], "A", 0.8, 200),
]
_SCHEMA = rules.SCHEMA
_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', CAST({p} AS DOUBLE), {s})" for i, _, c, p, s in RULES) + ") AS r(rule_id, cls, conf, support)"
_ATTRS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', {str(a).lower()}, CAST({t} AS DOUBLE))" for i, attrs, *_ in RULES for f, a, t in attrs) + ") AS a(rule_id, feature, cmp, threshold)"
_HOLDS = " OR ".join(f"(rule_id = {i} AND " + " AND ".join(f"{f} {'>' if a else '<='} {t}" for f, a, t in attrs) + ")" for i, attrs, *_ in RULES)


def given(spark):
    return spark.createDataFrame(RULES, _SCHEMA)


#: One rule for each place in an order, from the lines there: bounds of the quantity, twice from below, of the tax and the discount; the class of most lines.
_LEARNED = """g AS (SELECT l_linenumber, min(l_quantity) AS low, round(avg(l_quantity), 2) AS mean, max(l_tax) AS tax, round(avg(l_discount), 4) AS discount, count(*) AS support FROM lineitem GROUP BY l_linenumber),
 c AS (SELECT l_linenumber, l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_returnflag QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC, l_returnflag) = 1),
 r AS (SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS rule_id, g.*, cls, round((n - 0.5) / support, 9) AS conf FROM g JOIN c USING (l_linenumber)),
 a AS (SELECT rule_id, 'l_quantity' AS feature, true AS cmp, CAST(low AS DOUBLE) AS threshold FROM r UNION ALL SELECT rule_id, 'l_quantity', true, mean FROM r UNION ALL SELECT rule_id, 'l_tax', false, tax FROM r UNION ALL SELECT rule_id, 'l_discount', false, discount FROM r)"""


def learned(spark, d):
    """The rules of _LEARNED, as rules are stored."""
    lines = table(spark, d, "lineitem")
    most = lines.groupBy("l_linenumber", "l_returnflag").count().groupBy("l_linenumber").agg(F.max(F.struct("count", (-F.ascii("l_returnflag")).alias("first"), "l_returnflag")).alias("m"))
    bounds = F.min("l_quantity").alias("low"), F.round(F.avg("l_quantity"), 2).alias("mean"), F.max("l_tax").alias("tax"), F.round(F.avg("l_discount"), 4).alias("discount")
    groups = lines.groupBy("l_linenumber").agg(*bounds, F.count("*").alias("support")).join(most, "l_linenumber")

    def attr(feature, above, threshold):
        return F.struct(F.lit(feature).alias("feature"), F.lit(above).alias("cmp"), F.col(threshold).cast("double").alias("threshold"))

    attrs = F.array(attr("l_quantity", True, "low"), attr("l_quantity", True, "mean"), attr("l_tax", False, "tax"), attr("l_discount", False, "discount"))
    conf = F.round(rules.confidence(F.col("m.count"), F.col("support")), 9).alias("conf")
    place = (F.row_number().over(Window.orderBy("l_linenumber")) - 1).alias("rule_id")  # as few rows as an order has places
    return groups.select(place, attrs.alias("attrs"), F.col("m.l_returnflag").alias("cls"), conf, "support")


@query(f"WITH {_LEARNED} SELECT rule_id, feature, cmp, CASE WHEN cmp THEN max(threshold) ELSE min(threshold) END AS threshold FROM a GROUP BY rule_id, feature, cmp")
def rules_merge(spark, d):
    return rules.merge_attributes(learned(spark, d))


@query(f"WITH {_LEARNED} SELECT rule_id, cls, conf, CAST(support AS BIGINT) AS support FROM r WHERE conf > (SELECT median(conf) FROM r) AND support > 80")
def rules_filter(spark, d):
    """The rules of more than the middle confidence."""
    known = learned(spark, d)
    middle = known.agg(F.median("conf")).first()[0]
    return rules.filter_rules(known, middle if middle is not None else 1.0, 80).select("rule_id", "cls", "conf", "support")


#: Each rule's condition, the most confident one first, the first of equals.
_ORDERED = sorted(RULES, key=lambda r: (-r[3], r[0]))
_CONDITION = {i: " AND ".join(f"{f} {'>' if a else '<='} {t}" for f, a, t in attrs) for i, attrs, *_ in RULES}


@query(f"WITH {_LEARNED} SELECT min(rule_id) AS rule_id FROM (SELECT rule_id, string_agg(feature || cmp || threshold, ',' ORDER BY feature, cmp, threshold) AS key FROM a WHERE feature <> 'l_discount' AND threshold IN (SELECT low FROM r UNION SELECT tax FROM r) GROUP BY rule_id) GROUP BY key")
def rules_distinct(spark, d):
    """The learned rules without what is a mean, of which many are the same."""
    known = learned(spark, d)
    return rules.distinct_rules(known.withColumn("attrs", F.array(F.get("attrs", F.lit(0)), F.get("attrs", F.lit(2))))).select("rule_id")


@query(f"""SELECT {', '.join(IDS)}, CASE {' '.join(f"WHEN {_CONDITION[i]} THEN '{c}'" for i, _, c, *_ in _ORDERED)} END AS prediction,
 CASE {' '.join(f"WHEN {_CONDITION[i]} THEN {i}" for i, *_ in _ORDERED)} END AS winner FROM lineitem""")
def rules_apply(spark, d):
    return rules.apply_rules(table(spark, d, "lineitem"), given(spark), IDS, FEATURES)


@query(f"""WITH r AS ({_RULES_SQL}), l AS (SELECT *, row_number() OVER () AS k FROM lineitem), w AS (SELECT rule_id, k FROM l, r WHERE ({_HOLDS}) AND l_returnflag <> cls),
 s AS (SELECT rule_id, count(*) AS n FROM w GROUP BY rule_id), b AS (SELECT x.rule_id AS a, y.rule_id AS b, count(*) AS n FROM w x JOIN w y USING (k) WHERE x.rule_id < y.rule_id GROUP BY ALL)
SELECT b.a, b.b, round(b.n / (p.n + q.n - b.n), 9) AS jaccard FROM b JOIN s p ON p.rule_id = b.a JOIN s q ON q.rule_id = b.b""")
def rule_fp_jaccard(spark, d):
    rows = rules.with_fired(table(spark, d, "lineitem"), given(spark), FEATURES)
    wrong = F.transform(F.filter("fired", lambda r: r["cls"] != F.col("l_returnflag")), lambda r: r["rule_id"])
    return rules.false_positive_jaccard(rows.select(wrong.alias("wrong")), "wrong").withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH r AS ({_RULES_SQL}), g AS (SELECT rule_id, conf, count(*) FILTER (l_returnflag = cls) AS hits, count(*) AS total FROM lineitem, r WHERE {_HOLDS} GROUP BY ALL)
SELECT rule_id, conf, round(sum(hits) OVER w / sum(total) OVER w, 9) AS precision, round(sum(total) OVER w / sum(total) OVER (), 9) AS rate FROM g WINDOW w AS (ORDER BY conf DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def pr_curve_by_rule(spark, d):
    return metrics.precision_curve(_by_rule(spark, d)).select("rule_id", "conf", F.round("precision", 9).alias("precision"), F.round("rate", 9).alias("rate"))


def _by_rule(spark, d):
    """(rule_id, conf, right, total) over all lines."""
    hits = rules.fired(table(spark, d, "lineitem"), given(spark), ["l_returnflag"], FEATURES)
    return hits.groupBy("rule_id", "conf").agg(F.count_if(F.col("l_returnflag") == F.col("cls")).alias("right"), F.count("*").alias("total"))


@query(f"""WITH r AS ({_RULES_SQL}), g AS (SELECT rule_id, conf, count(*) FILTER (l_returnflag = cls) AS hits, count(*) AS total FROM lineitem, r WHERE {_HOLDS} GROUP BY ALL),
 c AS (SELECT conf, sum(hits) OVER w / sum(total) OVER w AS precision, sum(total) OVER w / sum(total) OVER () AS rate FROM g WINDOW w AS (ORDER BY conf DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conf, round(rate, 9) AS rate, round(precision, 9) AS precision FROM c WHERE precision >= 0.3 AND rate >= 0.1 ORDER BY conf, rate DESC LIMIT 1""")
def confidence_threshold(spark, d):
    """The lowest confidence that keeps the rules' precision."""
    return alignment.threshold_for(_by_rule(spark, d), 0.3, 0.1).select("conf", F.round("rate", 9).alias("rate"), F.round("precision", 9).alias("precision"))


@query(f"""WITH {_LEARNED}, k AS (SELECT rule_id, count(*) AS n FROM a GROUP BY rule_id)
SELECT count(*) AS rules, min(conf) AS min_conf, max(conf) AS max_conf, CAST(min(support) AS BIGINT) AS min_support, CAST(max(support) AS BIGINT) AS max_support, avg(n) AS avg_attrs FROM r JOIN k USING (rule_id)""")
def rules_summary(spark, d):
    return rules.summary(learned(spark, d))


_WORDS_SQL = "CASE WHEN cmp THEN feature || CASE WHEN threshold > 254 THEN ' = 255' ELSE ' ≥ ' || CAST(ceil(threshold) AS BIGINT) END ELSE feature || CASE WHEN threshold < 1 THEN ' = 0' ELSE ' ≤ ' || CAST(floor(threshold) AS BIGINT) END END"


@query(f"""WITH r AS ({_RULES_SQL}), a AS (SELECT *, row_number() OVER () AS ord FROM ({_ATTRS_SQL})), w AS (SELECT rule_id, string_agg({_WORDS_SQL}, ' ∧ ' ORDER BY ord) AS body FROM a GROUP BY rule_id),
 b AS (SELECT rule_id, body || ' ⇒ y = ' || cls AS body, conf, support FROM w JOIN r USING (rule_id))
SELECT rule_id, body || printf(' (confidence %.3f, support %d)', conf, support) AS text, left(md5(body), 8) AS hash FROM b""")
def rule_descriptions(spark, d):
    return rules.describe(given(spark))


#: Rules over categories: name=value, above 0.5 or not. Fixed values.
CATEGORIES = [
    (0, [("flag=A", True, 0.5), ("flag=N", False, 0.5), ("mode=AIR", False, 0.5)], "x", 0.9, 10),
    (1, [("flag=N", False, 0.5), ("flag=R", False, 0.5)], "y", 0.8, 20),
    (2, [("flag=A", True, 0.5), ("mode=AIR", False, 0.5)], "x", 0.7, 30),
]
_CATEGORIES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, '{f}', {str(a).lower()})" for i, attrs, *_ in CATEGORIES for k, (f, a, _) in enumerate(attrs)) + ") AS a(rule_id, ord, feature, cmp)"


@query(f"""WITH a AS (SELECT *, split_part(feature, '=', 1) AS name FROM ({_CATEGORIES_SQL})), s AS (SELECT *, bool_or(cmp) OVER (PARTITION BY rule_id, name) AS given FROM a),
 k AS (SELECT rule_id, string_agg(feature || CASE WHEN cmp THEN '' ELSE '!' END, ',' ORDER BY ord) AS attrs FROM s WHERE cmp OR NOT given GROUP BY rule_id)
SELECT min(rule_id) AS rule_id, attrs FROM k GROUP BY attrs""")
def rules_without_excluded(spark, d):
    """Rules without what an equality of the same feature says already."""
    kept = rules.prune_excluded(spark.createDataFrame(CATEGORIES, _SCHEMA))
    return kept.select("rule_id", F.array_join(F.transform("attrs", lambda a: F.concat(a["feature"], F.when(a["cmp"], "").otherwise("!"))), ",").alias("attrs"))


#: Rules with attributes that say nearly the same. Fixed values.
ALIKE = [
    (0, [("l_quantity", True, 20.0), ("l_quantity", True, 20.5), ("l_tax", False, 0.05)], "N", 0.93, 120),
    (1, [("l_discount", False, 0.2), ("l_linenumber", True, 0.0), ("l_tax", False, 0.04)], "R", 0.9, 300),
]


def _alike_sql(threshold: float) -> str:
    """The first attribute of each group of alike ones, as SQL over the samples; groups of three attributes by hand."""
    parts = []
    for i, attrs, c, *_ in ALIKE:
        e = [f"({f} {'>' if a else '<='} {t} AND l_returnflag <> '{c}')" for f, a, t in attrs]
        sims = {(x, y): f"(count(*) FILTER ({e[x]} AND {e[y]}) / nullif(count(*) FILTER ({e[x]} OR {e[y]}), 0) > {threshold})" for x, y in ((0, 1), (0, 2), (1, 2))}
        second = f"NOT coalesce({sims[0, 1]}, false) AND NOT (coalesce({sims[0, 2]}, false) AND coalesce({sims[1, 2]}, false))"
        third = f"NOT coalesce({sims[0, 2]}, false) AND NOT coalesce({sims[1, 2]}, false)"
        parts.append(f"SELECT {i} AS rule_id, 1 + CASE WHEN {second} THEN 1 ELSE 0 END + CASE WHEN {third} THEN 1 ELSE 0 END AS attrs FROM lineitem")
    return " UNION ALL ".join(parts)


@query(_alike_sql(0.98))
def rules_without_alike(spark, d):
    """How many attributes stay of rules whose attributes err on nearly the same lines."""
    kept = rules.prune_similar(spark.createDataFrame(ALIKE, _SCHEMA), table(spark, d, "lineitem"), "l_returnflag", FEATURES)
    return kept.select("rule_id", F.size("attrs").alias("attrs"))


@query(f"""SELECT {', '.join(IDS)}, coalesce(CASE {' '.join(f"WHEN {_CONDITION[i]} THEN {ord(c)}" for i, _, c, *_ in _ORDERED)} END, ascii(l_returnflag)) AS label FROM lineitem""")
def filled_predictions(spark, d):
    """The rules' class of each line, as a number, or its own where no rule fires."""
    rows = rules.with_fired(table(spark, d, "lineitem"), given(spark), FEATURES)
    won = F.coalesce(F.ascii(F.array_max("fired")["cls"]), F.lit(-1))
    return rows.select(*IDS, rules.filled(won, F.ascii("l_returnflag")).alias("label"))


@query(f"""WITH r AS ({_RULES_SQL}), l AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber % 2 AS side, l_quantity, l_discount, l_tax, l_linenumber, l_suppkey FROM lineitem),
 p AS (SELECT *, CASE {' '.join(f"WHEN {_CONDITION[i]} THEN '{c}'" for i, _, c, *_ in _ORDERED)} END AS label, CASE {' '.join(f"WHEN {_CONDITION[i]} THEN CAST({c} AS DOUBLE)" for i, _, _, c, _ in _ORDERED)} END AS conf FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN label IS NULL THEN NULL ELSE max(conf) OVER (PARTITION BY l_orderkey) END AS best FROM p""")
def quoted_predictions(spark, d):
    """Lines of one order as sides of one string: with a prediction, they take that of the most confident one, whose confidence is shown."""
    lines = table(spark, d, "lineitem").select(*IDS, "l_quantity", "l_discount", "l_tax").distinct()
    lines = lines.withColumn("string", F.col("l_orderkey").cast("string")).withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right"))
    conf = spark.createDataFrame([(i, p) for i, _, _, p, _ in RULES], "winner int, best double")
    found = rules.predict(lines, given(spark), [*IDS, "l_quantity"], FEATURES, "string", "side", ["l_orderkey"])
    return found.join(F.broadcast(conf), "winner", "left").select(*IDS, "l_quantity", "best")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(round(log10(var_samp({c})), 6) AS DOUBLE) AS size FROM lineitem HAVING var_samp({c}) > 0" for c in _NUMBERS))
def variance_threshold(spark, d):
    lines = table(spark, d, "lineitem").withColumn("constant", F.lit(1))
    return rules.varying(lines, [*_NUMBERS, "constant"]).select("feature", F.round(F.log10("variance"), 6).alias("size"))


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT i, label, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY ALL),
 t AS (SELECT i, sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM g GROUP BY i)
SELECT 'e' || i AS feature, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f FROM t""")
def anova_f(spark, d):
    wide = table(spark, d, "embeddings").select("label", *(F.col("embedding")[i].alias(f"e{i}") for i in range(64)))
    return rules.anova(wide, [f"e{i}" for i in range(64)], "label").withColumn("f", F.round("f", 5))


def _vectors(spark, d):
    from pyspark.ml.feature import VectorAssembler

    lines = table(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(lines)


@query()
def forest_rules(spark, d):
    """The branches of a small forest as rules; the tests hold them against the trees' own predictions."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=3, maxDepth=4, seed=7).fit(_vectors(spark, d))
    return rules.tree_rules(model, FEATURES, spark)


_TOP_F = """WITH e AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT i, label, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY ALL),
 t AS (SELECT i, sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM g GROUP BY i)
SELECT 'e' || i AS feature, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f FROM t ORDER BY ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) DESC, 'e' || i LIMIT 10"""


@query(_TOP_F)
def best_features(spark, d):
    """The ten dimensions that tell the labels best."""
    wide = table(spark, d, "embeddings").select("label", *(F.col("embedding")[i].alias(f"e{i}") for i in range(64)))
    return rules.best_features(rules.anova(wide, [f"e{i}" for i in range(64)], "label"), 10).withColumn("f", F.round("f", 5))


def _greedy_sql(n: int) -> str:
    """n steps of the greedy choice, each with the state that the choices before leave."""
    base = f"l AS (SELECT row_number() OVER () AS k, l_returnflag, l_quantity, l_discount, l_tax, l_linenumber FROM lineitem), h AS (SELECT k, l_returnflag AS y, rule_id, cls, conf FROM l, ({_RULES_SQL}) r WHERE {_HOLDS})"
    parts = [base]
    for step in range(n):
        taken = " UNION ALL ".join(f"SELECT rule_id FROM c{i}" for i in range(step)) or "SELECT -1"
        parts.append(f"n{step} AS (SELECT k, max(struct_pack(conf := conf, first := -rule_id, cls := cls)) AS w FROM h WHERE rule_id IN ({taken}) GROUP BY k)")
        parts.append(f"""g{step} AS (SELECT rule_id, CAST(sum(CASE WHEN conf <= coalesce(w.conf, -1) OR cls IS NOT DISTINCT FROM w.cls THEN 0 WHEN y IS NOT DISTINCT FROM w.cls THEN -1 WHEN y = cls THEN 1 ELSE 0 END) AS BIGINT) AS gain
 FROM h LEFT JOIN n{step} USING (k) WHERE rule_id NOT IN ({taken}) GROUP BY rule_id)""")
        parts.append(f"c{step} AS (SELECT {step} AS place, rule_id, gain FROM g{step} ORDER BY gain DESC, rule_id DESC LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(n))


@query(_greedy_sql(3))
def greedy_rule_choice(spark, d):
    """The rules that put most lines right, one after another."""
    rows = rules.with_fired(table(spark, d, "lineitem"), given(spark), FEATURES)
    return spark.createDataFrame([(k, r, g) for k, (r, g) in enumerate(rules.greedy_rules(rows, 3, "l_returnflag"))], "place int, rule_id int, gain long")


@query()
def pruned_rules(spark, d):
    """A tree's branches after reduced-error pruning on lines set aside; the tests hold it against a plain program."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from weftline.operators.vocabulary import hash_split

    parts = hash_split(_vectors(spark, d).withColumn("key", F.concat_ws("-", *IDS)), "key", 80)
    model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=5, seed=7).fit(parts.where("part = 'train'"))
    return rules.pruned_tree_rules(model, FEATURES, parts.where("part = 'test'"), "y", spark)


@query()
def word_vectors(spark, d):
    """Token embeddings from the documents' words."""
    docs = table(spark, d, "documents")
    return pipelines.token_vectors(docs, lower_words("text"), 10)


@query("""WITH p AS (SELECT l_orderkey AS k, l_partkey AS string, l_linenumber % 2 AS s, l_returnflag AS label, l_quantity AS conf FROM lineitem),
 q AS (SELECT DISTINCT * FROM p) SELECT k, string, s, first_value(label) OVER (PARTITION BY k, string ORDER BY conf DESC, s, label DESC) AS label FROM q""")
def quote_harmonise(spark, d):
    sides = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("string"), (F.col("l_linenumber") % 2).alias("s"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("conf")).distinct()
    return rules.harmonise_quotes(sides.withColumn("side", F.when(F.col("s") == 0, "left").otherwise("right")), ["k"]).select("k", "string", "s", "label")


@query("SELECT c_custkey, 'balance = ' || CAST(round(c_acctbal) AS BIGINT) || '; nation = ' || CASE WHEN c_nationkey IN (1, 2, 3) THEN CAST(c_nationkey AS VARCHAR) ELSE '∅' END AS text FROM customer")
def sample_descriptions(spark, d):
    """Customers' features in words."""
    rows = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal").cast("long").alias("balance"), *((F.col("c_nationkey") == k).cast("int").alias(f"nation={k}") for k in (1, 2, 3)))
    return rules.describe_samples(rows, ["c_custkey"], ["balance", "nation=1", "nation=2", "nation=3"])
