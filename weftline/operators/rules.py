"""If-then rules: extraction from trees, merging, filtering, application, pruning; feature selection; quote harmony."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.explode("attrs").alias("a")).select("rule_id", "a.feature", "a.cmp", "a.threshold")


def merge_attributes(rules: DataFrame) -> DataFrame:
    """(rule_id, feature, cmp, threshold): of a rule's bounds on a feature, the highest lower and the lowest upper one. cmp: above."""
    t = F.col("threshold")
    return exploded(rules).groupBy("rule_id", "feature", "cmp").agg(F.when(F.col("cmp"), F.max(t)).otherwise(F.min(t)).alias("threshold"))


def filter_rules(rules: DataFrame, confidence: float, support: int) -> DataFrame:
    return rules.where((F.col("conf") > confidence) & (F.col("support") > support))


def confidence(largest: Column, support: Column) -> Column:
    return (largest - 0.5) / support


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Of the rules with the same attributes the first."""
    return rules.withColumn("key", F.to_json(F.array_sort("attrs"))).withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("rule_id"))).where("at = 1").drop("key", "at")


#: Rules up to which their predicates are written into the plan; more are joined.
WRITTEN = 400


def _holds(attrs, columns: set[str]) -> Column:
    """Whether all attributes hold; a missing feature is 0."""
    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)

    out = F.lit(True)
    for a in attrs:
        out = out & ((value(a["feature"]) > a["threshold"]) if a["cmp"] else (value(a["feature"]) <= a["threshold"]))
    return out


def with_fired(samples: DataFrame, rules: DataFrame, features: list[str], name: str = "fired") -> DataFrame:
    """samples with an array of structs (conf, first, rule_id, cls) of the rules whose attributes all hold; the largest one is the
    winner. Up to WRITTEN rules are predicates of a narrow plan; more of them are one broadcast row, as long as they are within
    Spark's limits for that."""
    few = rules.select("rule_id", "attrs", "cls", "conf").orderBy("rule_id").limit(WRITTEN + 1).collect()
    if len(few) <= WRITTEN:
        entries = [F.when(_holds(r["attrs"], set(features)), F.struct(F.lit(r["conf"]).alias("conf"), F.lit(-r["rule_id"]).alias("first"), F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["cls"]).alias("cls"))) for r in few]
        none = F.array().cast("array<struct<conf:double,first:int,rule_id:int,cls:string>>")
        return samples.withColumn(name, F.array_compact(F.array(*entries)) if entries else none)
    values = F.map_from_arrays(F.array(*(F.lit(f) for f in features)), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)))
    table = rules.agg(F.collect_list(F.struct("conf", (-F.col("rule_id")).alias("first"), "rule_id", "cls", "attrs")).alias("_rules"))

    def holds(a: Column) -> Column:
        value = F.coalesce(F.try_element_at("_values", a["feature"]), F.lit(0.0))
        return F.when(a["cmp"], value > a["threshold"]).otherwise(value <= a["threshold"])

    rows = samples.withColumn("_values", values).join(F.broadcast(table))
    hits = F.transform(F.filter("_rules", lambda r: F.forall(r["attrs"], holds)), lambda r: F.struct(r["conf"].alias("conf"), r["first"].alias("first"), r["rule_id"].alias("rule_id"), r["cls"].alias("cls")))
    return rows.withColumn(name, hits).drop("_values", "_rules")


def fired(samples: DataFrame, rules: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """(ids, rule_id, cls, conf): the rules whose attributes all hold."""
    return with_fired(samples, rules, features).select(*id_cols, F.explode("fired").alias("r")).select(*id_cols, "r.rule_id", "r.cls", "r.conf")


def apply_rules(samples: DataFrame, rules: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """ids with prediction and winner: the most confident rule that fires, the first of equals; null where none does. Narrow."""
    won = F.array_max("fired")
    return with_fired(samples, rules, features).select(*id_cols, won["cls"].alias("prediction"), won["rule_id"].alias("winner"))


def predict(samples: DataFrame, rules: DataFrame, id_cols: list[str], features: list[str], string: str, side: str, file_cols: list[str]) -> DataFrame:
    """ids with prediction, winner, conf and quoted: the rules applied, and then, where `string` isn't null, both sides of one string
    of a file take what the more confident side has. Sides without a rule that fires take no part."""
    won = F.array_max("fired")
    rows = with_fired(samples, rules, features).select(*id_cols, F.col(string).alias("_string"), F.col(side).alias("_side"), won["cls"].alias("prediction"), won["rule_id"].alias("winner"), won["conf"].alias("conf"))
    pairs = rows.where("_string is not null and prediction is not null")
    agreed = harmonise_quotes(pairs.select(*id_cols, F.col("_string").alias("string"), F.col("_side").alias("side"), F.col("prediction").alias("label"), "conf", "winner"), file_cols)
    agreed = agreed.select(*id_cols, F.col("label").alias("prediction"), "winner", "conf", F.lit(True).alias("quoted"))
    rest = rows.where("_string is null or prediction is null").select(*id_cols, "prediction", "winner", "conf", F.lit(False).alias("quoted"))
    return agreed.unionByName(rest)


def filled(prediction: Column, truth: Column) -> Column:
    """The truth where there is no prediction, which is a null or a negative one."""
    return F.when(prediction.isNull() | (prediction < 0), truth).otherwise(prediction)


def summary(rules: DataFrame) -> DataFrame:
    """One row: rules, min and max confidence and support, mean number of attributes."""
    return rules.agg(
        F.count("*").alias("rules"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"), F.min("support").alias("min_support"),
        F.max("support").alias("max_support"), F.coalesce(F.avg(F.size("attrs")), F.lit(0.0)).alias("avg_attrs"),
    )


def prune_excluded(rules: DataFrame) -> DataFrame:
    """Rules without the "not in" attributes of a feature that another attribute of the rule sets to a value, and of rules that are then
    equal the first. A categorical attribute's feature is name=value."""
    def name(feature: Column) -> Column:
        return F.substring_index(feature, "=", 1)

    def overridden(a: Column) -> Column:
        return ~a["cmp"] & F.contains(a["feature"], F.lit("=")) & F.exists("attrs", lambda b: b["cmp"] & F.contains(b["feature"], F.lit("=")) & (name(b["feature"]) == name(a["feature"])))

    return distinct_rules(rules.withColumn("attrs", F.filter("attrs", lambda a: ~overridden(a))))


def prune_similar(rules: DataFrame, samples: DataFrame, label: str, features: list[str], threshold: float = 0.98) -> DataFrame:
    """Rules of which, among attributes that err on nearly the same samples, only the first stays, and of rules that are then equal the
    first. Two attributes are alike if the Jaccard similarity of the sets of samples on which they hold and the label isn't the
    rule's class is over the threshold; chains of such ones are one group. The counts are sums of one pass over the
    samples for every PAIRS pairs; the rules themselves are few and are worked on by the driver."""
    known = rules.orderBy("rule_id").collect()
    columns = set(features)
    wrong = {(r["rule_id"], k): _holds([a], columns) & (F.col(label) != r["cls"]) for r in known for k, a in enumerate(r["attrs"])}
    pairs = [(r["rule_id"], i, j) for r in known for i, j in itertools.combinations(range(len(r["attrs"])), 2)]
    alike: dict[int, list[tuple[int, int]]] = {}
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        sums = [F.struct(F.count_if(wrong[r, i] & wrong[r, j]).alias("both"), F.count_if(wrong[r, i] | wrong[r, j]).alias("either")).alias(f"p{k}") for k, (r, i, j) in enumerate(some)]
        for (r, i, j), found in zip(some, samples.agg(*sums).first(), strict=True):
            if found["either"] and found["both"] / found["either"] > threshold:
                alike.setdefault(r, []).append((i, j))
    out, seen = [], set()
    for r in known:
        group = list(range(len(r["attrs"])))
        for i, j in alike.get(r["rule_id"], ()):  # in order: a group's number is that of its first member
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
        kept = [tuple(a) for k, a in enumerate(r["attrs"]) if group[k] == k]
        if tuple(kept) not in seen:
            seen.add(tuple(kept))
            out.append((r["rule_id"], kept, r["cls"], r["conf"], r["support"]))
    return rules.sparkSession.createDataFrame(out, SCHEMA)


#: Pairs of attributes that one pass counts.
PAIRS = 500
SCHEMA = "rule_id int, attrs array<struct<feature:string,cmp:boolean,threshold:double>>, cls string, conf double, support long"


def describe(rules: DataFrame, top: int = 255) -> DataFrame:
    """(rule_id, text, hash): a rule in words, its attributes in their order; numbers of 0 to top. hash: 8 digits that tell the same contents."""
    def words(a: Column) -> Column:
        t = a["threshold"]
        above = F.when(t > top - 1, F.concat(a["feature"], F.lit(f" = {top}"))).otherwise(F.concat(a["feature"], F.lit(" ≥ "), F.ceil(t).cast("string")))
        below = F.when(t < 1, F.concat(a["feature"], F.lit(" = 0"))).otherwise(F.concat(a["feature"], F.lit(" ≤ "), F.floor(t).cast("string")))
        return F.when(a["cmp"], above).otherwise(below)

    def category(name: Column) -> Column:
        mine = F.filter("attrs", lambda a: F.substring_index(a["feature"], "=", 1) == name)
        value = lambda a: F.substring_index(a["feature"], "=", -1)
        is_in = F.array_sort(F.transform(F.filter(mine, lambda a: a["cmp"]), value))
        is_out = F.array_sort(F.transform(F.filter(mine, lambda a: ~a["cmp"]), value))
        one = F.when(F.size(is_in) == 1, F.concat(F.lit(" = "), is_in[0])).when(F.size(is_in) > 1, F.concat(F.lit(" in {"), F.array_join(is_in, ", "), F.lit("}")))
        none = F.concat(F.lit(" not in {"), F.array_join(is_out, ", "), F.lit("}"))
        bag = F.concat(one, F.lit(" and"), none)
        return F.concat(name, F.when((F.size(is_in) > 1) & (F.size(is_out) > 0), bag).otherwise(F.coalesce(one, none)))

    plain = F.transform(F.filter("attrs", lambda a: ~F.contains(a["feature"], F.lit("="))), words)
    names = F.array_distinct(F.transform(F.filter("attrs", lambda a: F.contains(a["feature"], F.lit("="))), lambda a: F.substring_index(a["feature"], "=", 1)))
    text = F.concat(F.array_join(F.concat(plain, F.transform(names, category)), " ∧ "), F.lit(" ⇒ y = "), F.col("cls"))
    rows = rules.select("rule_id", "conf", "support", text.alias("body"))
    full = F.concat("body", F.format_string(" (confidence %.3f, support %d)", "conf", "support"))
    return rows.select("rule_id", full.alias("text"), F.left(F.md5("body"), F.lit(8)).alias("hash"))


def false_positive_jaccard(samples: DataFrame, rules_of: str) -> DataFrame:
    """(a, b, jaccard) of the sets of samples on which two rules err, for rules that share one. rules_of: an array of each sample's erring
    rules; the samples give counts of pairs of rules, of which there are as many as few rules make, and aren't joined."""
    pairs = F.flatten(F.transform(rules_of, lambda a: F.transform(F.filter(rules_of, lambda b: a <= b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = samples.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count()
    sizes = counts.where("a = b")
    both = counts.where("a < b").withColumnRenamed("count", "both")
    both = both.join(sizes.select("a", F.col("count").alias("size_a")), "a").join(sizes.select("b", F.col("count").alias("size_b")), "b")
    return both.select("a", "b", (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("jaccard"))


def greedy_rules(samples: DataFrame, n: int, truth: str, fired_col: str = "fired") -> list[tuple[int, int]]:
    """(rule_id, gain) of up to n rules, one after another. A sample goes by the most confident chosen rule that fires on it. A further rule that is
    more confident and of another class there gains 1 if it is right and loses 1 if the sample was right before; the rule with the largest gain, even a
    negative one, is chosen next, the largest id of equals. One aggregate per rule; only sums reach the driver. fired_col: with_fired()'s."""
    chosen: list[tuple[int, int]] = []
    for _ in range(n):
        taken = F.array(*(F.lit(r) for r, _ in chosen)).cast("array<int>")
        now = F.array_max(F.filter(fired_col, lambda r: F.array_contains(taken, r["rule_id"])))
        free = samples.select(F.col(truth).alias("_truth"), now.alias("_now"), F.explode(F.filter(fired_col, lambda r: ~F.array_contains(taken, r["rule_id"]))).alias("_r"))
        acts = (F.col("_r.conf") > F.coalesce("_now.conf", F.lit(-1.0))) & ~F.col("_r.cls").eqNullSafe(F.col("_now.cls"))
        gain = F.when(~acts, 0).when(F.col("_truth").eqNullSafe(F.col("_now.cls")), -1).when(F.col("_truth") == F.col("_r.cls"), 1).otherwise(0)
        best = free.groupBy(F.col("_r.rule_id").alias("rule_id")).agg(F.sum(gain).alias("gain")).orderBy(F.desc("gain"), F.desc("rule_id")).first()
        if best is None:
            break
        chosen.append((best["rule_id"], best["gain"]))
    return chosen


def pruned_tree_rules(model, features: list[str], held_out: DataFrame, label: str, spark, step_drop: float = 0.0) -> DataFrame:
    """A fitted tree's branches as rules, after reduced-error pruning: from the leaves up, two leaves of one node become one if the held-out
    rows don't lose more than step_drop of their rate of right predictions. Held-out rows give one count per leaf and class; the tree lives
    on the driver."""
    rules: list[tuple] = []

    def walk(node, attrs: list) -> dict:
        stats = list(node.impurityStats().stats())
        if node.numDescendants() == 0:
            rules.append((len(rules), attrs, "", 0.0, 0))
            return {"leaf": len(rules) - 1, "stats": stats, "attrs": attrs}
        split = node.split()
        name, threshold = features[split.featureIndex()], float(split.threshold())
        return {"stats": stats, "attrs": attrs, "sides": [walk(node.leftChild(), [*attrs, (name, False, threshold)]), walk(node.rightChild(), [*attrs, (name, True, threshold)])]}

    root = walk(model._java_obj.rootNode(), [])
    leaves = with_fired(held_out, spark.createDataFrame(rules, SCHEMA), features).select(F.array_max("fired")["rule_id"].alias("leaf"), F.col(label).cast("int").alias("y"))
    counts = {(r["leaf"], r["y"]): r["count"] for r in leaves.groupBy("leaf", "y").count().collect()}
    total, classes = sum(counts.values()), range(len(root["stats"]))
    best = lambda stats: max(classes, key=lambda c: (stats[c], -c))
    right = {"now": 0}

    def seen(node: dict) -> list[int]:
        if "leaf" in node:
            node["seen"] = [counts.get((node["leaf"], c), 0) for c in classes]
            right["now"] += node["seen"][best(node["stats"])]
        else:
            node["seen"] = [a + b for a, b in zip(*map(seen, node["sides"]), strict=True)]
        return node["seen"]

    seen(root)

    def prune(node: dict) -> bool:
        """Whether the node is a leaf now."""
        if "sides" not in node:
            return True
        if not all([prune(side) for side in node["sides"]]):
            return False
        change = node["seen"][best(node["stats"])] - sum(s["seen"][best(s["stats"])] for s in node["sides"])
        if right["now"] and change / right["now"] < -step_drop:
            return False
        right["now"] += change
        del node["sides"]
        return True

    if total:  # without held-out rows the tree stays as it is
        prune(root)
    out: list[tuple] = []

    def branches(node: dict) -> None:
        if "sides" in node:
            for side in node["sides"]:
                branches(side)
        elif size := sum(node["stats"]):
            most = best(node["stats"])
            out.append((len(out), node["attrs"], str(most), (node["stats"][most] - 0.5) / size, int(size)))

    branches(root)
    return spark.createDataFrame(out, SCHEMA)


def tree_rules(model, features: list[str], spark) -> DataFrame:
    """The branches of a fitted tree or forest as rules; the trees are small and live on the driver."""
    rows, trees = [], getattr(model, "trees", [model])

    def walk(node, attrs: list) -> None:
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            total = sum(stats)
            if total:
                rows.append((len(rows), attrs, str(stats.index(max(stats))), (max(stats) - 0.5) / total, int(total)))
            return
        split = node.split()
        name, threshold = features[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), [*attrs, (name, False, threshold)])
        walk(node.rightChild(), [*attrs, (name, True, threshold)])

    for tree in trees:
        walk(tree._java_obj.rootNode(), [])
    return spark.createDataFrame(rows, SCHEMA)


def harmonise_quotes(predictions: DataFrame, id_cols: list[str]) -> DataFrame:
    """Both quotes of a string get the label of the more confident side, the left one on ties and then the larger label, and its winner
    if there is that column. predictions: (ids, string, side, label, conf)."""
    whole = Window.partitionBy(*id_cols, "string")
    first = F.struct("conf", (F.col("side") == "left").alias("left"), "label")
    best = {c: F.max_by(c, first).over(whole) for c in ("label", "winner") if c in predictions.columns}
    return predictions.withColumns(best)


def varying(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance): the columns whose values differ."""
    sums = df.agg(*(F.var_samp(c).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns))).alias("x")).select("x.*").where("variance > 0")


def anova(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, f): the one-way ANOVA F value of each column against the label, from one pass of partial sums; null where the label tells all or
    has one value."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select(label, "v.*")
    groups = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = groups.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return total.select("feature", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))).alias("f"))


def best_features(scores: DataFrame, n: int) -> DataFrame:
    """The n features with the highest F value, ties by name: a top-k report."""
    return scores.orderBy(F.desc("f"), "feature").limit(n)


def importances(model, features: list[str], spark, n: int = 25) -> DataFrame:
    """(feature, importance): a fitted tree model's n most important features."""
    weights = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, weights, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def describe_samples(samples: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """(ids, text): each row's features in words: a number's value; of 0/1 columns name=value those that are 1, or ∅."""
    plain = [f for f in features if "=" not in f]
    groups: dict[str, list[str]] = {}
    for f in features:
        if "=" in f:
            groups.setdefault(f.split("=")[0], []).append(f)
    parts = [F.concat(F.lit(f"{f} = "), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("∅"))) for f in plain]
    for name, columns in groups.items():
        active = F.array_compact(F.array(*(F.when(F.col(f"`{c}`") > 0, F.lit(c.split("=", 1)[1])) for c in columns)))
        shown = F.when(F.size(active) == 0, F.lit("∅")).when(F.size(active) == 1, active[0]).otherwise(F.concat(F.lit("{"), F.array_join(active, ", "), F.lit("}")))
        parts.append(F.concat(F.lit(f"{name} = "), shown))
    return samples.select(*id_cols, F.concat_ws("; ", *parts).alias("text"))


#: The ranges of a tree's settings that search() draws from. Fixed values.
RANGES = {"maxDepth": (5, 10, 12), "minInstancesPerNode": tuple(range(90, 121, 10)), "forest": (False, True)}


def search(samples: DataFrame, features: list[str], label: str, n: int = 6, folds: int = 3, seed: int = 42, ranges: dict[str, tuple] | None = None):
    """(settings, score) of n drawn settings, the best first: the mean share of right predictions over the folds, each setting's trees being fitted on the
    others. label: whole numbers from 0."""
    import random

    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    names, draw = RANGES | (ranges or {}), random.Random(seed)
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(samples).select("_x", F.col(label).cast("double").alias("_y")).persist()
    rate = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
    drawn = list(dict.fromkeys(tuple(draw.choice(names[k]) for k in sorted(names)) for _ in range(20 * n)))[:n]
    out = []
    try:
        for values in drawn:
            chosen = dict(zip(sorted(names), values, strict=True))
            common = {k: v for k, v in chosen.items() if k != "forest"} | {"featuresCol": "_x", "labelCol": "_y", "maxBins": 256, "seed": seed}
            tree = RandomForestClassifier(numTrees=10, **common) if chosen["forest"] else DecisionTreeClassifier(**common)
            found = CrossValidator(estimator=tree, estimatorParamMaps=ParamGridBuilder().build(), evaluator=rate, numFolds=folds, seed=seed).fit(data)
            out.append((chosen, found.avgMetrics[0]))
    finally:
        data.unpersist()
    return sorted(out, key=lambda r: -r[1])
