"""The library's classes: a typo corrector, a feature extractor, trainable rules, span annotations and a reporter.

They hold tables and settings and call the operators; whatever they return is a lazy DataFrame, but for fitted models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import config
from weftline.operators import corrector, fuzzy, metrics, rules, spans, style
from weftline.sources import tables


class TyposCorrector:
    """Corrects tokens (id, token, before, after) against a vocabulary (token, freq), with vectors (token, embedding)."""

    def __init__(self, spark: SparkSession, settings: dict[str, Any] | None = None):
        self.spark, self.settings, self.model = spark, config.checked(config.TYPOS, settings), None
        self.vocabulary = self.vectors = None

    def initialize_generator(self, vocabulary: DataFrame, vectors: DataFrame) -> TyposCorrector:
        self.vocabulary, self.vectors = vocabulary.select("token", "freq"), vectors.select("token", "embedding")
        return self

    def expand_vocabulary(self, tokens: DataFrame) -> TyposCorrector:
        self.vocabulary = corrector.expand_vocabulary(self.vocabulary, tokens)
        return self

    def candidates(self, typos: DataFrame) -> DataFrame:
        """Candidates with their features."""
        s = self.settings
        size = self.vectors.select(F.max(F.size("embedding"))).first()[0] or 1
        found = corrector.candidate_set(typos, self.vocabulary, self.vectors, s["max_distance"], s["edit_dist_number"], s["neighbors_number"], size)
        return corrector.candidate_features(found, typos, self.vocabulary, self.vectors, size)

    def train(self, typos: DataFrame, candidates: DataFrame | None = None) -> TyposCorrector:
        """typos with correct_token; candidates: those of save_table(), if they were worked out before."""
        rows = self.candidates(typos) if candidates is None else candidates
        self.model = corrector.train_ranker(corrector.labelled(rows, typos), self.settings["train_rounds"], self.settings["depth"])
        return self

    def suggest(self, typos: DataFrame, n: int = 3, return_all: bool = True, candidates: DataFrame | None = None) -> DataFrame:
        """(id, token, candidate, proba, rank): the n likeliest candidates of each token."""
        if self.model is None:
            raise ValueError("train() comes first")
        rows = self.candidates(typos) if candidates is None else candidates
        return fuzzy.rank_candidates(corrector.with_probability(self.model, rows), n, "id", return_all)

    def suggest_by_batches(self, typos: DataFrame, n: int = 3, return_all: bool = True) -> DataFrame:
        """suggest(): Spark scores partition by partition whatever the number of rows."""
        return self.suggest(typos, n, return_all)

    def evaluate(self, typos: DataFrame, k: int = 1) -> DataFrame:
        found = self.suggest(typos, max(k, 1)).select("id", "rank", "candidate")
        return corrector.suggestion_scores(typos, found, k)

    def fix_identifiers(self, identifiers: DataFrame, suggestions: DataFrame) -> DataFrame:
        return corrector.identifier_fixes(identifiers, suggestions, self.settings["n_candidates"])

    def describe(self) -> dict[str, Any]:
        return {"settings": self.settings, "words": self.vocabulary.count() if self.vocabulary is not None else 0, "trees": self.model.getNumTrees if self.model else 0}

    def save(self, folder: str) -> None:
        tables.save_table(self.vocabulary, f"{folder}/vocabulary")
        tables.save_table(self.vectors, f"{folder}/vectors")
        self.spark.createDataFrame([(__import__("json").dumps(self.settings),)], "settings string").write.mode("overwrite").parquet(f"{folder}/settings")
        if self.model is not None:
            self.model.write().overwrite().save(f"{folder}/ranker")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TyposCorrector:
        """What save() wrote; without a ranker if there was none."""
        import json

        from pyspark.ml.classification import GBTClassificationModel

        out = cls(spark, json.loads(spark.read.parquet(f"{folder}/settings").first()[0]))
        out.initialize_generator(spark.read.parquet(f"{folder}/vocabulary"), spark.read.parquet(f"{folder}/vectors"))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ranker")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out.model = GBTClassificationModel.load(f"{folder}/ranker")
        return out


class FeatureExtractor:
    """Features of the labelled nodes of files (path, content), and the choice among them."""

    def __init__(self, settings: dict[str, Any] | None = None, reserved: tuple[str, ...] = (), types: tuple[str, ...] = (), nodes: str | None = None):
        self.settings = config.checked(config.FORMAT["feature_extractor"], settings)
        self.reserved, self.types, self.nodes, self.labels, self.selected = reserved, types, nodes, None, None

    def index_labels(self, files: DataFrame) -> DataFrame:
        """(label, support, label_id) of labels with the support asked for, which are from now on the only ones."""
        from weftline.operators.labels import support

        found = style.virtual_nodes(files, "path", "content", self.nodes).where("y is not null")
        kept = support(found, "y", self.settings["cutoff_label_support"])
        self.labels = tuple(r["y"] for r in kept.orderBy("label_id").collect())
        return kept

    def extract_features(self, files: DataFrame, lines: str | None = None) -> DataFrame:
        s = self.settings
        groups = {g: tuple(s[f"{g}_features"]) for g in style.GROUPS}
        windows = {"left": s["left_siblings_window"], "right": s["right_siblings_window"], "parent": s["parents_depth"]}
        return style.extract_features(files, "path", "content", self.nodes, lines, groups, windows, s["no_labels_on_right"], reserved=self.reserved, types=self.types, labels=self.labels)

    def encoded(self, features: DataFrame, values: dict[str, list[str]] | None = None) -> DataFrame:
        """(path, idx, start, y) and numbers only: ordinals, 0 if absent, a column for each atomic class of label bags, and a 0/1 column
        name=value for each value of text and role columns; values: those to take, else those of the features themselves, which
        are few: reserved tokens, types and roles."""
        numbers, texts, bags, roles = [], [], [], []
        for f in features.schema[4:]:
            {"int": numbers, "string": texts, "array<int>": bags}.get(f.dataType.simpleString(), roles).append(f.name)
        if values is None:
            sets = [F.collect_set(c).alias(c) for c in texts] + [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in roles]
            values = {c: sorted(v) for c, v in features.agg(*sets).first().asDict().items()} if sets else {}
        columns = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in numbers]
        columns += [F.coalesce(F.get(c, F.lit(k)), F.lit(0)).cast("double").alias(f"{c}[{k}]") for c in bags for k in range(len(style.CLASSES))]
        columns += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}={v}") for c in texts for v in values.get(c, ())]
        columns += [F.coalesce(F.array_contains(c, v).cast("double"), F.lit(0.0)).alias(f"{c}={v}") for c in roles for v in values.get(c, ())]
        return features.select("path", "idx", "start", "y", *columns)

    def select_features(self, encoded: DataFrame, label: str = "y") -> list[str]:
        """The names of the varying columns with the highest F values against the label."""
        names = [c for c in encoded.columns if c not in ("path", "idx", "start", label)]
        quoted = encoded.select(label, *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
        aliases = {f"c{k}": c for k, c in enumerate(names)}
        kept = [r["feature"] for r in rules.varying(quoted, list(aliases)).collect()]
        best = rules.best_features(rules.anova(quoted, kept, label).where("f is not null"), self.settings["select_features_number"]).collect() if kept else []
        self.selected = [aliases[r["feature"]] for r in best]
        return self.selected


class Rules:
    """A table of rules and what is done with them."""

    def __init__(self, table: DataFrame):
        self.table = table

    def filter_by_confidence(self, least: float) -> Rules:
        return Rules(self.table.where(F.col("conf") > least))

    def filter_by_support(self, least: int) -> Rules:
        return Rules(self.table.where(F.col("support") > least))

    def apply(self, samples: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
        return rules.apply_rules(samples, self.table, id_cols, features)

    def predict(self, samples: DataFrame, id_cols: list[str], features: list[str], string: str, side: str, file_cols: list[str]) -> DataFrame:
        return rules.predict(samples, self.table, id_cols, features, string, side, file_cols)

    def summary(self) -> DataFrame:
        return rules.summary(self.table)

    def describe(self) -> DataFrame:
        return rules.describe(self.table)

    def find(self, digits: str) -> DataFrame:
        """The rules whose hash begins with these digits, in words."""
        return self.describe().where(F.col("hash").startswith(digits))

    def by_feature(self) -> DataFrame:
        """(rule_id, feature, group, place, attrs): the attributes of each rule, those of one feature of one neighbour together."""
        rows = rules.exploded(self.table)
        base = F.regexp_extract("feature", r"^([^=\[]*)", 1)
        parts = rows.select("rule_id", base.alias("name"), F.struct("feature", "cmp", "threshold").alias("a")).groupBy("rule_id", "name").agg(F.array_sort(F.collect_list("a")).alias("attrs"))
        pattern = r"^(node|left|right|parent)_(\d+)_(.*)$"
        feature = F.when(F.col("name").rlike(pattern), F.regexp_extract("name", pattern, 3)).otherwise(F.col("name"))
        return parts.select("rule_id", feature.alias("feature"), F.regexp_extract("name", pattern, 1).alias("group"), F.expr(f"try_cast(regexp_extract(name, '{pattern}', 2) as int)").alias("place"), "attrs")

    def save(self, path: str) -> None:
        tables.save_rules(self.table, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Rules:
        return cls(tables.load_rules(spark, path))


class TrainableRules:
    """Rules from a tree or a forest over numeric columns, pruned as the settings say."""

    def __init__(self, settings: dict[str, Any] | None = None, depth: int = 5, leaf: int = 90, seed: int = 42):
        self.settings, self.depth, self.leaf, self.seed = config.checked(config.FORMAT["trainable_rules"], settings), depth, leaf, seed
        self.rules: Rules | None = None

    def fit(self, samples: DataFrame, features: list[str], label: str, key: str, forest: bool = False) -> TrainableRules:
        """label: whole numbers from 0; key: the column whose hash sets rows aside for pruning."""
        from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        from weftline.operators.vocabulary import hash_split

        s, spark = self.settings, samples.sparkSession
        parts = hash_split(samples, key, round(100 * (1 - s["prune_dataset_ratio"])))
        kept, held = parts.where("part = 'train'"), parts.where("part = 'test'")
        data = VectorAssembler(inputCols=features, outputCol="_x").transform(kept).select("_x", F.col(label).cast("double").alias("_y"))
        common = {"featuresCol": "_x", "labelCol": "_y", "maxDepth": self.depth, "minInstancesPerNode": self.leaf, "maxBins": 256, "seed": self.seed}
        self.model = (RandomForestClassifier(numTrees=s["n_estimators"], **common) if forest else DecisionTreeClassifier(**common)).fit(data)
        pruned = not forest and "reduced-error" in s["prune_branches_algorithms"]
        found = rules.pruned_tree_rules(self.model, features, held, label, spark) if pruned else rules.tree_rules(self.model, features, spark)
        found = _joined_bounds(found)
        if "top-down-greedy" in s["prune_branches_algorithms"]:
            absolute, budget = s["top_down_greedy_budget"]
            fired = rules.with_fired(held.withColumn("_y", F.col(label).cast("int").cast("string")), found, features)
            chosen = [r for r, _ in rules.greedy_rules(fired, int(budget if absolute else budget * found.count()), "_y")]
            found = found.where(F.col("rule_id").isin(chosen))
        if s["prune_attributes"]:
            found = rules.prune_similar(found, held.withColumn("_y", F.col(label).cast("int").cast("string")), "_y", features, s["attribute_similarity_threshold"])
        self.rules = Rules(rules.prune_excluded(found)).filter_by_confidence(s["confidence_threshold"])
        self.features = features
        return self

    def predict(self, samples: DataFrame, id_cols: list[str]) -> DataFrame:
        return self.rules.apply(samples, id_cols, self.features)

    def full_score(self, samples: DataFrame, id_cols: list[str], label: str) -> DataFrame:
        """One row: the share of rows that get a prediction, and of all rows and of these, how many are right."""
        rows = self.predict(samples, id_cols).join(samples.select(*id_cols, F.col(label).cast("int").cast("string").alias("_y")), id_cols)
        right = (F.col("prediction") == F.col("_y")).cast("double")
        return rows.agg(F.avg(F.col("prediction").isNotNull().cast("double")).alias("ppcr"), F.avg(F.coalesce(right, F.lit(0.0))).alias("full_score"), F.avg(right).alias("score"))


def _joined_bounds(table: DataFrame) -> DataFrame:
    """Rules with at most one lower and one upper bound of a feature, by name."""
    merged = rules.merge_attributes(table).groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("feature", "cmp", "threshold"))).alias("attrs"))
    none = F.array().cast("array<struct<feature:string,cmp:boolean,threshold:double>>")
    return table.drop("attrs").join(merged, "rule_id", "left").select("rule_id", F.coalesce("attrs", none).alias("attrs"), "cls", "conf", "support")


class AnnotationManager:
    """Spans (id, layer, start, stop, value) of texts. Within a layer spans don't overlap; add() looks."""

    def __init__(self, spark: SparkSession, id_type: str = "string"):
        self.table = spark.createDataFrame([], f"id {id_type}, layer string, start long, stop long, value string")

    def add(self, more: DataFrame) -> AnnotationManager:
        more = more.select("id", "layer", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "value")
        if not spans.bad_spans(more).isEmpty():
            raise ValueError("a span's offsets are missing, negative or in the wrong order")
        both = self.table.unionByName(more).withColumn("key", F.struct("id", "layer"))
        if not spans.conflicts(both, "key").isEmpty() or not both.groupBy("key", "start", "stop").count().where("count > 1").isEmpty():
            raise ValueError("spans of one layer overlap")
        self.table = self.table.unionByName(more)
        return self

    def get(self, layer: str, start: int, stop: int) -> DataFrame:
        return self.table.where((F.col("layer") == layer) & (F.col("start") == start) & (F.col("stop") == stop))

    def count(self, layer: str) -> int:
        return self.table.where(F.col("layer") == layer).count()

    def iter_by_type(self, layer: str, start: int = 0) -> DataFrame:
        """A layer's spans from an offset on, in order."""
        return self.table.where((F.col("layer") == layer) & (F.col("start") >= start)).orderBy("id", "start", "stop")

    def iter_nested(self, layer: str, *others: str) -> DataFrame:
        """A layer's spans with columns of the values that other layers have at the same place."""
        out = self.table.where(F.col("layer") == layer).drop("layer")
        for other in others:
            more = self.table.where(F.col("layer") == other).select("id", "start", "stop", F.col("value").alias(other))
            out = out.join(more, ["id", "start", "stop"], "left")
        return out


class Reporter:
    """Runs reviews and reports on them: subclasses say how a row is reviewed and what is made of all reviews."""

    def reviews(self, rows: DataFrame) -> DataFrame:
        """What is found in the rows."""
        raise NotImplementedError

    def reports(self, found: DataFrame) -> dict[str, DataFrame]:
        """Reports by name."""
        raise NotImplementedError

    def run(self, rows: DataFrame, checkpoint: str | None = None) -> dict[str, DataFrame]:
        """The reports; with a checkpoint, rows whose id is already among the reviews kept there aren't reviewed again."""
        found = self.reviews(rows if checkpoint is None else self._new(rows, checkpoint))
        return self.reports(found if checkpoint is None else tables.append_report(found, checkpoint))

    @staticmethod
    def _new(rows: DataFrame, checkpoint: str) -> DataFrame:
        spark = rows.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return rows
        return rows.join(spark.read.parquet(checkpoint).select("id").distinct(), "id", "left_anti")

    @staticmethod
    def assembled(frames: dict[str, DataFrame]) -> DataFrame:
        """Class reports as one table with the column report."""
        out: DataFrame | None = None
        for name, frame in frames.items():
            own = frame.withColumn("report", F.lit(name))
            out = own if out is None else out.unionByName(own)
        return out


class ClassReporter(Reporter):
    """Reports per class over rows (id, truth, prediction), all and by part if there is that column."""

    def reviews(self, rows: DataFrame) -> DataFrame:
        return rows

    def reports(self, found: DataFrame) -> dict[str, DataFrame]:
        out = {"all": metrics.class_report(found, "truth", "prediction")}
        for part in ("train", "test") if "part" in found.columns else ():
            out[part] = metrics.class_report(found.where(F.col("part") == part), "truth", "prediction")
        return out


def languages() -> Iterator[tuple[str, dict[str, Callable]]]:
    """The registered languages and their hooks."""
    yield from LANGUAGES.items()


#: Language -> its hooks: signs and reserved tokens of its lexer, and fix, a function of its files with nodes that mends these.
LANGUAGES: dict[str, dict[str, Any]] = {"plain": {"signs": style.SIGNS, "reserved": (), "fix": lambda files: files}}


def register_language(name: str, signs: tuple[str, ...], reserved: tuple[str, ...] = (), fix: Callable[[DataFrame], DataFrame] | None = None) -> None:
    LANGUAGES[name] = {"signs": signs, "reserved": reserved, "fix": fix or (lambda files: files)}


def language_statistics(nodes: DataFrame) -> DataFrame:
    """(kind, name, n): how often types, roles and characters of plain tokens occur. nodes: (type, roles, value)."""
    kinds = F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("name")))
    roles = F.transform(F.coalesce("roles", F.array().cast("array<string>")), lambda r: F.struct(F.lit("role").alias("kind"), r.alias("name")))
    signs = F.transform(F.when(F.col("type").isNull(), F.regexp_extract_all("value", F.lit(r"[^\w\s]"), F.lit(0))).otherwise(F.array().cast("array<string>")), lambda c: F.struct(F.lit("sign").alias("kind"), c.alias("name")))
    return nodes.select(F.explode(F.concat(kinds, roles, signs)).alias("x")).where("x.name is not null").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def checked_count(df: DataFrame, expected: int, retry: Callable[[], DataFrame] | None = None, tries: int = 3) -> DataFrame:
    """df if it has so many rows; else what retry() gives, a few times; then an error."""
    for _ in range(tries):
        if (n := df.count()) == expected:
            return df
        if retry is None:
            break
        df = retry()
    raise ValueError(f"{expected} rows were expected, and there are {n}")


def profiled(df: DataFrame, log: Callable[[str], None] = print) -> DataFrame:
    """Runs df once without keeping its rows, and logs its seconds and its plan; gives df."""
    import time

    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    log(f"{time.time() - began:.3f} s\n{df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}")
    return df


def as_json(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, json): each row's other columns as one JSON text, for a viewer or a checkpoint."""
    return df.select(*id_cols, F.to_json(F.struct(*(c for c in df.columns if c not in id_cols))).alias("json"))
