"""Command line: python -m weftline COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=text)
        for argument in arguments:
            own.add_argument(argument)
        return own

    command("queries", "list the registered queries")
    command("run", "run a query over a folder of tables and write its rows", "name", "folder", "output")
    command("frequencies", "token frequencies of a csv of split identifiers", "identifiers", "output")
    command("vocabulary", "a vocabulary from frequencies", "frequencies", "english", "output").add_argument("--size", type=int, default=10_000)
    command("train-format", "learn style rules from a folder of files", "files", "output").add_argument("--pattern", default="*")
    command("features", "features of the labelled nodes of a folder of files", "files", "output").add_argument("--pattern", default="*")
    command("train-typos", "train a corrector on a table of typos", "typos", "vocabulary", "vectors", "output")
    suggest = command("suggest", "suggest corrections for a table of tokens", "corrector", "tokens", "output")
    suggest.add_argument("--candidates", type=int, default=3)
    command("evaluate-typos", "scores of a corrector on a table of typos", "corrector", "typos").add_argument("--k", type=int, default=1)
    command("rules", "describe saved rules", "rules").add_argument("--hash", default="")
    command("compare", "compare two reports by name", "base", "new").add_argument("--columns", nargs="+", default=["precision", "recall", "f1"])
    return out


def shown(df: DataFrame, out) -> None:
    """A small result as lines of JSON."""
    for row in df.toJSON().toLocalIterator():
        print(row, file=out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args, out = parser().parse_args(arguments), out or sys.stdout
    from weftline import api, catalog
    from weftline.operators import labels, metrics, rules, vocabulary
    from weftline.sources import tables

    if args.command == "queries":
        print("\n".join(sorted(catalog.queries())), file=out)
        return 0
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    if args.command == "run":
        from weftline.shipping import shipped

        shipped(catalog.queries()[args.name])(spark, args.folder).write.mode("overwrite").parquet(args.output)
    elif args.command == "frequencies":
        rows = tables.read_identifiers(spark, args.identifiers)
        tables.write_frequencies(vocabulary.token_frequency(rows, F.split("token_split", " "), F.col("freq")), args.output)
    elif args.command == "vocabulary":
        from weftline.operators import pipelines

        found = pipelines.vocabulary_from(tables.read_frequencies(spark, args.frequencies), tables.read_vocabulary(spark, args.english), args.size, args.size, args.size)
        tables.write_frequencies(found, args.output)
    elif args.command in ("train-format", "features"):
        files = tables.read_files(spark, args.files, args.pattern)
        extractor = api.FeatureExtractor({"cutoff_label_support": 1})
        kept = extractor.index_labels(files)
        encoded = extractor.encoded(extractor.extract_features(files))
        if args.command == "features":
            encoded.write.mode("overwrite").parquet(args.output)
        else:
            samples = encoded.join(kept.select("y", "label_id"), "y")
            names = extractor.select_features(encoded)
            samples = samples.select("path", "label_id", *(F.col(f"`{c}`") for c in names))
            api.TrainableRules(leaf=5).fit(samples, names, "label_id", "path").rules.save(args.output)
    elif args.command == "train-typos":
        typos = spark.read.parquet(args.typos)
        corrector = api.TyposCorrector(spark).initialize_generator(spark.read.parquet(args.vocabulary), spark.read.parquet(args.vectors))
        corrector.train(typos).save(args.output)
    elif args.command == "suggest":
        api.TyposCorrector.load(spark, args.corrector).suggest(spark.read.parquet(args.tokens), args.candidates).write.mode("overwrite").parquet(args.output)
    elif args.command == "evaluate-typos":
        shown(api.TyposCorrector.load(spark, args.corrector).evaluate(spark.read.parquet(args.typos), args.k), out)
    elif args.command == "rules":
        shown(api.Rules.load(spark, args.rules).find(args.hash), out)
    elif args.command == "compare":
        shown(metrics.compare(spark.read.parquet(args.base), spark.read.parquet(args.new), "name", args.columns), out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
