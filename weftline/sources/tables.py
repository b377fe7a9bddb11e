"""Readers and writers. Every reader states its schema, so that a scan reads the columns asked for and words like null stay words."""

from __future__ import annotations

import lzma
import tarfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FREQUENCIES = "token string, freq long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_identifiers(spark: SparkSession, path: str, schema: str = "id long, token_split string, freq long", frequency: str | None = "freq") -> DataFrame:
    """A csv of split identifiers with a header; without a frequency column each counts once. Empty fields stay empty strings."""
    df = spark.read.schema(schema).csv(path, header=True, nullValue="\0", emptyValue="")
    return df.withColumn("freq", F.coalesce(F.col(frequency), F.lit(1)) if frequency else F.lit(1).cast("long"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """A csv of token,count without a header; of repeated tokens the last counts, files in the order of their paths and rows in that of
    their places in a file."""
    df = spark.read.schema(FREQUENCIES).csv(path, header=False, nullValue="\0", emptyValue="")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("token", "freq", at.alias("at")).groupBy("token").agg(F.max_by("freq", "at").alias("freq"))


def write_frequencies(df: DataFrame, path: str) -> None:
    """Tokens by falling frequency, then by name; one ordered set of files."""
    df.select("token", "freq").orderBy(F.desc("freq"), "token").write.mode("overwrite").csv(path, header=False)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FREQUENCIES).csv(path, header=False, nullValue="\0", emptyValue="").select("token").distinct()


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all files under a folder that match a glob."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def split_pipe_row(line):
    """The trimmed cells of a row of a pipe table."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def pipe_table(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with cells: the rows of a pipe table without its separator rows and text around it."""
    text = F.trim(F.col(line))
    return lines.where(text.startswith("|") & ~text.rlike(r"^[|:\s-]+$")).withColumn("cells", split_pipe_row(F.col(line)))


def embedded_json(text, schema: str):
    """The last ```json block of a text, as a struct."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)```json\\s*(.*?)```"), F.lit(1))
    return F.from_json(F.try_element_at(blocks, F.lit(-1)), schema)


def save_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").parquet(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule_id int, attrs array<struct<feature:string,cmp:boolean,threshold:double>>, cls string, conf double, support long").parquet(path)


def read_xz(spark: SparkSession, path: str, separator: str = "\n", chunk: int = 1 << 20) -> DataFrame:
    """(path, at, value): the separated records of xz files, which Spark's own readers don't open. A file is one stream and so is read by one
    task, in chunks; at counts its records from 0. A last empty record doesn't count."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                reader, rest, at, more, mark = lzma.LZMADecompressor(), b"", 0, content, separator.encode()
                while True:
                    data = reader.decompress(more, chunk)
                    more = b""
                    *records, rest = (rest + data).split(mark)
                    ended = reader.eof or not data and reader.needs_input
                    if reader.eof and reader.unused_data:
                        reader, more, ended = lzma.LZMADecompressor(), reader.unused_data, False
                    if ended and rest:
                        records.append(rest)
                    if records:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(records)), pa.array(range(at, at + len(records)), pa.int64()), pa.array([r.decode("utf-8", "replace") for r in records])], names=["path", "at", "value"])
                        at += len(records)
                    if ended:
                        break

    return files.mapInArrow(run, "path string, at long, value string")


def read_csv_xz(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """The rows of xz-compressed csv files without line breaks in fields."""
    lines = read_xz(spark, path)
    rows = lines.where("at > 0") if header else lines
    return rows.select(F.from_csv("value", schema, {"nullValue": "\0", "emptyValue": ""}).alias("r")).select("r.*")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): the records of an xz stream that zero bytes end, with their places."""
    return read_xz(spark, path, "\0")


def read_hashes(spark: SparkSession, path: str, width: int = 20) -> DataFrame:
    """(path, at, hash): files of records of a fixed width, as hexadecimal digits; at is the place that read_messages() gives."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    places = F.sequence(F.lit(0), (F.length("content") / width).cast("int") - 1)
    rows = rows.where(F.length("content") >= width).select("path", "content", F.explode(places).alias("at"))
    return rows.select("path", F.col("at").cast("long").alias("at"), F.lower(F.hex(F.expr(f"substring(content, at * {width} + 1, {width})"))).alias("hash"))


def read_tar_xz(spark: SparkSession, path: str, largest: int = 5 << 20) -> DataFrame:
    """(archive, path, content): the regular files of tar archives, plain or compressed, up to a size. An archive is one task's."""
    import io

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.size <= largest:
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.name]), pa.array([text])], names=["archive", "path", "content"])

    return files.mapInArrow(run, "archive string, path string, content string")


#: The columns of lists of repositories and of commits that fix typos. Fixed values.
REPOSITORIES = "url string, to string, from string, vnodes_number long"
TYPO_COMMITS = "wrong_id string, correct_id string, file string, line int, commit_fix string, repo string, commit_typo string"


def read_by_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A csv whose header names its columns, in any order, some of the schema's being absent: these are null, and others left out."""
    target = spark.createDataFrame([], schema).schema
    raw = spark.read.csv(path, header=True)
    return raw.select(*((F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target))


def named_lines(source: str | Iterable[str], stdin: Iterable[str] | None = None) -> list[str]:
    """The lines of a list: of "-" those of the standard input, of a path its file's, else the given ones; without blank lines."""
    if isinstance(source, str):
        if source == "-":
            import sys

            source = stdin if stdin is not None else sys.stdin
        else:
            with open(source, encoding="utf-8") as file:
                return named_lines(list(file))
    return [line.strip() for line in source if line.strip()]


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Candidates or other results kept for later steps; gives what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_report(rows: DataFrame, path: str) -> DataFrame:
    """Adds rows to a report's table; gives the whole report."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def describe(report: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, stddev, min, max): a report's numbers, by partial sums."""
    def of(c: str):
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c)

    return report.agg(*map(of, columns)).select(F.explode(F.array(*columns)).alias("d")).select("d.*")


def markdown(report: DataFrame, order: list[str]) -> DataFrame:
    """(at, line): a small report as a pipe table, its header first. Reports hold a row for each repository or class."""
    names = report.columns
    head = [(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), F.lit(" |"))
    from pyspark.sql import Window

    rows = report.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("at"), cells.alias("line"))
    return report.sparkSession.createDataFrame(head, "at int, line string").unionByName(rows)


def save_reports(reports: dict[str, DataFrame], folder: str, order: dict[str, list[str]]) -> None:
    """One markdown file for each report under its name."""
    for name, report in reports.items():
        lines = markdown(report, order[name]).coalesce(1).sortWithinPartitions("at").select("line")
        lines.write.mode("overwrite").text(str(PurePosixPath(folder) / name) if "://" not in folder else f"{folder}/{name}")


class Models:
    """Loaded models by their source, each loaded once; a corrector's parts lie in one folder."""

    def __init__(self, load: Callable[[str], object]):
        self.load, self.known = load, {}

    def get(self, source: str) -> object:
        if source not in self.known:
            self.known[source] = self.load(source)
        return self.known[source]
