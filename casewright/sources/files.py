"""Sources and sinks: JSON lines, JSON and Markdown reports, tagged file sets, file scans.

Everything goes through Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.messages import SECRETS, secret_places


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines path; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, position: str | None = None, mode: str = "overwrite") -> None:
    """df as JSON lines with sorted keys and without null keys; with position, in that order in one file.

    mode 'append' adds rows, 'errorifexists' refuses to replace what is there.
    """
    out = df
    if position:
        out = df.repartition(1).sortWithinPartitions(position).drop(position)
    out.select(*sorted(out.columns)).write.mode(mode).option("ignoreNullFields", "true").json(path)


def read_tagged(spark: SparkSession, paths: Mapping[str, str], schema: str, tag: str = "model") -> DataFrame:
    """Several JSON-lines paths as one table with their names."""
    out = None
    for name, path in paths.items():
        part = read_jsonl(spark, path, schema).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths")
    return out


def parse_tagged(argument: str) -> tuple[str, str]:
    """name=path, or a bare path whose stem is the name."""
    name, sep, path = argument.partition("=")
    return (name, path) if sep else (argument.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], argument)


#: The folder that a file lies in, from its path.
FOLDER = r"([^/]+)/[^/]+$"


def checkpoint_runs(spark: SparkSession, root: str, schema: str, metrics: str = "per_case_metrics.jsonl") -> DataFrame:
    """Rows of root/*/metrics with folder, all in one scan; schema may name checkpoint_id."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/{metrics}")
    return rows.withColumn("folder", F.regexp_extract("_metadata.file_path", FOLDER, 1))


def checkpoint_summaries(spark: SparkSession, root: str, name: str = "aggregate_summary.json") -> DataFrame:
    """(folder, status, record_count) of root/*/name, all in one scan; null where a document lacks them."""
    texts = spark.read.text(f"{root}/*/{name}", wholetext=True)
    read = F.try_parse_json("value")
    status, count = F.try_variant_get(read, "$.status", "string"), F.try_variant_get(read, "$.record_count", "bigint")
    return texts.select(F.regexp_extract("_metadata.file_path", FOLDER, 1).alias("folder"), status.alias("status"), count.alias("record_count"))


def checkpoint_errors(runs: DataFrame, summaries: DataFrame, expected: DataFrame, exposures: int) -> DataFrame:
    """(checkpoint_id, problem) of checkpoints that must not be read; expected is (checkpoint_id, records).

    A checkpoint needs a summary with status pass and its number of records, one row for every exposures
    records, and no row that names another checkpoint. Folders that nobody expects are left alone.
    """
    named = F.col("checkpoint_id").cast("string") if "checkpoint_id" in runs.columns else F.lit(None).cast("string")
    counts = runs.groupBy(F.col("folder").alias("r_folder")).agg(F.count("*").alias("rows"), F.count_if(named != F.col("folder")).alias("strangers"))
    told = summaries.groupBy(F.col("folder").alias("s_folder")).agg(F.max("status").alias("status"), F.max("record_count").alias("record_count"))
    both = expected.join(told, F.col("checkpoint_id") == F.col("s_folder"), "left").join(counts, F.col("checkpoint_id") == F.col("r_folder"), "left")
    problems = F.array_compact(F.array(
        F.when(F.col("s_folder").isNull(), "no summary"),
        F.when(F.col("s_folder").isNotNull() & ~F.col("status").eqNullSafe(F.lit("pass")), "did not pass"),
        F.when(F.col("s_folder").isNotNull() & (F.coalesce("record_count", F.lit(0)) != F.col("records")), "incomplete records"),
        F.when(F.coalesce("rows", F.lit(0)) * exposures != F.col("records"), "incomplete rows"),
        F.when(F.coalesce("strangers", F.lit(0)) > 0, "rows of another checkpoint"),
    ))
    return both.select("checkpoint_id", F.explode(problems).alias("problem"))


def read_checkpoints(spark: SparkSession, root: str, expected: Mapping[str, int], schema: str, exposures: int = 1, summaries: bool = False) -> DataFrame:
    """Rows of all expected checkpoints (id and number of records) with their checkpoint_id; raises if any is not as
    it should be. summaries: whether each must have passed by its own summary. Two scans, however many
    checkpoints there are."""
    wanted = spark.createDataFrame(list(expected.items()), "checkpoint_id string, records long")
    runs = checkpoint_runs(spark, root, schema)
    told = checkpoint_summaries(spark, root) if summaries else wanted.select(F.col("checkpoint_id").alias("folder"), F.lit("pass").alias("status"), F.col("records").alias("record_count"))
    if wrong := checkpoint_errors(runs, told, wanted, exposures).orderBy("checkpoint_id", "problem").limit(20).collect():
        raise ValueError(f"checkpoints cannot be used: {[tuple(r) for r in wrong]}")
    kept = runs.join(F.broadcast(wanted.select(F.col("checkpoint_id").alias("folder"))), "folder")
    return kept.withColumn("checkpoint_id", F.col("folder")).drop("folder")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small report as an indented JSON document with sorted keys."""
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def markdown_table(df: DataFrame, places: int = 4, percent: tuple[str, ...] = ()) -> str:
    """A small result as a Markdown table; doubles with fixed places, named columns as per cent."""
    def cell(name: str, value: object) -> str:
        if value is None:
            return "n/a"
        if name in percent:
            return f"{100 * value:.2f}%"
        return f"{value:.{places}f}" if isinstance(value, float) else str(value).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---:" if t in ("double", "bigint", "int") else "---" for _, t in df.dtypes) + " |"]
    lines += ["| " + " | ".join(cell(n, v) for n, v in zip(df.columns, row)) + " |" for row in df.collect()]
    return "\n".join(lines) + "\n"


def report(title: str, sections: Mapping[str, DataFrame], percent: tuple[str, ...] = ()) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df, percent=percent)}" for name, df in sections.items())


def reject_protected(path: str, word: str = "confirmation") -> str:
    """The path, unless it names protected data."""
    if word in path.lower():
        raise PermissionError(f"{path} is protected")
    return path


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    return _files(spark, root).select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Suffixes of text files, suffixes of files that may be pointers to others, and their size.
TEXT = (".py", ".md", ".json", ".jsonl", ".sh", ".toml", ".yml", ".yaml", ".env", ".txt")
POINTERS, POINTER_BYTES = (".bin", ".safetensors", ".pt", ".pth"), 200


def scan_release(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT, most_bytes: int = 50 << 20, skip: str = ".git") -> DataFrame:
    """(path, line, finding): every secret in the text files below a folder by the line where it begins, files that
    are too large and pointer files (line 0).

    Size comes first: a large file is told whatever its suffix, and its content is never read, as the size test
    is pushed to the source. Then the suffix, then whether the content is UTF-8. Nothing below a folder of the
    name skip is looked at.
    """
    every = _files(spark, root).where(~F.contains("path", F.lit(f"/{skip}/")))
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*([.][^/.]*)$", 1))
    large = every.where(F.col("length") > most_bytes).select("path", F.lit(0).alias("line"), F.lit("too_large").alias("finding"))
    pointers = every.where((F.col("length") < POINTER_BYTES) & suffix.isin(list(POINTERS))).select("path", F.lit(0).alias("line"), F.lit("pointer").alias("finding"))
    texts = every.where(suffix.isin(list(suffixes)) & (F.col("length") <= most_bytes)).select("path", F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text"))
    found = texts.select("path", F.explode(secret_places(F.col("text"), SECRETS)).alias("f")).select("path", F.col("f.line").alias("line"), F.col("f.finding").alias("finding"))
    return found.union(large).union(pointers)


def scan_status(findings: DataFrame) -> DataFrame:
    """One row: numbers of findings by kind, and whether the release passes or is to be looked at."""
    n = {name: F.count_if(F.col("finding") == name).alias(name) for name in [*SECRETS, "too_large", "pointer"]}
    row = findings.agg(*n.values())
    bad = sum((F.col(name) for name in [*SECRETS, "too_large"][1:]), F.col(next(iter(SECRETS))))
    return row.withColumn("status", F.when(bad == 0, "pass").otherwise("review_required"))
