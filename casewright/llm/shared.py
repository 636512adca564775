"""What several operators share: the cluster's shared folder, connected components, text buffers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; Java and DuckDB read this pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one the caller set on the context. A local session
    without either (tests) gets one of our own; a cluster must name one, as executors share no disk."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return folder or "/tmp/checkpoints"


_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at the end, the folders that staged() writes within: for callers that have written their
    own result by then. Gives the list of those folders; what is taken off it stays."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that deals both sides out by their key, however small df seems. Spark judges a table by its
    compressed files, a fifteenth of the rows in memory where values repeat, and would build it whole in the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node.

    Each round points every node at the neighbour of the lowest hash (another hash each round, so that no
    numbering makes long chains), jumps to where that one points, and gives the ends of all edges their new
    names: edges inside a group vanish, equal ones become one, so later rounds have few. Only joins and
    aggregates with partial sums; each round is checkpointed.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min(ranked("b")), F.first(ranked("a")))["to"].alias("to"))
        step = checkpointed(low.join(dealt(low.toDF("to", "up")), "to").select(F.col("a").alias("node"), F.col("up").alias("to")))
        named = edges.join(dealt(step.toDF("a", "to_a")), "a").join(dealt(step.toDF("b", "to_b")), "b").where("to_a <> to_b")
        edges = checkpointed(named.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if labels is None:
            labels = step
        else:
            labels = labels.join(dealt(step.toDF("to", "next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        turn += 1
    roots = labels.groupBy("to").agg(F.min("node").alias("root"))
    return checkpointed(labels.join(dealt(roots), "to").select("node", "root"))


def text_arrays(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A string column's bytes; nulls are empty."""
    array = batch.column(batch.schema.get_field_index(column))
    return array.fill_null("").cast(pa.binary())


def blocks(array: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of rows of at most limit bytes; a longer row is a run of its own."""
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32, count=n + 1 + array.offset)[array.offset :].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


SLICE = 1 << 20
BLANK = re.compile(rb"[\t-\r ]")


def slices(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """The text in parts of at least size (SLICE) bytes, cut before white space only."""
    at, size = 0, size or SLICE
    while at < len(text):
        blank = BLANK.search(text, at + size) if at + size < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def crc32_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def appended(df: DataFrame, columns: str, work, helpers: dict | None = None) -> DataFrame:
    """df with further columns computed by Arrow batch; earlier columns of those names are replaced.

    work takes a RecordBatch, the helper columns behind those of df, and returns the new arrays in order.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(columns)
    df = df.drop(*new.names)
    names = df.columns
    schema = StructType(df.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.record_batch(kept + work(batch), names + new.names)

    return df.select("*", *(expr.alias(name) for name, expr in (helpers or {}).items())).mapInArrow(run, schema)
