"""Exact dedup of texts by counting quotient filters and byte verification.

Texts are equal when identical after deleting ASCII white space. Each partition gathers the 64-bit
fingerprints of its texts in counting quotient filters; these are cut by their leading bits into blocks,
and a block's filters merge without loss into one. Fingerprints that count above one mark a bit map (of
at most 2 ** MOST_BITS bits, the only thing sent to all tasks besides at most HOT frequent
fingerprints). A second pass over the texts lets go those whose bit is not set, as no other text has
their fingerprint; the rest are compared by their bytes, by grouping on fingerprint and whole text with
partial sums. A fingerprint of one in HOT documents or more is first grouped in SALT parts, so copies
of one text meet in no task before most of them are summed up. With 10 ** 8 repeated fingerprints or more
the bit map fills up and lets more texts through to the comparison; the result stays the same.

Of equal texts the row with the most code points in the original text stays, then the one with the
smallest doc_id (null last), then the first by row number, so exactly one row of a group is kept.

Defined results: a null text is empty, and empty texts (or texts of white space) are equal; a null
doc_id is an id like any other and comes last; repeated rows are answered each, one of them kept; an
empty table gives an empty result; further columns are ignored by exact_groups and stay in exact_dedup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import quotient
from casewright.llm.shared import fresh, staged, table, text_arrays

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Fingerprints that a task holds before it writes them as a filter; fingerprints to a merged block.
FLUSH, ROOM = 1 << 20, 1 << 18
LEAST_BLOCKS = 6
MOST_BITS = 27
HOT, SALT = 1000, 64


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def fingerprint(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body)


def _filter_batches(hashed: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            fps, counts = quotient.gathered(np.concatenate(held))
            held.clear()
            return pa.record_batch([pa.array([len(fps)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([quotient.encode(fps, counts)], pa.binary())], ["entries", "texts", "filter"])

        for batch in batches:
            held.append(np.array([hashed(normalised(x.as_py())) for x in text_arrays(batch, "text")], dtype=np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _split_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = quotient.split(*quotient.decode(data.as_py()), bits)
                yield pa.record_batch([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "filter"])

    return run


def _merge(bits: int, map_bits: int, frequent: int):
    """Of a block: its part of the bit map of repeated fingerprints, and its frequent fingerprints."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        fps, counts = quotient.merged(group.column("filter").to_pylist(), block)
        marks = np.zeros(1 << (map_bits - bits), bool)
        again = fps[counts > 1]
        marks[(again >> np.uint64(64 - map_bits)) & np.uint64(len(marks) - 1)] = True
        hot = fps[(counts > 1) & (counts >= frequent)].view(np.int64)
        return pa.table([pa.array([block], pa.int64()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()), pa.array([hot.tolist()], pa.list_(pa.int64()))], ["block", "marks", "hot"])

    return run


def repeated_fingerprints(docs: DataFrame, hashed: Callable[[bytes], int] = fingerprint) -> tuple[np.ndarray, int, np.ndarray]:
    """(bit map, its number of address bits, frequent fingerprints) of docs' column text."""
    filters = staged(docs.select("text").mapInArrow(_filter_batches(hashed), "entries long, texts long, filter binary"), "exact-filters")
    size = filters.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
    bits = max(LEAST_BLOCKS, (size["entries"] // ROOM).bit_length())
    map_bits = max(bits + 3, min(MOST_BITS, max(16, (16 * size["entries"]).bit_length())))
    cut = filters.select("filter").mapInArrow(_split_batches(bits), "block long, filter binary")
    merged = cut.groupBy("block").applyInArrow(_merge(bits, map_bits, -(-size["texts"] // HOT)), "block long, marks binary, hot array<long>")
    marks, hot = np.zeros((1 << bits, 1 << (map_bits - bits - 3)), np.uint8), []
    for r in merged.toLocalIterator():
        marks[r["block"]] = np.frombuffer(r["marks"], np.uint8)
        hot += r["hot"]
    return marks.ravel(), map_bits, np.array(sorted(hot), np.int64)


def _row_batches(marks, hot: np.ndarray, map_bits: int, hashed: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = marks.value
        for batch in batches:
            texts = text_arrays(batch, "text")
            bodies = [normalised(x.as_py()) for x in texts]
            fps = np.array([hashed(x) for x in bodies], dtype=np.uint64)
            place = (fps >> np.uint64(64 - map_bits)).astype(np.int64)
            again = (seen[place >> 3] >> (place & 7)) & 1
            signed = fps.view(np.int64)
            rows = batch.column(batch.schema.get_field_index("row")).to_numpy()
            salt = np.where(np.isin(signed, hot), 1 + rows % SALT, 0)
            n_chars = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0).cast(pa.int64())
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())
            kept = pa.array([x if a else None for x, a in zip(bodies, again.tolist())], pa.binary())
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(rows, pa.int64()), pa.array(signed, pa.int64()), pa.array(salt, pa.int32()), n_chars, digests, kept], ["doc_id", "row", "fp", "salt", "n_chars", "text_sha256", "body"])

    return run


def _groups(rows: DataFrame, size: str) -> DataFrame:
    return rows.where("size > 1").select("fp", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("size").alias(size))


def exact_groups(docs: DataFrame, row: str | None = None, hashed: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, text_sha256) of every row; row names docs' column of row numbers,
    if it has one (numbers of its own are given otherwise); hashed may be any function to 64 bits."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    marks, map_bits, hot = repeated_fingerprints(docs, hashed)
    told = spark.sparkContext.broadcast(marks)
    numbered = docs.select("doc_id", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    schema = f"doc_id {key}, row long, fp long, salt int, n_chars long, text_sha256 string, body binary"
    rows = staged(numbered.mapInArrow(_row_batches(told, hot, map_bits, hashed), schema), "exact-rows")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    parts = rows.where("body IS NOT NULL").groupBy("fp", "salt", "body").agg(F.count("*").alias("size"), F.min(order).alias("first"))
    parts = parts.where("salt > 0 OR size > 1").select("fp", "salt", "size", "first", F.sha2("body", 256).alias("sha"), F.when(F.col("salt") > 0, F.col("body")).alias("body"))
    parts = staged(parts, "exact-parts")
    cold = _groups(parts.where("salt = 0"), "n")
    frequent = parts.where("salt > 0").groupBy("fp", "body").agg(F.sum("size").alias("size"), F.min("first").alias("first"), F.min("sha").alias("sha"))
    # Frequent fingerprints number at most HOT, and so (but for collisions of them) do their texts.
    near = F.broadcast(_groups(frequent, "n"))
    slim = rows.withColumn("again", F.col("body").isNotNull()).select("doc_id", "row", "fp", "salt", "text_sha256", "again")
    met = lambda some, groups: some.join(groups.withColumnRenamed("fp", "group_fp"), (F.col("fp") == F.col("group_fp")) & (F.col("text_sha256") == F.col("sha")), "left")
    alone = slim.where("NOT again").withColumns({"keep_id": F.col("doc_id"), "keep_row": F.col("row"), "n": F.lit(None).cast("long")})
    names = ["doc_id", "row", "text_sha256", "keep_id", "keep_row", "n"]
    out = alone.select(names).union(met(slim.where("again AND salt = 0"), cold).select(names)).union(met(slim.where("again AND salt > 0"), near).select(names))
    single = F.col("n").isNull()
    return out.select(
        "doc_id", "row", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts."""
    (row,) = fresh(docs, "row_number")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "exact-docs")
    kept = exact_groups(rows.select("doc_id", "text", row), row).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
ranked AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY body) AS group_size
  FROM d WINDOW w AS (PARTITION BY body ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM ranked
"""
