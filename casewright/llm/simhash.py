"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments. The perfect binary Golay code maps
every 23-bit word to the one codeword within distance 3, so two words at distance 2 or less
share a codeword index among those of the word itself and of its one-bit neighbours (one or six
of them). Two fingerprints that differ in at most two bits agree wholly in some segment
(pigeonhole) and differ in at most two bits in the next one: each fingerprint gets the keys
(segment, its bits, a codeword index of the next segment), equal keys are candidates, and
candidates are verified on all 64 bits.

Defined results: null and empty texts have fingerprint zero and link like any other; a null
doc_id never becomes a component_id unless its whole component has none; repeated rows keep one
output row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import connected_components, fresh, staged, table, text_arrays

MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code; a fixed value.
GOLAY = 0xC75
BLOCK = 1 << 16
#: A fingerprint of at least one in HOT documents is frequent; there are at most HOT of those.
HOT = 1000


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of whole text: bit set where over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(shingle_words, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), stops[at : at + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle_words) for x in text_arrays(batch, "text")], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return run


@lru_cache(1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high 12 bits of a word, and the error pattern of each syndrome."""
    residue = []
    for bit in range(23):
        r = 1 << bit
        for shift in range(bit, 10, -1):
            if r >> shift & 1:
                r ^= GOLAY << (shift - 11)
        residue.append(r)
    low, high = (np.zeros(4096, np.int64) for _ in range(2))
    for table_, first in ((low, 0), (high, 12)):
        for k in range(12):
            if first + k < 23:
                table_[(np.arange(4096) >> k & 1) == 1] ^= residue[first + k]
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= residue[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return low, high, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay_tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and its one-bit neighbours."""
    near = np.stack([golay_index(words)] + [golay_index(words ^ (1 << b)) for b in range(width)], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, cols = np.nonzero(first)
    return rows, near[rows, cols]


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = fps.view(np.uint64)
        parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
        for k in range(3):
            other = (k + 1) % 3
            rows, index = fuzzy_indices(parts[other], SEGMENTS[other][1])
            keys = (k << 36) | (parts[k][rows] << 12) | index
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(fps[rows], pa.int64())], ["key", "fp"])


def _ball_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        centres = (fps.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
        yield pa.record_batch([pa.array(centres.view(np.int64), pa.int64()), pa.array(np.repeat(fps, 65), pa.int64())], ["centre", "fp"])


def _row_fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle_words) for x in text_arrays(batch, "text")], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64), pa.int64())], ["row", "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(shingle_words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints of the column fp reachable at two or fewer differing bits.

    A bucket of two is one candidate pair. Fingerprints of larger buckets are grouped by the
    words within one bit of them: two fingerprints share such a centre exactly if they differ in
    at most two bits, and a centre has at most 65, so a bucket of any size costs 65 rows a member
    and no pairs are listed.
    """
    bucket = Window.partitionBy("key")
    keys = distinct.mapInArrow(_key_batches, "key long, fp long")
    met = staged(keys.select("fp", F.min("fp").over(bucket).alias("a"), F.max("fp").over(bucket).alias("b"), F.count("*").over(bucket).alias("n")).where("n > 1"), "simhash-met")
    pairs = met.where("n = 2 AND fp = a").select("a", "b")
    crowded = met.where("n > 2").select("fp").distinct()
    centres = crowded.mapInArrow(_ball_batches, "centre long, fp long")
    stars = centres.select(F.min("fp").over(Window.partitionBy("centre")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.union(stars).where(F.bit_count(F.expr("a ^ b")) <= MAX_BITS).distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable by links of two bits or fewer."""
    found = staged(fingerprints(docs, shingle_words), "simhash")
    classes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(links(classes.select("fp")))
    members = roots.join(classes, roots.node == classes.fp).select("fp", "root", "rep")
    heads = members.groupBy("root").agg(F.min("rep").alias("head"))
    linked = members.join(heads, "root").select("fp", "head")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("head", "rep").alias("component_id"), F.col("n") * HOT >= found.count())
    named = staged(named.toDF("fp", "component_id", "hot"), "simhash-named")
    # Frequent fingerprints are told in a broadcast of at most HOT rows, the others by a join.
    told = found.join(F.broadcast(named.where("hot").select("fp", "component_id", "hot")), "fp", "left")
    rest = told.where("hot IS NULL").select("doc_id", "fp").join(named.where("NOT hot").select("fp", "component_id"), "fp")
    return told.where("hot").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))


def near_dedup(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """docs without the near copies: of each component one row stays, that of the smallest doc_id (rows
    without one come last). Rows are told apart by numbers of their own, so a doc_id that stands for
    several texts stays once for each of their components."""
    (row,) = fresh(docs, "row_number")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    key = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select(row, "doc_id", "text").mapInArrow(_row_fingerprints(shingle_words), f"row long, doc_id {key}, fp long")
    found = staged(found, "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = staged(found.groupBy("fp").agg(first), "simhash-classes")
    roots = connected_components(links(classes.select("fp")))
    heads = classes.join(roots, classes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = heads.select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
