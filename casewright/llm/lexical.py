"""Ranked lexical search over document shards.

A shard holds up to SHARD_DOCS documents in ascending order of doc_id and their postings by term: row numbers and
precomputed integer impacts. Impacts need the number of documents and their mean length, so one pass over the texts
counts these before the shards are made. The index is a table with one row a shard and term, of at most SHARD_DOCS
postings, and one row a shard with its doc_ids; it is written to the shared folder and serves any number of queries.
So no reader or writer holds more than a few such rows at a time, whatever a partition holds. Terms are kept
whole, not hashed.

A search takes the queries in blocks of at most BLOCK_TERMS terms (one long query may be a block of its own).
Rows of a block's terms are picked by a broadcast join; their lengths give the terms' document counts. They are
dealt by shard, and every task adds, a shard at a time, the weighted impacts of a query's terms, term at a time, into one
dense array. The top k of a shard are found by
argpartition; of documents with the least score that still belongs to them those of the lowest row number are
taken, which are those of the smallest doc_id. A task merges the top k of its shards, and the rows of all tasks
(at most k a query and task) are ranked per query, first within PARTS parts.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.

Defined results: null and empty texts (or texts without a term) are no documents and no queries; a null
doc_id ranks after all others of its score; rows that share a doc_id are documents of their own; rows of queries
that share an id (null included) are one query with the terms of all; scores of 0 are left out; an empty table
on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import slices, staged, table, text_arrays

TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in TERM_BYTES else 0x20 for b in range(256))
#: A shard ends at so many documents or postings, whichever comes first; a longer document is one by itself.
SHARD_DOCS, SHARD_POSTINGS = 2048, 1 << 18
BLOCK_TERMS = 1 << 18
PARTS = 32


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; long texts are taken in slices."""
    found: Counter = Counter()
    for part in slices(text.translate(FOLD)):
        found.update(part.split())
    return found


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for x in text_arrays(batch, "text"):
            n = sum(len(part.split()) for part in slices(x.as_py().translate(FOLD)))
            docs, total = docs + (n > 0), total + n
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms)."""
    found = docs.select("text").mapInArrow(_count_batches, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    return found["docs"] or 0, found["total"] or 0


def _shard(ids: list, counts: list[Counter], size: tuple[int, int], kind: pa.DataType) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    vocabulary: dict[bytes, int] = {}
    code = vocabulary.setdefault
    lengths = np.array([len(counts[i]) for i in order], np.int64)
    term = np.fromiter((code(t, len(vocabulary)) for i in order for t in counts[i]), np.int64, int(lengths.sum()))
    tf = np.fromiter((n for i in order for n in counts[i].values()), np.int64, len(term))
    row = np.repeat(np.arange(len(order)), lengths)
    n_terms = np.array([sum(counts[i].values()) for i in order], np.int64)
    docs, total = size
    m = 50 + (50 * n_terms * docs) // max(total, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
    names = sorted(vocabulary)
    place = np.empty(len(names), np.int64)
    place[np.fromiter((vocabulary[t] for t in names), np.int64, len(names))] = np.arange(len(names))
    by_term = np.argsort(place[term], kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(place[term], minlength=len(names)))))
    whole = lambda values, t: pa.array([values], pa.list_(t))
    columns = [whole([ids[i] for i in order], kind), whole(names, pa.binary()), whole(starts.astype(np.int32), pa.int32()), whole(row[by_term].astype(np.int32), pa.int32()), whole(impact[by_term].astype(np.int32), pa.int32())]
    return pa.record_batch(columns, ["ids", "terms", "starts", "rows", "impacts"])


def _shard_batches(size: tuple[int, int], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, postings = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), text_arrays(batch, "text")):
                found = term_counts(x.as_py())
                if not found:
                    continue
                if ids and (len(ids) >= SHARD_DOCS or postings + len(found) > SHARD_POSTINGS):
                    yield _shard(ids, counts, size, kind)
                    ids, counts, postings = [], [], 0
                ids.append(i)
                counts.append(found)
                postings += len(found)
        if ids:
            yield _shard(ids, counts, size, kind)

    return run


def _index_batches(size: tuple[int, int], kind: pa.DataType):
    """Rows of the index: a shard's doc_ids (without a term), then each term's postings."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, shard in enumerate(_shard_batches(size, kind)(batches)):
            ids, terms, starts, rows, impacts = (_lists(shard, name, 0) for name in shard.schema.names)
            n = len(terms)
            number = lambda count: pa.array(np.full(count, first + k, np.int64))  # noqa: E731, B023
            nothing = lambda t, count: pa.nulls(count, t)
            ints = pa.list_(pa.int32())
            names = ["shard", "term", "ids", "rows", "impacts"]
            whole = pa.array([ids.to_pylist()], pa.list_(kind))
            yield pa.record_batch([number(1), nothing(pa.binary(), 1), whole, nothing(ints, 1), nothing(ints, 1)], names)
            of = lambda values: pa.ListArray.from_arrays(starts, values)  # noqa: E731, B023
            yield pa.record_batch([number(n), terms, nothing(pa.list_(kind), n), of(rows), of(impacts)], names)

    return run


class Index:
    """Rows of shards as a table, with the number of documents and terms that their impacts rest on."""

    def __init__(self, shards: DataFrame, docs: int, total: int):
        self.shards, self.docs, self.total = shards, docs, total


def index(docs: DataFrame) -> Index:
    """The index of docs' doc_id and text."""
    from pyspark.sql.pandas.types import to_arrow_type

    size = corpus_size(docs)
    key = docs.schema["doc_id"].dataType
    schema = f"shard long, term binary, ids array<{key.simpleString()}>, rows array<int>, impacts array<int>"
    shards = docs.select("doc_id", "text").mapInArrow(_index_batches(size, to_arrow_type(key)), schema)
    return Index(staged(shards, "lexical-shards"), *size)


def _lists(batch: pa.RecordBatch, name: str, i: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))[i].values


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores above 0, of equal ones those of lowest number; highest first."""
    some = np.nonzero(scores)[0]
    if len(some) > k:
        values = scores[some]
        least = values[np.argpartition(values, len(values) - k)[len(values) - k]]
        sure, tied = some[values > least], some[values == least]
        some = np.concatenate((sure, tied[: k - len(sure)]))
    return some[np.lexsort((some, -scores[some]))]


def _search_batches(queries, k: int, kind: pa.DataType):
    """queries: for each query the places of its terms, and their weights. Batches (shard, place, ids, rows, impacts) are in
    order of shard and place; a shard's doc_ids come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.value]
        rank = lambda found: (-found[0], found[1] is None, found[1] if found[1] is not None else 0)
        for ids, postings in _by_shard(batches):
            for q, (of, weights) in enumerate(queries.value):
                scores = np.zeros(len(ids), np.int64)
                for t, w in zip(of.tolist(), weights.tolist()):
                    if w and t in postings:
                        rows, impacts = postings[t]
                        scores[rows] += w * impacts
                for r in top(scores, k).tolist():
                    best[q].append((int(scores[r]), ids[r].as_py()))
                if len(best[q]) > k:
                    best[q] = sorted(best[q], key=rank)[:k]
        found = [(q, s, d) for q, rows in enumerate(best) for s, d in rows]
        columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], kind), pa.array([f[1] for f in found], pa.int64())]
        yield pa.record_batch(columns, ["query", "doc_id", "score"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(doc_ids, rows and impacts by the term's place) of one shard after the other."""
    at, ids, postings = None, None, {}
    for batch in batches:
        shard, place = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, impacts = batch.column(3), batch.column(4)
        for i, (s, p) in enumerate(zip(shard, place)):
            if s != at:
                if postings:
                    yield ids, postings
                at, postings = s, {}
            if p < 0:
                ids = batch.column(2)[i].values
            else:
                # Copies, so that a batch is not kept for a few of its rows.
                postings[p] = rows[i].values.to_numpy().copy(), impacts[i].values.to_numpy().astype(np.int64)
    if postings:
        yield ids, postings


def _query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(term_counts(x.as_py())) for x in text_arrays(batch, "text")]
        yield pa.record_batch([batch.column(batch.schema.get_field_index("item_id")), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _blocks(queries: DataFrame) -> Iterator[list]:
    """(item_id, terms) of the queries in blocks of at most BLOCK_TERMS terms."""
    kind = queries.schema["item_id"].dataType.simpleString()
    asked = queries.select("item_id", "text").mapInArrow(_query_batches, f"item_id {kind}, terms array<binary>")
    asked = asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    block, size = [], 0
    for r in staged(asked, "lexical-queries").toLocalIterator():
        if block and size + len(r["terms"]) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], [bytes(t) for t in r["terms"]]))
        size += len(r["terms"])
    if block:
        yield block


def search(found: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query (item_id, text) the k documents of highest score above 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    key = found.shards.schema["ids"].dataType.elementType
    item = queries.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {item.simpleString()}, rank int, doc_id {key.simpleString()}, score long")
    for block in _blocks(queries):
        names = sorted({t for _, of in block for t in of})
        place = {t: i for i, t in enumerate(names)}
        asked = F.broadcast(spark.createDataFrame(list(enumerate(names)), "place long, term binary"))
        postings = found.shards.select("shard", "term", "rows", "impacts").join(asked, "term")
        df = np.zeros(len(names), np.int64)
        for r in postings.groupBy("place").agg(F.sum(F.size("rows")).alias("df")).toLocalIterator():
            df[r["place"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * found.docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
        places = [np.array([place[t] for t in of], np.int64) for _, of in block]
        told = spark.sparkContext.broadcast([(p, weight[p]) for p in places])
        owners = found.shards.where("term IS NULL").select("shard", F.lit(-1).cast("long").alias("place"), "ids", F.lit(None).cast("array<int>").alias("rows"), F.lit(None).cast("array<int>").alias("impacts"))
        dealt = owners.unionByName(postings.drop("term"), allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "place")
        hits = dealt.mapInArrow(_search_batches(told, k, to_arrow_type(key)), f"query long, doc_id {key.simpleString()}, score long")
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        parts = hits.withColumn("part", F.spark_partition_id() % PARTS)
        few = parts.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*best))).where(F.col("r") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query long, item_id {item.simpleString()}")
        out = out.union(ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


ORACLE = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), size),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), size GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
