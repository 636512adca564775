"""Embedding near-dedup with a pivot-permutation index.

Reference points are vectors of a bounded sample, thinned so that no two are close (a crowd of near
copies gets one, not many); there are about as many as the root of the number of vectors, from
LEAST_PIVOTS to MOST_PIVOTS. Every vector is described by its nearest ones in order, NEAREST of
LEAST_PIVOTS and one more for each time that the number of reference points doubles. The inverted
lists are those of pairs of reference points: a vector stands, within its label, in the list of every
pair among its nearest of which at least one is among the first (LEAD, and one more every three times
that the number doubles). So two vectors meet if they share two reference points that are near enough
the front of both orders, and as pairs outnumber the vectors, a list stays short however many vectors
there are. A pair of vectors that meets in several lists counts in the first one.

At a cosine of exactly 0.93 the lists hold 99 % of planted pairs of 32 to 128 random components, from
256 to 16,384 reference points (15 to 50 lists a vector); of the links of the tables, which are closer, all.

Lists over BLOCK vectors are cut into blocks, and pairs of blocks are separate tasks that return a
link count and a local root a vector: cosines are verified in double precision but never listed.

Equal vectors of a label are one class with a multiplicity, which counts in the links.

Defined results: a vector whose id, label or components are null, that is empty or zero or has
non-finite components links with nothing and is its own component; only vectors of equal length
are compared; repeated rows are further vectors of the class; an empty table gives an empty
result; further columns are ignored. Vectors meet their class by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.shared import connected_components, staged, table

COSINE = 0.93
LEAST_PIVOTS, MOST_PIVOTS = 256, 16_384
APART = 0.6
NEAREST, LEAD = 7, 3
BLOCK = 512
TASK_ROWS = 20_000
#: Pairs of vectors whose lists are compared at once.
PAIRS = 20_000
#: A vector that one row in HOT equals is told by a broadcast of at most HOT rows.
HOT = 1000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _fitted(rows: list, width: int) -> np.ndarray:
    """Rows of any length as a matrix of width columns, cut or filled with zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        n = min(width, len(x))
        out[i, :n] = x[:n]
    return out


def thinned(vectors: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """Unit vectors in turn, without those that are closer than apart to one before."""
    out = np.zeros((0, vectors.shape[1]))
    for at in range(0, len(vectors), 256):
        part = vectors[at : at + 256]
        part = part[(part @ out.T < apart).all(axis=1)]
        near = part @ part.T
        keep: list[int] = []
        for k in range(len(part)):
            if (near[k, keep] < apart).all():
                keep.append(k)
        out = np.concatenate([out, part[keep]])
        if len(out) >= most:
            break
    return out[:most]


def places(pivots: int) -> list[tuple[int, int]]:
    """Which two places in the order of the nearest make a list. Orders of more reference points agree less, so
    more places are taken."""
    doubled = max(0, int(np.ceil(np.log2(pivots / LEAST_PIVOTS))))
    nearest = min(pivots, NEAREST + doubled)
    return [(i, j) for i in range(LEAD + -(-doubled // 3)) for j in range(i + 1, nearest)] or [(0, 0)]


def list_keys(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The lists of each vector, in ascending order: pairs of its nearest reference points."""
    away, chosen = -(vectors @ pivots.T), places(len(pivots))
    count = max(j for _, j in chosen) + 1
    first = np.sort(np.argpartition(away, count - 1, axis=1)[:, :count], axis=1).astype(np.int64)
    order = np.argsort(np.take_along_axis(away, first, axis=1), axis=1, kind="stable")
    first = np.take_along_axis(first, order, axis=1)
    a, b = (first[:, [p[k] for p in chosen]] for k in (0, 1))
    keys = np.minimum(a, b) << 32 | np.maximum(a, b)
    keys.sort(axis=1)
    return keys


def _described(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                keys = list_keys(_fitted([x.values.to_numpy(zero_copy_only=False) for x in part.column(at)], pivots.shape[1]), pivots)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.record_batch([*part.columns, flat], [*batch.schema.names, "lists"])

    return run


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of the same run, for runs of these sizes one after the other."""
    n, ends = int(sizes.sum()), np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(n) - 1
    i = np.repeat(np.arange(n), left)
    return i, np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left) + i + 1


def _linked(x: np.ndarray, lists: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows are close enough and share no list before the one they stand in here."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        close = np.flatnonzero(np.einsum("ij,ij->i", x[a], x[b]) >= cosine)
        a, b = a[close], b[close]
        shared = (lists[a][:, :, None] == lists[b][:, None, :]).any(axis=2)
        first = lists[a][np.arange(len(a)), shared.argmax(axis=1)] == here[a]
        out[at + close[first]] = True
    return out


def _verified(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label", "ascending"), ("list", "ascending")])
        key, many, here, label = (group[c].to_numpy() for c in ("key", "many", "list", "label"))
        x = _unit(np.stack([v.values.to_numpy() for v in group["embedding"]]).astype(np.float64))
        lists = np.stack([v.values.to_numpy() for v in group["lists"]])
        if group["left"][0].as_py() == group["right"][0].as_py():
            new = np.flatnonzero(np.append(True, (here[1:] != here[:-1]) | (label[1:] != label[:-1])))
            i, j = pairs_within(np.diff(np.append(new, len(key))))
        else:
            side = group["block"].to_numpy() == group["left"].to_numpy()
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        own = _linked(x, lists, here, i, j, cosine)
        i, j = i[own], j[own]
        links = np.bincount(i, weights=many[j], minlength=len(key)) + np.bincount(j, weights=many[i], minlength=len(key))
        # A vector has a row a list; its rows are one for the roots.
        names, at = np.unique(key, return_inverse=True)
        root = names[roots_of(len(names), at[i], at[j])[at]]
        hit = np.flatnonzero(links)
        return pa.table({"key": key[hit], "links": links[hit].astype(np.int64), "root": root[hit]})

    return run


def pivot_links(classes: DataFrame, cosine: float = COSINE, pivots: int | None = None) -> DataFrame:
    """(key, links, root) from classes (key, label, embedding, many): verified links by block pair."""
    count = classes.count()
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(max(1, count)) / 2))))
    sample = classes.orderBy(F.xxhash64("key", F.lit("pivot"))).limit(2 * pivots).select("embedding").toArrow()["embedding"]
    rows = [x.values.to_numpy(zero_copy_only=False) for x in sample]
    width = max([1, *map(len, rows)])
    points = thinned(_unit(_fitted(rows, width)), pivots) if rows else np.zeros((1, width))
    described = classes.mapInArrow(_described(points), f"{_ddl(classes)}, lists array<long>")
    listed = described.select("*", F.size("embedding").alias("width"), F.explode("lists").alias("list"))
    sizes = listed.groupBy("label", "width", "list").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    blocked = listed.join(sizes, ["label", "width", "list"])
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    paired = paired.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    # Lists of one block share tasks of about TASK_ROWS rows, a block pair of a longer one is a task.
    shared = F.pmod(F.xxhash64("label", "list"), F.lit(max(1, -(-count * len(places(len(points))) // TASK_ROWS))))
    paired = paired.withColumn("task", F.when(F.col("blocks") == 1, shared).otherwise(-1 - F.abs(F.xxhash64("label", "list") / 2).cast("long")))
    task = ["width", "task", "left", "right"]
    return paired.select(*task, "label", "list", "block", "key", "many", "embedding", "lists").groupBy(*task).applyInArrow(_verified(cosine), "key long, links long, root long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def near_dup_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label)."""
    sound = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    key = F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding")).alias("key")
    rows = vectors.select("vec_id", "label", "embedding", key)
    classes = rows.where("key IS NOT NULL").groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    classes = staged(classes, "vector-classes")
    found = staged(pivot_links(classes.select("key", "label", "embedding", "many"), cosine), "vector-links")
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = classes.select("key", "rep", "many").join(links, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
    joined = joined.select("key", "rep", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    heads = joined.groupBy("root").agg(F.min("rep").alias("head"))
    named = joined.join(heads, "root").select("key", "many", "n_links", "head")
    named = staged(named, "vector-named")
    hot = F.broadcast(named.where(F.col("many") * HOT >= rows.count()).withColumn("hot", F.lit(True)))
    columns = ["vec_id", "n_links", "head"]
    # Vectors that link with nothing meet no join, frequent ones a broadcast.
    told = rows.where("key IS NOT NULL").select("vec_id", "key").join(hot, "key", "left")
    rest = told.where("hot IS NULL").select("vec_id", "key").join(named.where(F.col("many") * HOT < rows.count()), "key")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("head"))
    out = told.where("hot").select(*columns).union(rest.select(*columns)).union(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("head").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("head")).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_vectors(table(spark, sf_dir, "embeddings"))
