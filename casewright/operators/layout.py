"""Deterministic orders, quotas, samples and deduplication.

Every shuffle is an order by SHA-256 of seed and key, so a layout is the same on any cluster.
Ranks over a whole table are taken in buckets of the hash's leading digits, or of ranges of a key: each
bucket is sorted in its own task, and offsets come from the table of bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of parts joined by '|'; text parts are literals."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def unit(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from 52 bits of the hash: exact in a double."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """df with its row number by order within the columns by (which should split the data)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Rows that one task is to sort, hash or list at most (about).
BLOCK_ROWS = 50_000


#: Leading hex digits of a hash that make a bucket: of 10^11 rows one has some 1.5 million, and no job has to count first.
DIGITS = 4


def bucket_ranked(df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str = "position", by: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """df with its row number by order, over the whole table or within by; bucket must not fall as order rises.

    Buckets are ranked in tasks of their own, offsets come from the table of their counts. counted has rows with the
    same columns by and bucket, if they can be had by less work than df itself.
    """
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    counts = (df if counted is None else counted).groupBy(*by, bucket.alias("_b")).agg(F.count("*").alias("_n"))
    offsets = counts.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_before"))
    same = F.col("l._b").eqNullSafe(F.col("o._b"))
    for c in by:
        same &= F.col(f"l.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
    met = df.withColumn("_b", bucket).withColumn("_r", inside).alias("l").join(offsets.alias("o"), same)
    return met.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col("o._before") + F.col("l._r")).alias(name))


def hash_ranked(df: DataFrame, seed: str, key: str, name: str = "position", by: Sequence[str] = (), digits: int = DIGITS, counted: DataFrame | None = None) -> DataFrame:
    """df with its row number in the order of hash and key, in buckets of the hash's leading digits."""
    hashed = hash_key(seed, F.col(key))
    return bucket_ranked(df, F.substring(hashed, 1, digits), [hashed, key], name, by, counted)


def key_ranked(df: DataFrame, key: str, name: str = "position", by: Sequence[str] = (), width: int = BLOCK_ROWS) -> DataFrame:
    """df with its row number in the order of an integer key (nulls first), in buckets of width values of the key."""
    return bucket_ranked(df, F.floor(F.col(key) / width), [key], name, by)


def first_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of the rows of a key the one of the lowest position; partial aggregates, no sort."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(position)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(position)).alias("_row")).select("_row.*")


def quota_value(position: Column, quotas: Sequence[tuple[str, int]]) -> Column:
    """The value whose running quota a 1-based position falls into; null beyond all quotas."""
    upto, chain = 0, None
    for value, count in quotas:
        upto += count
        chain = F.when(position <= upto, value) if chain is None else chain.when(position <= upto, value)
    return chain


def largest_remainder(total: int, weights: dict[str, float], least: int = 1) -> dict[str, int]:
    """Integer counts in the proportions of weights that add up to total; ties go in list order."""
    if total < least * len(weights):
        raise ValueError(f"{total} is too few for {len(weights)} values")
    whole = sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()}
    counts = {k: max(least, int(x)) for k, x in exact.items()}
    order = sorted(weights, key=lambda k: -(exact[k] - int(exact[k])))
    while sum(counts.values()) < total:
        for k in order:
            if sum(counts.values()) < total:
                counts[k] += 1
    while sum(counts.values()) > total:
        counts[max(counts, key=lambda k: counts[k])] -= 1
    return counts


def sample_exactly(df: DataFrame, seed: str, key: str, k: int) -> DataFrame:
    """The k rows first in hash order (all, if there are no more)."""
    return df.orderBy(hash_key(seed, F.col(key)), key).limit(k)


def sample_with_repeats(df: DataFrame, seed: str, key: str, n: int, k: int) -> DataFrame:
    """k rows of df's n with copy from 1: without replacement if k <= n, else every row floor or ceil of k / n times."""
    many = hash_ranked(df, seed, key, "_place").withColumn("_times", F.lit(k // n) + (F.col("_place") <= k % n).cast("int")).where("_times > 0")
    return many.select(*df.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("copy"))


def zipped(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Positional join; raises if the positions of one side are missing on the other."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), position, "full")
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("sides differ in length"))).otherwise(F.lit(True))
    return joined.where(checked).drop("_l", "_r")


def block_hash(df: DataFrame, by: Sequence[str], id_: str, order: Column, block: Column, name: str = "h") -> DataFrame:
    """(by, name): SHA-256 of the list of block hashes of a group, in the order of block; a block's
    hash is the SHA-256 of the JSON list of its ids in order. block must not fall as order rises.

    Only the ids of a block and the blocks of a group are ever listed in one row.
    """
    rows = df.select(*by, block.alias("_block"), F.struct(order.alias("o"), F.col(id_).cast("string").alias("id")).alias("_x"))
    listed = F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["id"])
    blocks = rows.groupBy(*by, "_block").agg(F.sha2(F.to_json(listed), 256).alias("_h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_h"))), lambda x: x["_h"]), "")
    return blocks.groupBy(*by).agg(F.sha2(joined, 256).alias(name))


def ordered_hash(df: DataFrame, by: Sequence[str], id_: str, position: str, name: str = "h", rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, name): a hash of the ids of each group in the order of the 1-based position."""
    at = F.col(position)
    return block_hash(df, by, id_, at, F.floor((at - 1) / rows), name)


def multiset_hash(df: DataFrame, by: Sequence[str], id_: str, name: str = "h", digits: int = 3) -> DataFrame:
    """(by, name): a hash of the ids of each group, whatever their order was; blocks go by the ids' hashes."""
    key = hash_key(F.col(id_))
    return block_hash(df, by, id_, F.concat(key, F.lit("|"), F.col(id_).cast("string")), F.substring(key, 1, digits), name)


def token_hash(tokens: Column) -> Column:
    """SHA-256 of the compact JSON of a token list."""
    return F.sha2(F.to_json(tokens), 256)


def phase_exposure(fraction: Column, draw: Column, phases: Sequence[tuple[float, Sequence[tuple[str, float]]]]) -> Column:
    """A weighted draw whose weights depend on how far along (0 to 1) a row stands."""
    chain = None
    for end, weights in phases:
        upto, pick = 0.0, None
        for value, weight in weights[:-1]:
            upto += weight
            pick = F.when(draw < round(upto, 10), value) if pick is None else pick.when(draw < round(upto, 10), value)
        pick = F.lit(weights[-1][0]) if pick is None else pick.otherwise(weights[-1][0])
        chain = F.when(fraction < end, pick) if chain is None else chain.when(fraction < end, pick)
    return chain
