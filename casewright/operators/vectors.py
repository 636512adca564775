"""Reductions of vectors: norms, pairwise products, centring, count sketches, group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import quantiles

BUCKET_FACTOR, SIGN_FACTOR = 1103515245, 214013


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def gram(vectors: DataFrame, group: str, name: str, vector: str) -> DataFrame:
    """(group, left, right, dot, cosine) for every pair of names in a group; groups are a few vectors."""
    side = lambda s: vectors.select(F.col(group), F.col(name).alias(s), F.col(vector).alias(f"_{s}"))
    pairs = side("left").join(side("right"), group).where(F.col("left") <= F.col("right"))
    return pairs.select(group, "left", "right", dot(F.col("_left"), F.col("_right")).alias("dot"), cosine(F.col("_left"), F.col("_right")).alias("cosine"))


def centred(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """vectors with residual: the vector minus its group's mean at every position."""
    long = vectors.select(group, F.posexplode(vector).alias("_i", "_v"))
    means = long.groupBy(group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    listed = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_mean"))
    return vectors.join(listed, group).withColumn("residual", F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")


def module_norms(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, module, norm): norms of consecutive blocks of positions."""
    long = vectors.select(key, F.posexplode(vector).alias("_i", "_v"))
    return long.groupBy(key, F.floor(F.col("_i") / width).cast("int").alias("module")).agg(F.sqrt(F.sum(F.col("_v").cast("double") * F.col("_v").cast("double"))).alias("norm"))


def count_sketch(vectors: DataFrame, key: str, vector: str, size: int, salt: int) -> DataFrame:
    """(key, bucket, value): signed sums of the positions that hash to a bucket."""
    long = vectors.select(key, F.posexplode(vector).alias("_i", "_v"))
    at = F.col("_i").cast("bigint")
    bucket = F.pmod(at * BUCKET_FACTOR + salt, F.lit(size))
    sign = F.when((at * SIGN_FACTOR + salt // 7).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    return long.groupBy(key, bucket.alias("bucket")).agg(F.sum(F.col("_v").cast("double") * sign).alias("value"))


def finite_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, median, min, max and share of positives of the finite values; null where there are none. The
    median is exact, and no group's values are held together for it."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    stats = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg((v > 0).cast("double")).alias("positive"))
    middle = quantiles.medians(df.withColumn("_finite", v), "_finite", *keys).toDF(*(f"_m{i}" for i in range(len(keys))), "median")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_m{i}"))
    out = stats.join(middle, same, "left") if keys else stats.join(F.broadcast(middle), F.lit(True), "left")
    return out.select(*keys, "n", "mean", "median", "low", "high", "positive")


def flatten_metrics(df: DataFrame, matrix: str, left: str) -> DataFrame:
    """df with one row an entry of one row of a nested map matrix: (exposure, value)."""
    return df.select(*[c for c in df.columns if c != matrix], F.explode(F.col(matrix)[left]).alias("exposure", "value"))
