"""Exact medians of groups of any size.

A percentile function that is exact keeps every distinct value of a group in one buffer. Here a sketch of
bounded size first brackets the middle of each group, to a share of 4 / ACCURACY of its values; a second
pass counts the values below the bracket and the distinct ones inside, and the middle is found by adding
up their counts. No task holds a group, and a value that repeats is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def medians(df: DataFrame, value: str, *keys: str, name: str = "median", accuracy: int = ACCURACY) -> DataFrame:
    """(keys, name) with the exact median of value, a number; groups of nulls only have none and NaN counts as largest.

    The sketch's rank is off by n / accuracy at most, so the bracket, twice as wide on either side, holds
    the middle; should it not, the query fails rather than give another value.
    """
    of = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = df.select(*of, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    own = [f"_k{i}" for i in range(len(keys))]
    wide = 2 / accuracy
    sketch = F.percentile_approx("_v", F.array(F.lit(0.5 - wide), F.lit(0.5 + wide)), accuracy)
    bounds = rows.groupBy(*own).agg(sketch.alias("_b"), F.count("*").alias("_n")).select(*(F.col(k).alias(f"{k}b") for k in own), F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"), "_n")
    same = F.lit(True)
    for k in own:
        same &= F.col(k).eqNullSafe(F.col(f"{k}b"))
    met = rows.join(bounds, same) if own else rows.crossJoin(F.broadcast(bounds))
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))
    counted = met.where("_v <= _high").groupBy(*own, "_n", inside.alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*own, "_n").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") >= rank), F.col("_v")))
    low, high = at(F.floor((F.col("_n") + 1) / 2)), at(F.ceil((F.col("_n") + 1) / 2))
    below = F.max(F.when(F.col("_v").isNull(), F.col("_upto")).otherwise(0))
    found = counted.withColumn("_upto", upto).groupBy(*own, "_n").agg(low.alias("_l"), high.alias("_h"), below.alias("_below"))
    held = F.col("_l").isNotNull() & F.col("_h").isNotNull() & (F.col("_below") < F.floor((F.col("_n") + 1) / 2))
    middle = F.when(held, F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.col("_l") / 2 + F.col("_h") / 2)).otherwise(F.raise_error(F.lit("the bracket misses the middle")))
    return found.select(*(F.col(k).alias(o) for k, o in zip(own, keys)), middle.cast("double").alias(name))
