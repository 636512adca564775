"""Hash trees over multisets of ids: one hash for a group, and the way down to where two tables differ.

Ids are dealt by the leading hex digits of their own hash to leaves; a leaf's hash is over its sorted ids with
their counts, an inner node's over its sixteen children's hashes. Depth grows with the number of ids, so a leaf
keeps LEAF ids or fewer (about) at any size, and repeated ids are one entry. The order of rows does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.layout import hash_key

LEAF = 4096


def depth_for(ids: int, leaf: int = LEAF) -> int:
    """Levels below the root that leaves of this many ids ask for."""
    depth = 0
    while ids > leaf * 16**depth and depth < 12:
        depth += 1
    return depth


def counted(df: DataFrame, by: Sequence[str], id_: str) -> DataFrame:
    """(by, id, n, key): distinct ids with their number; null ids are an id of their own."""
    return df.groupBy(*by, F.col(id_).cast("string").alias("id")).agg(F.count("*").alias("n")).withColumn("key", hash_key(F.coalesce("id", F.lit("\x00null"))))


def hash_tree(df: DataFrame, by: Sequence[str], id_: str, depth: int) -> DataFrame:
    """(by, level, node, ids, rows, h): every node with ids below it. node is the level's hex digits, '' at the root; ids
    are distinct ones, rows counts repeats."""
    entry = F.struct("key", F.concat_ws(":", F.coalesce("id", F.lit("")), F.col("n").cast("string")).alias("x"))
    leaves = counted(df, by, id_).groupBy(*by, F.substring("key", 1, depth).alias("node")).agg(
        F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"])), 256).alias("h"), F.count("*").alias("ids"), F.sum("n").alias("rows"))
    level = leaves.select(*by, F.lit(depth).alias("level"), "node", "ids", "rows", "h")
    out = level
    for k in range(depth - 1, -1, -1):
        child = F.array_sort(F.collect_list(F.struct("node", "h")))
        joined = F.array_join(F.transform(child, lambda c: F.concat(c["node"], F.lit("="), c["h"])), ",")
        level = level.groupBy(*by, F.substring("node", 1, k).alias("node")).agg(F.sha2(joined, 256).alias("h"), F.sum("ids").alias("ids"), F.sum("rows").alias("rows")).select(*by, F.lit(k).alias("level"), "node", "ids", "rows", "h")
        out = out.union(level)
    return out


def root(tree: DataFrame) -> DataFrame:
    return tree.where("level = 0").drop("level", "node")


def differing(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, level, node, left_rows, right_rows) of all nodes of two trees of one depth whose hashes differ; a side
    without the node has no rows there."""
    keys = [*by, "level", "node"]
    a, b = (t.select(*(F.col(k).alias(f"{s}_{k}") for k in keys), F.col("rows").alias(f"{s}_rows"), F.col("h").alias(f"{s}_h")) for s, t in (("l", left), ("r", right)))
    same = F.lit(True)
    for k in by:
        same &= F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    same &= (F.col("l_level") == F.col("r_level")) & (F.col("l_node") == F.col("r_node"))
    both = a.join(b, same, "full").where(~F.col("l_h").eqNullSafe(F.col("r_h")))
    names = [F.when(F.col("l_h").isNotNull(), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k) for k in keys]
    return both.select(*names, F.coalesce("l_rows", F.lit(0)).alias("left_rows"), F.coalesce("r_rows", F.lit(0)).alias("right_rows"))


def differing_ids(left: DataFrame, right: DataFrame, by: Sequence[str], id_: str, depth: int) -> DataFrame:
    """(by, id, left_n, right_n) of ids whose numbers differ. Trees of both sides tell the leaves that differ, and only
    ids of those are compared."""
    leaves = differing(hash_tree(left, by, id_, depth), hash_tree(right, by, id_, depth), by).where(F.col("level") == depth).select(*by, "node")
    side = None
    for df, n, m in ((left, F.col("n"), F.lit(0)), (right, F.lit(0), F.col("n"))):
        rows = counted(df, by, id_).withColumn("node", F.substring("key", 1, depth)).select(*by, "node", "id", n.alias("left_n"), m.alias("right_n"))
        side = rows if side is None else side.union(rows)
    met = F.lit(True)
    other = leaves.select(*(F.col(c).alias(f"_{c}") for c in (*by, "node")))
    for c in (*by, "node"):
        met &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return side.join(other, met, "left_semi").groupBy(*by, "id").agg(F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n")).where("left_n <> right_n")
