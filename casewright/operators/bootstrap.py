"""The case bootstrap with exact draws, for any number of cases.

A draw takes as many cases of a skill as there are, with replacement. The numbers in which it takes them are
multinomial, and these split down a tree: of a node's picks a binomial number falls to its left half. Cases are dealt
to leaves by their hash; a task that holds a leaf walks down from the root, all tasks making the same splits on the
way, as a node's random numbers come from its own seed. Within a leaf cases are taken in order, each a binomial share
of what is left. So every draw takes exactly as many cases as there are, no row a draw and case is made, and a
task keeps one vector of draws a skill. The result depends on the seed alone, not on partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.layout import hash_key

#: Leaves are at most 2 ** MOST_DEPTH a skill, so their sizes are a table of bounded length; a leaf of any size is streamed.
LEAF, MOST_DEPTH = 2048, 12
#: Tasks a core that leaves are dealt to, at most.
TASKS = 8
#: Bins of a uniform number in the table of binomials().
BINS = 1024


def generator(*parts: object) -> np.random.Generator:
    """Random numbers that the parts alone determine."""
    digest = hashlib.sha256("|".join(map(str, parts)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))


def leaf_picks(sizes: np.ndarray, leaf: int, draws: int, seed: str, skill: str) -> np.ndarray:
    """For each draw, how many of its picks fall to a leaf; sizes are the cases of all leaves, a power of two of them."""
    picks = np.full(draws, int(sizes.sum()), np.int64)
    first, last, node = 0, len(sizes), 1
    while last - first > 1:
        middle = (first + last) // 2
        left, right = int(sizes[first:middle].sum()), int(sizes[middle:last].sum())
        here = picks if not right else np.zeros_like(picks) if not left else generator(seed, skill, "node", node).binomial(picks, left / (left + right))
        if leaf < middle:
            picks, last, node = here, middle, 2 * node
        else:
            picks, first, node = picks - here, middle, 2 * node + 1
    return picks


def binomials(random: np.random.Generator, n: np.ndarray, p: float) -> np.ndarray:
    """random.binomial(n, p) for many different n and one small p: the same numbers from the same stream, by a table.

    Where n * p is small numpy inverts one uniform number a draw, and prepares anew whenever n changes. Here the sums of
    chances are taken once for every n that occurs; a table tells what a uniform number gives for all of them alike,
    and the others are compared with the sums of their own n. Where numpy would take its other method, or draw a number
    twice, it is asked itself.
    """
    least, most = int(n.min()), int(n.max())
    if not least and most:
        taken, some = np.zeros_like(n), np.flatnonzero(n)
        taken[some] = binomials(random, n[some], p)
        return taken
    if not most or not 0 < p <= 0.5 or most * p > 30 or most - least > len(n):
        return random.binomial(n, p)
    before = random.bit_generator.state
    uniform = random.random(len(n))
    sizes, q, highest = np.arange(least, most + 1, dtype=float), 1 - p, uniform.max()
    bound = min(least, int(least * p + 10 * math.sqrt(least * p * q + 1)))
    chance = np.exp(sizes * math.log1p(-p))
    sums = [chance]
    while sums[-1][-1] < highest:
        x = len(sums)
        if x > bound:
            random.bit_generator.state = before
            return random.binomial(n, p)
        chance = chance * (sizes - (x - 1))
        chance *= p / (x * q)
        sums.append(sums[-1] + chance)
    sums = np.array(sums)
    sure, may = (np.bincount(np.minimum(x, BINS), minlength=BINS + 1).cumsum() for x in ((sums[:, 0] * BINS).astype(np.int64) + 1, (sums[:, -1] * BINS).astype(np.int64)))
    taken = np.where(sure == may, sure, -1).take((uniform * BINS).astype(np.int64))
    open_ = np.flatnonzero(taken < 0)
    taken[open_] = (uniform.take(open_) > sums.take(n.take(open_) - least, axis=1)).sum(axis=0)
    return taken


class Leaf:
    """The cases of one leaf, taken one after the other."""

    def __init__(self, sizes: np.ndarray, leaf: int, draws: int, seed: str, skill: str):
        self.left, self.picks = int(sizes[leaf]), leaf_picks(sizes, leaf, draws, seed, skill)
        self.random = generator(seed, skill, "leaf", leaf)

    def next(self) -> np.ndarray:
        """How often each draw takes the next case."""
        taken = binomials(self.random, self.picks, 1 / self.left) if self.left > 1 else self.picks
        self.left, self.picks = self.left - 1, self.picks - taken
        return taken


def dealt_leaves(values: DataFrame, seed: str, cluster: str) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """((skill, leaf, delta) with each leaf in one task in the order of its keys, cases of each skill's leaves)."""
    rows = values.select(F.col("skill").cast("string").alias("skill"), F.col(cluster).cast("string").alias("cluster"), F.col("delta").cast("double").alias("delta"))
    rows = rows.withColumn("key", hash_key(seed, F.col("skill"), F.col("cluster")))
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    finest: dict[str, np.ndarray] = {}
    for r in rows.groupBy("skill", F.shiftright(high, 32 - MOST_DEPTH).cast("int").alias("leaf")).agg(F.count("*").alias("n")).collect():
        finest.setdefault(r["skill"], np.zeros(1 << MOST_DEPTH, np.int64))[r["leaf"]] = r["n"]
    counts = {skill: int(n.sum()) for skill, n in finest.items()}
    depth = min(MOST_DEPTH, (max(counts.values(), default=1) // LEAF).bit_length())
    rows = rows.withColumn("leaf", F.shiftright(high, 32 - depth).cast("int"))
    sizes = {skill: n.reshape(1 << depth, -1).sum(axis=1) for skill, n in finest.items()}
    # Rows are small and the work on each is large: a number of our own, as tasks sized by bytes would be too few.
    tasks = max(1, min(sum(int((n > 0).sum()) for n in sizes.values()), TASKS * values.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, "skill", "leaf").sortWithinPartitions("skill", "leaf", "key", "cluster").select("skill", "leaf", "delta"), sizes


def case_bootstrap(values: DataFrame, draws: int, seed: str, cluster: str) -> DataFrame:
    """(draw, mean): the mean over skills of the mean of each draw's cases; values is (skill, cluster, delta), one row a
    cluster, without nulls in delta. Skills are few."""
    ordered, sizes = dealt_leaves(values, seed, cluster)
    counts = {skill: int(n.sum()) for skill, n in sizes.items()}
    known = values.sparkSession.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        at, state = None, None
        for batch in batches:
            for skill, leaf, delta in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (skill, leaf) != at:
                    at, state = (skill, leaf), Leaf(known.value[skill], leaf, draws, seed, skill)
                sums.setdefault(skill, np.zeros(draws))
                taken = state.next()
                if delta:
                    sums[skill] += taken * delta
        for skill, total in sums.items():
            yield pa.record_batch([pa.array([skill] * draws), pa.array(np.arange(draws), pa.int64()), pa.array(total)], ["skill", "draw", "s"])

    per = ordered.mapInArrow(run, "skill string, draw long, s double").groupBy("draw", "skill").agg(F.sum("s").alias("s"))
    size = F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("skill")) if counts else F.lit(1)
    return per.groupBy("draw").agg(F.avg(F.col("s") / size).alias("mean"))
