"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates r between 0 and MOST that meet a
source's target, entropy balancing takes those closest to 1 in relative entropy: they are
exponentially tilted, r = min(MOST, exp(lambda * size / mean size)), with one dual variable a
source. The dual is convex and separates by source, so every Newton iteration is one distributed
aggregation over the histogram (source, size); steps that leave the bracket bisect it.

Rates become copies: floor(r) for every document, and one more for so many documents of each
(source, size) that the running sum over sizes never strays more than half a document from the
sum of the fractions; a few passes then close the distance to the target. Which documents, a
hash of the doc_id decides. All sums that decide
anything are exact decimals, so reruns agree.

Defined results: null text and sources without words take nothing; null is a source of its own,
last in order; repeated rows share what their (source, size) gets; an empty table gives an empty
result; further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import WORD, checkpointed, fresh, staged, table

MOST = 2
SALTS = 256
ROUNDS = 60
#: Passes that move a source's words nearer to its target after rounding; true: by one document.
SETTLING = (False, True, False, True, False)
EXACT = "decimal(38,9)"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key that keeps null apart and last by code point."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def row_key() -> Column:
    """The doc_id as text; for rows without one, a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("h"), F.xxhash64("text").cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = MOST) -> DataFrame:
    """(key, source_size, target) from (key, source_size): weights repeat over the sources in code
    point order, targets stop at most times the size, and the excess goes to the others by weight.

    In the order of size / weight the first k sources are full and the others share the rest by
    weight; the level of that share is found with running sums over the table of sources.
    """
    order = Window.orderBy("key")
    number = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), number.cast("int") + 1).cast("double")
    listed = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    below = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    )
    found = listed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # Full sources are a prefix of the ranking; the first that is not full sets the level.
    shared = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(shared * F.col("weight"))
    return found.select("key", "source_size", target.alias("target"))


def tilts(histogram: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(key, tilt): the dual variable of each source that is not taken wholly, by safeguarded Newton."""
    state = goals.where("source_size > 0").where(F.col("target") < most * F.col("source_size"))
    unit = histogram.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = checkpointed(state.join(unit, "key").selectExpr("key", "target", "mean", "0D tilt", "-64D low", "1024D high", "false done"))
    bins = histogram.where("size > 0")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        token = F.col("n") * F.col("size")
        kept = "key", "target", "mean", "tilt", "low", "high"
        moved = bins.join(state, "key").groupBy(*kept).agg(
            F.sum((token * F.least(rate, F.lit(float(most)))).cast(EXACT)).cast("double").alias("taken"),
            F.sum(F.when(rate < most, token * x * rate).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
        ).withColumn("gap", F.col("taken") - F.col("target"))
        moved = moved.withColumn("low", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        settled = F.abs("gap") <= 1e-6 * F.col("target")
        step = F.when(settled, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = checkpointed(moved.select("key", "target", "mean", step.alias("tilt"), "low", "high", (settled | (F.col("high") - F.col("low") < 1e-12)).alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("key", F.col("tilt"), "mean")


def settled(cells: DataFrame, single: bool, most: int = MOST) -> DataFrame:
    """cells (key, size, target, all, copies) with copies changed so that a source's words come nearer
    to its target; copies are those of all documents of a (source, size), at most most each.

    The distance to the target is filled from the largest size that is not above it downwards,
    or (single) by the one document whose size is nearest to it.
    """
    source = Window.partitionBy("key")
    running = source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    taken = F.sum(F.col("size") * F.col("copies")).over(source)
    cells = cells.withColumn("_off", F.round(F.col("target")).cast("long") - taken)
    room = F.when(F.col("_off") > 0, most * F.col("all") - F.col("copies")).otherwise(F.col("copies"))
    reach = (2 * F.abs("_off") - 1) if single else F.abs("_off")
    cells = cells.withColumn("_room", F.when((F.col("size") > 0) & (F.col("size") <= reach), room).otherwise(0))
    if single:
        miss = F.when(F.col("_room") > 0, F.struct(F.abs(F.abs("_off") - F.col("size")), F.col("size")))
        flips = F.coalesce((miss == F.min(miss).over(source)).cast("long"), F.lit(0))
    else:
        before = F.sum(F.col("_room") * F.col("size")).over(running) - F.col("_room") * F.col("size")
        cells = cells.withColumn("_left", F.greatest(F.abs("_off") - before, F.lit(0)))
        flips = F.least(F.col("_room"), F.expr("_left div greatest(size, 1L)"))
    return cells.withColumn("copies", F.col("copies") + F.signum("_off").cast("long") * flips).drop("_off", "_room", "_left")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, copies, keep...), one row per row of docs."""
    rows = docs.select(*keep, "doc_id", row_key().alias("row_key"), source_key(F.col("source")).alias("key"), words(F.col("text")).alias("size"))
    rows = staged(rows.withColumn("draw", F.xxhash64("row_key", F.lit("mix"))).withColumn("salt", F.pmod("draw", F.lit(SALTS))), "mix")
    cells = rows.groupBy("key", "size", "salt").agg(F.count("*").alias("n"))
    histogram = staged(cells.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    sizes = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = staged(targets(sizes, weights, share), "mix-targets")
    tilt = tilts(histogram, goals)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.when(F.col("target") > 0, float(MOST)).otherwise(0.0))
    rate = rate.otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = histogram.join(goals, "key").join(tilt, "key", "left").withColumn("rate", F.round(rate, 9))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("wanted", (F.col("n") * (F.col("rate") - F.floor("rate"))).cast(EXACT))
    running = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("upto", F.round(F.sum("wanted").over(running)).cast("long"))
    extra = F.col("upto") - F.lag("upto", 1, 0).over(Window.partitionBy("key").orderBy("size"))
    rated = rated.select("key", "size", "source_size", "target", F.col("n").alias("all"), (F.col("base") * F.col("n") + extra).alias("copies"))
    for single in SETTLING:
        rated = settled(rated, single)
    rated = rated.withColumn("base", F.expr("copies div all")).withColumn("extra", F.expr("copies % all")).drop("copies")
    # The extra copies of a (source, size) go to its salts in proportion, then to the first draws of a salt.
    share_upto = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    dealt = cells.join(rated, ["key", "size"]).withColumn("seen", F.sum("n").over(share_upto))
    dealt = dealt.withColumn("due", F.expr("extra * seen div all"))
    dealt = dealt.withColumn("due", F.col("due") - F.expr("extra * (seen - n) div all"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("draw", "row_key"))
    ranked = rows.select(*keep, "doc_id", "row_key", "key", "size", "salt", rank.alias("rank"))
    found = ranked.join(dealt.select("key", "size", "salt", "source_size", "target", "base", "due"), ["key", "size", "salt"])
    copies = F.col("base") + F.when(F.col("rank") <= F.col("due"), 1).otherwise(0)
    return found.select(*keep, "doc_id", "row_key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes them: no, one or two rows each. Every row has a number of its own
    here, so repeated rows get exactly the copies that the mix gives each of them."""
    row, many, copy = fresh(docs, "mix_row", "mix_copies", "mix_copy")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plain = rows.select("doc_id", "source", "text", F.col(row).alias("mix_row"))
    taken = mix(plain, keep=("mix_row",)).where("copies > 0").select(F.col("mix_row").alias(row), F.col("copies").cast("int").alias(many))
    return rows.join(taken, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(many))).alias(copy)).drop(copy)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
