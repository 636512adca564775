"""The datasets of a causal comparison: one exposure mix, shuffled and in stages, over drawn samples.

Sources are drawn by repeating all of them as often as needed, shuffling the repeats and cutting: where more
records than sources are asked for, a source comes up to ceil(k / n) times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import builders, layout

STAGE_NAMES = ["stage1", "stage2", "stage3"]


def shuffled_repeats(df: DataFrame, seed: str, key: str, n: int, k: int) -> DataFrame:
    """k rows of df's n, with copy and position from 1: every row ceil(k / n) times, in hash order, cut after k."""
    if not n:
        raise ValueError("there is nothing to draw from")
    times = max(1, -(-k // n))
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("_id", F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string")))
    placed = layout.hash_ranked(rows, seed, "_id")
    return placed.where(F.col("position") <= k).drop("_id")


def causal_layout(samples: DataFrame, n: int, per_method: int, seed: int) -> DataFrame:
    """(variant, position, stage, sample_id, copy, prompt_exposure) of all five variants over samples, of which there are n.

    balanced_random has equal exposures in hash order; each stage its own share of exposures and its own draw;
    balanced_staged_all is the three stages one after the other, so both methods have the same exposures.
    """
    if per_method % 12:
        raise ValueError("the number of records must be divisible by 12")
    spark, ids = samples.sparkSession, samples.select("sample_id")
    slots = spark.range(1, per_method + 1).select(F.col("id").alias("slot"), layout.quota_value(F.col("id"), [(e, per_method // 4) for e in builders.EXPOSURES]).alias("prompt_exposure"))
    mixed = layout.hash_ranked(slots, f"{seed}|mix", "slot").select("position", "prompt_exposure")
    names = ["variant", "position", "stage", "sample_id", "copy", "prompt_exposure"]
    random = layout.zipped(shuffled_repeats(ids, f"{seed}|random", "sample_id", n, per_method), mixed)
    out = random.withColumns({"variant": F.lit("balanced_random"), "stage": F.lit(None).cast("string")}).select(names)
    vector = builders.stage_vector(spark, per_method, seed).select("position", F.col("_e").alias("prompt_exposure"))
    size = per_method // 3
    for k, stage in enumerate(STAGE_NAMES):
        own = vector.where((F.col("position") > k * size) & (F.col("position") <= (k + 1) * size)).withColumn("position", F.col("position") - k * size)
        part = layout.zipped(shuffled_repeats(ids, f"{seed}|{stage}", "sample_id", n, size), own).withColumn("stage", F.lit(stage))
        out = out.union(part.withColumn("variant", F.lit(f"balanced_staged_{stage}")).select(names))
        out = out.union(part.withColumns({"variant": F.lit("balanced_staged_all"), "position": F.col("position") + k * size}).select(names))
    return out


def causal_records(samples: DataFrame, n: int, per_method: int, seed: int) -> DataFrame:
    """The layout's records with messages, ids and tags; samples is what builders.records takes."""
    placed = causal_layout(samples, n, per_method, seed).withColumnRenamed("prompt_exposure", "_e")
    rows = builders.records(placed.join(samples.drop("position"), "sample_id"), F.col("_e"), True).drop("_e")
    tags = F.col("hard_tags") if "hard_tags" in samples.columns else F.array().cast("array<string>")
    return rows.withColumns({
        "record_id": F.concat("variant", F.lit("_"), F.format_string("%06d", F.col("position") - 1)), "hard_tags": F.concat(tags, F.array(F.lit("causal_ablation"), F.col("variant"))),
        "active_order_id": F.concat(F.lit("C-CAUSAL-"), F.col("sample_id").cast("string")), "backend_contract": F.lit("current_order_guaranteed"),
    })


def variant_summary(layout_: DataFrame, exposures: Sequence[str] = tuple(builders.EXPOSURES)) -> DataFrame:
    """(variant, records, sources, most_copies, one count an exposure)."""
    counts = [F.count_if(F.col("prompt_exposure") == e).alias(f"n_{e}") for e in exposures]
    per = layout_.groupBy("variant", "sample_id").agg(F.count("*").alias("copies"), *counts)
    return per.groupBy("variant").agg(F.sum("copies").alias("records"), F.count("*").alias("sources"), F.max("copies").alias("most_copies"), *(F.sum(f"n_{e}").alias(f"n_{e}") for e in exposures))
