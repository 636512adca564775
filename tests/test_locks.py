"""Locked splits are verified before reading, sealed ones refused; datasets of the causal comparison."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewright.operators import builders, causal, locks


def cases(spark):
    rows = [(skill, split, k + 1, f"{skill}{split}{k}", f"f{k % 3}", f"text {k}") for skill in "ab" for split in ("train", "validation", "confirmation") for k in range(6)]
    return spark.createDataFrame(rows, "skill_id string, split string, slot long, semantic_case_hash string, facts_hash string, user_input string").repartition(3)


def test_reading_a_split(spark):
    rows = cases(spark)
    manifest = locks.split_manifest(rows, "user_input").cache()
    assert manifest.count() == 6 and manifest.where("locked").select("split").distinct().collect()[0][0] == "confirmation"
    assert locks.read_split(rows, manifest, "train", "user_input").count() == 12
    assert locks.audit(rows, manifest, "user_input").isEmpty()
    with pytest.raises(PermissionError):
        locks.read_split(rows, manifest, "confirmation", "user_input")
    with pytest.raises(PermissionError):
        locks.read_split(rows, manifest.withColumn("locked", F.lit(False)), "confirmation", "user_input")
    with pytest.raises(PermissionError):
        locks.read_split(rows, manifest.withColumn("locked", F.col("skill_id") == "a"), "train", "user_input")
    with pytest.raises(LookupError):
        locks.read_split(rows, manifest, "test", "user_input")
    changed = rows.withColumn("user_input", F.when(F.col("slot") == 2, "other").otherwise(F.col("user_input")))
    with pytest.raises(ValueError, match="text_sha256"):
        locks.read_split(changed, manifest, "train", "user_input")


def test_audit_tells_what_changed(spark):
    rows = cases(spark)
    manifest = locks.split_manifest(rows, "user_input").cache()
    on = (F.col("skill_id") == "a") & (F.col("split") == "confirmation")
    swapped = rows.withColumn("slot", F.when(on & F.col("slot").isin(1, 4), 5 - F.col("slot")).otherwise(F.col("slot")))
    assert sorted(r["problem"] for r in locks.audit(swapped, manifest, "user_input").collect()) == ["case_sha256", "text_sha256"]
    facts = rows.withColumn("facts_hash", F.when(on & (F.col("slot") == 1), "f1").otherwise(F.col("facts_hash")))
    assert [tuple(r) for r in locks.audit(facts, manifest, "user_input").collect()] == [("a", "confirmation", "facts_sha256")]
    fewer = rows.where(~on).union(rows.where(on).withColumn("split", F.lit("more")))
    assert {tuple(r) for r in locks.audit(fewer, manifest, "user_input").collect()} == {("a", "confirmation", "missing"), ("a", "more", "unknown")}
    unlocked = manifest.withColumn("locked", F.lit(False))
    assert {r["problem"] for r in locks.audit(rows, unlocked, "user_input").collect()} == {"locked"}


@pytest.mark.parametrize("n, k", [(5, 12), (40, 12), (12, 12), (1, 7)])
def test_repeats_are_even(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "sample_id")
    got = causal.shuffled_repeats(df, "s", "sample_id", n, k).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, k + 1))
    assert max(Counter(r["sample_id"] for r in got).values()) <= -(-k // n) and len({(r["sample_id"], r["copy"]) for r in got}) == k
    again = causal.shuffled_repeats(df.repartition(3), "s", "sample_id", n, k).orderBy("position").collect()
    assert [r["sample_id"] for r in again] == [r["sample_id"] for r in got]


def test_five_variants(spark):
    samples = builders.generate_samples(spark, 20, 3)
    found = causal.causal_records(samples, 20, 24, 5).cache()
    sizes = {r["variant"]: r["count"] for r in found.groupBy("variant").count().collect()}
    assert sizes == {"balanced_random": 24, "balanced_staged_all": 24, **{f"balanced_staged_{s}": 8 for s in causal.STAGE_NAMES}}
    rows = {v: found.where(F.col("variant") == v).orderBy("position").collect() for v in sizes}
    staged = [(r["sample_id"], r["prompt_exposure"]) for s in causal.STAGE_NAMES for r in rows[f"balanced_staged_{s}"]]
    assert staged == [(r["sample_id"], r["prompt_exposure"]) for r in rows["balanced_staged_all"]]
    for v in ("balanced_random", "balanced_staged_all"):
        assert Counter(r["prompt_exposure"] for r in rows[v]) == dict.fromkeys(builders.EXPOSURES, 6)
        assert [r["record_id"] for r in rows[v]][:2] == [f"{v}_000000", f"{v}_000001"]
    for r in rows["balanced_random"]:
        assert r["messages"][-1]["role"] == "assistant" and r["active_order_id"] == f"C-CAUSAL-{r['sample_id']}" and r["hard_tags"] == ["causal_ablation", "balanced_random"]
        assert (r["messages"][0]["role"] == "system") == (r["prompt_exposure"] != "no_skill")
    with pytest.raises(ValueError):
        causal.causal_layout(samples, 20, 20, 5)
    with pytest.raises(ValueError):
        causal.shuffled_repeats(samples.where("false"), "s", "sample_id", 0, 3)
