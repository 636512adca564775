"""Whole analyses composed of the operators: a prediction panel's, and vector records'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import textjson
from casewright.operators import layout
from casewright.operators import panel as P
from casewright.operators import vectors as V
from casewright.operators.bootstrap import case_bootstrap

ROBUST = ["no_system", "irrelevant", "paraphrase_a", "paraphrase_b"]
CONSTRUCTS = {"no_system": [["no_system"]], "irrelevant": [["irrelevant"]], "paraphrase": [["paraphrase_a", "paraphrase_b"]]}


def from_predictions(rows: DataFrame) -> DataFrame:
    """A panel from predictions (skill, case, family, condition, endpoint, completion, gold): strict
    reading, exact agreement in decision, risk level and need for a human."""
    got = textjson.fields(textjson.strict_object(F.col("completion")))
    out = rows.withColumn("_got", got).withColumn("parsed", F.col("_got").isNotNull())
    same = [textjson.as_text(F.col("_got")["decision"]).eqNullSafe(F.col("gold.decision")), textjson.as_text(F.col("_got")["risk_level"]).eqNullSafe(F.col("gold.risk_level")), textjson.as_flag(F.col("_got")["need_human"]).eqNullSafe(F.col("gold.need_human"))]
    ok = F.col("parsed") & same[0] & same[1] & same[2]
    return out.withColumn("schema_valid", F.size(textjson.contract_errors(textjson.strict_object(F.col("completion")))) == 0).withColumn("ok", ok).withColumn("value", ok.cast("double")).drop("_got")


def gate_errors(panel: DataFrame, stored: str | None = None) -> DataFrame:
    """(check, detail): incomplete or doubled cases, several families, and stored flags that differ."""
    bad = P.gates(panel, 8).select(F.lit("panel_cells").alias("check"), F.concat_ws("|", "skill", "case").alias("detail"))
    if stored:
        bad = bad.union(panel.where(~F.col(stored).eqNullSafe(F.col("ok"))).select(F.lit("stored_flag"), F.concat_ws("|", "skill", "case", "condition", "endpoint")))
    return bad


def analyse(panel: DataFrame, draws: int = 10_000, per_endpoint: float = 0.95, per_condition: float = 0.90, seed: str = "20260724") -> dict[str, DataFrame]:
    """All tables of the analysis, each a small DataFrame; the panel should be stored or cached.

    panel is (skill, case, family, condition, endpoint, ok, value) with a flag schema_valid.
    """
    cases = P.by_case(panel, P.BALANCED)
    primary, canonical = P.effects(cases), P.effects(P.by_case(panel, [["full"]]))
    signed = F.sum(F.when(F.col("endpoint") == P.STAGED, F.col("score")).otherwise(-F.col("score"))).alias("delta")
    deltas = cases.groupBy("skill", "case").agg(signed).join(panel.groupBy("skill", "case").agg(F.max_by("family", "condition").alias("family")), ["skill", "case"])
    by_case = P.interval(case_bootstrap(deltas.select("skill", "case", "delta"), draws, seed, "case"), draws)
    by_family = P.interval(P.cluster_bootstrap(deltas.groupBy("skill", "family").agg(F.avg("delta").alias("delta")), draws, seed, "family"), draws)
    constructs = None
    for name, parts in CONSTRUCTS.items():
        part = P.effects(P.by_case(panel, parts)).where("skill = 'macro'").select(F.lit(name).alias("construct"), "random", "staged", "delta")
        constructs = part if constructs is None else constructs.union(part)
    flag = lambda e, n: F.max(F.when(F.col("endpoint") == e, F.col("ok"))).alias(n)
    pairs = panel.groupBy("skill", "condition", "case").agg(flag(P.RANDOM, "random_ok"), flag(P.STAGED, "staged_ok"))
    guards = P.validity(panel, "schema_valid", per_endpoint, per_condition)
    row = P.decision(panel, P.CONDITIONS, list(CONSTRUCTS.values()), draws, seed, per_endpoint, per_condition, "schema_valid")
    return {
        "primary": primary, "canonical": canonical, "constructs": constructs, "conditions": P.grouped_effects(panel, "condition"),
        "case_bootstrap": by_case, "family_bootstrap": by_family, "guards": guards,
        "robust_tests": P.holm(P.mcnemar(pairs.where(F.col("condition").isin(ROBUST)), "skill", "condition"), order=["skill", "condition"]),
        "canonical_tests": P.mcnemar(pairs.where("condition = 'full'"), "skill"),
        "decision": row.select("state", "macro", "low", "high", "case_lower", "family_lower", "guards_pass", "data_valid"),
    }


def vector_summary(records: DataFrame) -> dict[str, DataFrame]:
    """Summaries of vector records (checkpoint_id, case_id, context_load, rule_family, cosine as nested map).

    The cosines to the full exposure by checkpoint, context and exposure; the long minus short
    difference of the same case; and the same by rule family, without the full exposure itself.
    """
    flat = V.flatten_metrics(records, "cosine", "full").withColumnRenamed("value", "c")
    wide = flat.groupBy("checkpoint_id", "case_id", "exposure").agg(*(F.max(F.when(F.col("context_load") == k, F.col("c"))).alias(k) for k in ("short", "long")))
    both = F.when(F.col("short").isNull() | F.col("long").isNull(), F.raise_error(F.lit("a case lacks a context"))).otherwise(F.col("long") - F.col("short"))
    return {
        "groups": V.finite_stats(flat, "c", "checkpoint_id", "context_load", "exposure"),
        "context_delta": V.finite_stats(wide.withColumn("d", both.cast("double")), "d", "checkpoint_id", "exposure"),
        "families": V.finite_stats(flat.where("exposure <> 'full'"), "c", "checkpoint_id", "rule_family", "exposure"),
    }


def layout_errors(arms: DataFrame) -> DataFrame:
    """Skills whose staged and mixed orders are not two orders of the same records."""
    by = ["skill_id"]
    hashes = layout.ordered_hash(arms, by, "record_id", "staged_position", "staged").join(layout.ordered_hash(arms, by, "record_id", "mixed_position", "mixed"), "skill_id")
    counts = arms.groupBy("skill_id").agg(F.count_distinct("staged_position").alias("s"), F.count_distinct("mixed_position").alias("m"), F.count("*").alias("n"))
    return hashes.join(counts, "skill_id").where("staged = mixed OR s <> n OR m <> n").select("skill_id")
