"""Scores of answers against gold: agreement, code F1, similarity, rewards.

Equality is null-safe throughout: two missing values agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import messages, reading, textjson

#: Fixed values, down to HARD_FRAGMENTS: exposure pairs whose answers should agree, and their weights.
PAIRS = [("full", "partial", 0.40), ("partial", "minimal", 0.30), ("minimal", "no_skill", 0.20), ("full", "no_skill", 0.10)]
WEIGHTS = {
    "decision_reward": 0.30, "need_human_reward": 0.15, "risk_level_reward": 0.10, "reason_code_reward": 0.15,
    "schema_reward": 0.05, "exposure_consistency_reward": 0.15, "hard_case_bonus": 0.10, "false_manual_review_penalty": -0.10,
}
HARD_CODES = [
    "manual_review_required", "evidence_conflict", "order_info_conflict", "high_value_order", "frequent_refund_user",
    "quality_issue_no_evidence", "fresh_goods_no_reason_denied", "customized_goods_no_reason_denied", "virtual_goods_denied",
]
HARD_FRAGMENTS = "hard|risk|conflict|manual|special|boundary|logistics"
CORE = "struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>"


def code_f1(a: Column, b: Column) -> Column:
    """F1 of two code sets; 1 if both are empty, 0 if one is."""
    empty = F.array().cast("array<string>")
    x, y = F.array_distinct(F.coalesce(a, empty)), F.array_distinct(F.coalesce(b, empty))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def similarity(a: Column, b: Column) -> Column:
    same = lambda f: a[f].eqNullSafe(b[f]).cast("double")
    return 0.45 * same("decision") + 0.20 * same("need_human") + 0.15 * same("risk_level") + 0.20 * code_f1(a["reason_codes"], b["reason_codes"])


def read_answers(df: DataFrame, mode: str = "offline") -> DataFrame:
    """df(prediction, ...) with json_valid, errors, schema_valid and got; online reading tries braces first.

    Plain answers are read by batch; what is left null there (odd texts) goes through the columns, which are null and
    cost little for all others."""
    plain = F.arrow_udf(reading.offline_batch if mode == "offline" else reading.online_batch, reading.RESULT)
    out = df.withColumn("_plain", plain(F.col("prediction")))
    out = read_columns(out.withColumn("_odd", F.when(F.col("_plain").isNull(), F.col("prediction"))), F.col("_odd"), mode)
    known = F.col("_plain").isNotNull()
    out = out.withColumns({name: F.when(known, F.col(f"_plain.{name}")).otherwise(F.col(name)) for name in ("errors", "json_valid", "got")})
    return out.withColumn("schema_valid", F.size("errors") == 0).drop("_plain", "_odd")


def read_columns(df: DataFrame, text: Column, mode: str = "offline") -> DataFrame:
    """df with json_valid, errors and got of any text, by columns alone."""
    json = textjson.lenient(text) if mode == "offline" else textjson.braces_first(text)
    # One step a column: what is read more than once must not be computed more than once.
    out = df.withColumn("_json", json).withColumn("_fields", textjson.fields(F.col("_json"))).withColumn("_typed", textjson.values(F.col("_fields")))
    out = out.withColumn("errors", textjson.contract_errors(F.col("_json"), F.col("_fields"), F.col("_typed"))).withColumn("json_valid", F.col("_json").isNotNull())
    got = F.struct(*(F.col(f"_typed.{name}") for name in ("decision", "risk_level", "need_human", "reason_codes")))
    return out.withColumn("got", got).drop("_json", "_fields", "_typed")


def score_answers(df: DataFrame) -> DataFrame:
    """df from read_answers with gold (struct of CORE), with one score column a metric."""
    ok = F.col("schema_valid")
    hit = lambda f: (ok & F.col(f"got.{f}").eqNullSafe(F.col(f"gold.{f}"))).cast("double")
    found = F.when(ok, F.col("got.reason_codes"))
    return df.withColumns({
        "s_json": F.col("json_valid").cast("double"), "s_schema": ok.cast("double"), "s_decision": hit("decision"),
        "s_risk": hit("risk_level"), "s_human": hit("need_human"), "s_f1": code_f1(F.col("gold.reason_codes"), found),
    })


def last_known(lookup: DataFrame) -> DataFrame:
    """(sample_id, known): gold and tags of the last row (by position) of each sample_id."""
    return lookup.groupBy("sample_id").agg(F.max_by(F.struct("gold", "hard_tags"), "position").alias("known"))


def with_gold(completions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Completions (row_index, prompt, and, where they are known, sample_id, prompt_exposure, gold, hard_tags) with
    all of these filled in.

    What a completion lacks comes from its prompt (sample_id, else the active order's id, and exposure) and
    then from the lookup (sample_id, position, gold, hard_tags), whose last row of a sample_id counts.
    Without any id a row is a sample of its own; without gold it stays null, tags are none, exposure unknown.
    """
    return with_known(completions, last_known(lookup))


def with_known(completions: DataFrame, known: DataFrame) -> DataFrame:
    """As with_gold, from what last_known() gave: completions may be a stream then, as known is a static table."""
    named = messages.prompt_metadata(F.col("prompt"))
    sample = F.coalesce(F.col("sample_id"), named["sample_id"], F.concat(F.lit("row_"), F.col("row_index").cast("string")))
    rows = completions.withColumns({"sample_id": sample, "prompt_exposure": F.coalesce(F.col("prompt_exposure"), named["prompt_exposure"], F.lit("unknown"))})
    both = rows.join(known, "sample_id", "left")
    tags = F.coalesce(F.col("hard_tags"), F.col("known.hard_tags"), F.array().cast("array<string>"))
    return both.withColumns({"gold": F.coalesce(F.col("gold"), F.col("known.gold")), "hard_tags": tags}).drop("known")


def online_rewards(rows: DataFrame) -> DataFrame:
    """Rewards of one batch of completions with gold, as a trainer asks for them: consistency is between the answers
    of this batch, the last one (by row_index) of a sample and exposure."""
    read = read_answers(rows.withColumn("position", F.col("row_index")), "online")
    return rewards(score_answers(read), "online")


METRICS = {"json_valid_rate": "s_json", "schema_valid_rate": "s_schema", "decision_accuracy": "s_decision", "risk_level_accuracy": "s_risk", "need_human_accuracy": "s_human", "reason_code_f1": "s_f1"}


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Means of the scores by key; overall_score leaves out JSON validity. No rows give zeros."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in METRICS.items()]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *means)
    parts = [F.col(name) for name in list(METRICS)[1:]]
    return out.withColumn("overall_score", sum(parts[1:], parts[0]) / 5)


def compatible(got: Column, gold: Column, schema_valid: Column) -> Column:
    """Valid and right in decision and need for a human."""
    return schema_valid & got["decision"].eqNullSafe(gold["decision"]) & got["need_human"].eqNullSafe(gold["need_human"])


def hard_case(gold: Column, tags: Column, mode: str = "offline") -> Column:
    """Human review, a hard reason code, or a telling tag; online any tag counts."""
    tagged = F.exists(tags, lambda t: F.lower(t).rlike(HARD_FRAGMENTS)) if mode == "offline" else F.size(tags) > 0
    codes = F.arrays_overlap(F.coalesce(gold["reason_codes"], F.array().cast("array<string>")), F.array(*map(F.lit, HARD_CODES)))
    return F.coalesce(gold["need_human"], F.lit(False)) | codes | F.coalesce(tagged, F.lit(False))


PAIRED = [p[0] for p in PAIRS[:3]] + ["no_skill"]


def _last_answer(exposure: str) -> Column:
    """Aggregate: the last answer (by position) of an exposure."""
    here = F.col("prompt_exposure") == exposure
    return F.max_by(F.when(here, F.struct("position", "got", "gold", "schema_valid")), F.when(here, F.col("position")))


TERMS = ["available_pairs", "exposure_consistency_reward", "wrong_high_similarity_pairs"]


def _with_terms(df: DataFrame, mode: str, here: Column) -> DataFrame:
    """df with TERMS, the consistency of the four last answers of a sample in columns named _full, _partial and so on.
    Pairs are compared where here holds, each once; elsewhere none counts as there."""
    compared = {}
    for k, (left, right, _) in enumerate(PAIRS):
        a, b = F.col(f"_{left}"), F.col(f"_{right}")
        a_ok = compatible(a["got"], a["gold"], a["schema_valid"])
        b_ok = compatible(b["got"], a["gold"] if mode == "offline" else b["gold"], b["schema_valid"])
        pair = F.struct(a_ok.alias("a_ok"), b_ok.alias("b_ok"), similarity(a["got"], b["got"]).alias("near"))
        compared[f"_pair{k}"] = F.when(here & a.isNotNull() & b.isNotNull(), pair)
    total, weight, wrong, pairs = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)
    for k, (_, _, w) in enumerate(PAIRS):
        pair = F.col(f"_pair{k}")
        a_ok, b_ok, near, there = pair["a_ok"], pair["b_ok"], pair["near"], pair.isNotNull()
        reward = F.when(a_ok & b_ok, near).when(a_ok | b_ok, 0.25 * near).when(near > 0.90, -0.10).otherwise(0.0)
        total += F.when(there, w * reward).otherwise(0.0)
        weight += F.when(there, w).otherwise(0.0)
        wrong += F.when(there & ~a_ok & ~b_ok & (near > 0.90), 1).otherwise(0)
        pairs += there.cast("int")
    terms = dict(zip(TERMS, (pairs, F.when(weight > 0, total / weight).otherwise(0.0), wrong)))
    return df.withColumns(compared).withColumns(terms).drop(*compared)


def consistency(df: DataFrame, mode: str = "offline") -> DataFrame:
    """(sample_id, available_pairs, exposure_consistency_reward, wrong_high_similarity_pairs).

    The last answer (by position) of a sample and exposure counts. Offline both sides of a pair
    are held to the left side's gold, online each to its own.
    """
    wide = df.where(F.col("prompt_exposure").isin(PAIRED)).groupBy("sample_id").agg(*(_last_answer(e).alias(f"_{e}") for e in PAIRED))
    return _with_terms(wide, mode, F.lit(True)).select("sample_id", *TERMS)


def rewards(df: DataFrame, mode: str = "offline") -> DataFrame:
    """df from score_answers (with sample_id, prompt_exposure, position, hard_tags) with reward
    components and total_reward. Every answer is read once: windows over its sample bring in the
    consistency term, compared in the sample's first row alone, in one shuffle on sample_id."""
    sample = Window.partitionBy("sample_id")
    first = F.row_number().over(sample.orderBy("position", "prompt_exposure")) == 1
    wide = df.withColumn("_one", first).withColumns({f"_{e}": _last_answer(e).over(sample) for e in PAIRED})
    termed = _with_terms(wide, mode, F.col("_one")).drop(*(f"_{e}" for e in PAIRED))
    joined = termed.withColumns({name: F.max(F.when(F.col("_one"), F.col(name))).over(sample) for name in TERMS}).drop("_one")
    false_review = F.col("schema_valid") & (F.col("got.decision") == "manual_review") & ~F.col("gold.decision").eqNullSafe(F.lit("manual_review"))
    bonus = hard_case(F.col("gold"), F.col("hard_tags"), mode) & compatible(F.col("got"), F.col("gold"), F.col("schema_valid"))
    out = joined.withColumns({
        "decision_reward": F.col("s_decision"), "need_human_reward": F.col("s_human"), "risk_level_reward": F.col("s_risk"),
        "reason_code_reward": F.col("s_f1"), "schema_reward": F.col("s_schema"),
        "exposure_consistency_reward": F.coalesce("exposure_consistency_reward", F.lit(0.0)),
        "hard_case_bonus": bonus.cast("double"), "false_manual_review_penalty": F.coalesce(false_review, F.lit(False)).cast("double"),
    })
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total += weight * F.col(name)
    return out.withColumn("total_reward", total)


def reward_summary(done: DataFrame, model: str = "model") -> DataFrame:
    """One row a model and one a model and exposure (null exposure: all) from rewards(): number of records and the
    means of all components over records; for a whole model also the number of groups (samples), the mean of
    consistency over groups and the groups with a pair of wrong but alike answers.

    Both grains come from one pass: a sample's first row stands for the group. A sample_id belongs to one model.
    """
    first = F.row_number().over(Window.partitionBy("sample_id").orderBy("position", "prompt_exposure")) == 1
    rows = done.withColumn("_first", first)
    keys = [F.col(model), F.col("prompt_exposure")]
    whole = F.grouping("prompt_exposure") == 1
    means = [F.avg(c).alias(c) for c in [*WEIGHTS, "total_reward"]]
    group = {
        "groups": F.count_if("_first"), "group_consistency": F.avg(F.when(F.col("_first"), F.col("exposure_consistency_reward"))),
        "wrong_high_similarity_groups": F.count_if(F.col("_first") & (F.col("wrong_high_similarity_pairs") > 0)),
    }
    out = rows.groupingSets([[keys[0]], keys], *keys).agg(F.count("*").alias("records"), *means, *(c.alias(n) for n, c in group.items()), whole.alias("_whole"))
    return out.select(model, "prompt_exposure", "records", *WEIGHTS, "total_reward", *(F.when(F.col("_whole"), F.col(n)).alias(n) for n in group))


def order_gate(summary: DataFrame, expected: list[str], model: str = "model") -> DataFrame:
    """One row (ranking, passed): models by mean total reward, best first (ties by name), and whether the expected ones
    are all there and stand in that order; others may stand between them. Models are few."""
    means = summary.where("prompt_exposure IS NULL").select(model, "total_reward")
    best = F.array_sort(F.collect_list(F.struct((-F.col("total_reward")).alias("t"), F.col(model).alias("m"))))
    row = means.agg(F.transform(best, lambda x: x["m"]).alias("ranking"))
    wanted = F.array(*map(F.lit, expected))
    return row.withColumn("passed", F.filter("ranking", lambda m: F.array_contains(wanted, m)) == wanted)
