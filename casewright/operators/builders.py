"""Dataset builders: cases, training arms, evaluation requests and their validation.

Builders compose the rule engines, messages and layouts; every result is a DataFrame with an
explicit position where order matters. Randomness is a hash of seed and row number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import messages as M
from casewright.operators import layout, requests, rules

EXPOSURES = ["full", "partial", "minimal", "no_skill"]
#: Parts of the full system text.
PARTS = {
    "task": "You decide refund requests.",
    "schema": "Answer as JSON with intent, decision, risk_level, need_human, reason_codes and explanation.",
    "rules": "Check missing facts and conflicts first, then risks, then the refund rules in order; the first one that holds decides.",
    "examples": "Example: unused clothing on the third day, no reason given: allow_return_refund, low, no person needed.",
    "edges": "High amounts and frequent refunds go to a person even where a rule would allow them.",
}
SHORT_RULES = "Follow the refund rules."
#: The parts that are left of the full system text under each ablation; none at all for the last one.
ABLATIONS = {
    "rule_deleted_full": ["task", "schema", "examples", "edges"], "schema_deleted_full": ["task", "rules", "examples", "edges"], "examples_deleted_full": ["task", "schema", "rules", "edges"],
    "schema_only_full": ["task", "schema"], "rules_only_full": ["task", "rules"], "no_skill_current_order_only": [],
}
#: System texts by exposure; no_skill has none.
SYSTEM = {
    "full": "\n\n".join(PARTS.values()),
    "partial": "You decide refund requests. Follow the refund rules and answer as JSON.",
    "minimal": "Answer as JSON.",
    "no_skill": "",
}
PRODUCTS = ["clothing", "electronics", "home", "fresh", "customized", "virtual"]
CLAIMS = ["no_reason", "size_not_fit", "quality_issue", "exchange", "logistics_issue", "strong_complaint", "claims_unused_but_used"]
AMOUNTS = [59, 129, 199, 399, 899, 1299, 2499]


def _picked(values: Sequence, draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw * len(values)) + 1).cast("int"))


def generate_samples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n samples of the first refund engine: facts drawn by hash, decided, with request text.

    The first seventeen are the difficult cases: goods that are not taken back, a late claim, faults with and without
    evidence, high amounts, frequent refunds, a used item claimed unused, and so on.
    """
    u = lambda name: layout.unit(str(seed), name, F.col("position"))
    rows = spark.range(1, n + 1).withColumnRenamed("id", "position").withColumn("product_type", _picked(PRODUCTS, u("product"))).withColumn("user_claim", _picked(CLAIMS[:6], u("claim")))
    rows = rows.withColumns({
        "days_since_delivery": F.floor(u("days") * 19).cast("int"), "is_used": u("used") < 0.25, "is_resellable": u("sell") < 0.8, "has_quality_issue": F.col("user_claim") == "quality_issue", "has_evidence": u("evidence") < 0.6,
        "order_amount": _picked(AMOUNTS, u("amount")).cast("int"), "refund_count_30d": F.floor(u("count") * 4).cast("int"), "order_status": F.lit("delivered"),
        "is_customized": F.col("product_type") == "customized", "is_virtual": F.col("product_type") == "virtual", "is_fresh": F.col("product_type") == "fresh",
        "seller_fault": (F.col("user_claim") == "logistics_issue") & (u("fault") < 0.5), "logistics_issue": F.col("user_claim") == "logistics_issue", "evidence_conflict": u("conflict") < 0.03, "order_info_conflict": F.lit(False),
    })
    decided = rules.decide_refund(requests.difficult(rows))
    return decided.select(F.format_string("refund_%06d", "position").alias("sample_id"), "*", requests.request(requests.drawn(str(seed), F.col("position"))).alias("user_input"), requests.evidence().alias("evidence_description"))


FACTS = ["product_type", "days_since_delivery", "is_used", "is_resellable", "has_quality_issue", "has_evidence", "order_amount", "refund_count_30d", "user_claim", "order_status", "is_customized", "is_virtual", "is_fresh", "seller_fault", "logistics_issue", "evidence_conflict", "order_info_conflict"]
ANSWER = ["decision", "intent", "need_human", "reason_codes", "risk_level"]


def facts_json(columns: Sequence[str] = FACTS) -> Column:
    """Canonical JSON of facts: sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def records(samples: DataFrame, exposure: Column, answer: bool) -> DataFrame:
    """samples with prompt_exposure and messages, with or without the answer."""
    systems = F.create_map(*[F.lit(x) for pair in SYSTEM.items() for x in pair])
    out = samples.withColumn("prompt_exposure", exposure)
    user = M.user_prompt(F.col("user_input"), facts_json(), F.col("evidence_description"))
    built = M.build(F.try_element_at(systems, F.col("prompt_exposure")), user, F.to_json(F.struct(*ANSWER)) if answer else None)
    return out.withColumn("messages", built)


def export_sets(samples: DataFrame, seed: int) -> dict[str, DataFrame]:
    """The five datasets of an export: full, no-skill and annealed training records, evaluation records
    of every exposure, and the distribution of decisions."""
    n = samples.count()
    phases = [(0.3, [("full", 0.8), ("partial", 0.2)]), (0.7, [("full", 0.2), ("partial", 0.5), ("minimal", 0.3)]), (1.1, [("partial", 0.4), ("minimal", 0.6)])]
    fraction = (F.col("position") - 1) / F.lit(float(max(1, n)))
    annealed = layout.phase_exposure(fraction, layout.unit(str(seed), "phase", F.col("position")), phases)
    dim = F.broadcast(samples.sparkSession.createDataFrame([(e,) for e in EXPOSURES], "_e string"))
    return {
        "full_skill_sft": records(samples, F.lit("full"), True),
        "no_skill_sft": records(samples, F.lit("no_skill"), True),
        "annealed_sft": records(samples, annealed, True),
        "eval_prompts": records(samples.crossJoin(dim), F.col("_e"), False).drop("_e"),
        "distribution": samples.groupBy("decision").agg(F.count("*").alias("n")),
    }


def trainer_export(rows: DataFrame) -> DataFrame:
    """What a trainer reads: the messages alone, in order."""
    return rows.select("position", "messages")


def exposure_mix(samples: DataFrame, method: str, n: int, seed: int) -> DataFrame:
    """full_only, random_mix (equal shares in hash order) or naive_staged (stages in order)."""
    if method == "full_only":
        return records(samples, F.lit("full"), True)
    if method == "random_mix":
        if n % 4:
            raise ValueError("the number of records must be divisible by 4")
        slots = samples.sparkSession.range(1, n + 1).select(F.col("id").alias("slot"), layout.quota_value(F.col("id"), [(e, n // 4) for e in EXPOSURES]).alias("_e"))
        vector = layout.hash_ranked(slots, str(seed), "slot").select(F.col("position"), "_e")
    elif method == "naive_staged":
        if n % 12:
            raise ValueError("the number of records must be divisible by 12")
        vector = stage_vector(samples.sparkSession, n, seed)
    else:
        raise ValueError(f"unknown method {method}")
    return records(layout.zipped(samples, vector), F.col("_e"), True).drop("_e")


#: Shares of exposures by stage; over all stages every exposure has a quarter.
STAGES = [[("full", 3), ("partial", 1)], [("partial", 1), ("minimal", 1)], [("minimal", 1), ("no_skill", 3)]]


def stage_vector(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(position, _e): three stages of n / 3, exposures in each by share and hash order."""
    size = n // 3
    quotas = [(value, size * w // sum(w for _, w in shares)) for shares in STAGES for value, w in shares]
    slots = spark.range(1, n + 1).select(F.col("id").alias("slot"), F.floor((F.col("id") - 1) / size).cast("int").alias("stage"), layout.quota_value(F.col("id"), quotas).alias("_e"))
    hashed = layout.hash_key(str(seed), F.col("stage"), F.col("slot"))
    inside = layout.bucket_ranked(slots, F.substring(hashed, 1, layout.DIGITS), [hashed, F.col("slot")], "_r", ["stage"])
    return inside.select((F.col("stage") * size + F.col("_r")).cast("bigint").alias("position"), "_e")


def causal_variants(samples: DataFrame, n: int, seed: int) -> dict[str, DataFrame]:
    """The same exposure counts in two orders over the same samples: uniform shuffled and staged."""
    if n % 12:
        raise ValueError("the number of records must be divisible by 12")
    staged = stage_vector(samples.sparkSession, n, seed)
    shuffled = layout.hash_ranked(staged.select(F.col("position").alias("slot"), "_e"), f"{seed}|mix", "slot").select("position", "_e")
    return {name: records(layout.zipped(samples, v), F.col("_e"), True).drop("_e") for name, v in (("uniform_staged", staged), ("uniform_shuffled", shuffled))}


#: Weights of exposures by replay stage.
REPLAY = [{"full": 6, "partial": 2, "minimal": 1, "no_skill": 1}, {"full": 2, "partial": 4, "minimal": 3, "no_skill": 1}, {"full": 1, "partial": 2, "minimal": 3, "no_skill": 4}]


def replay_layout(pool: DataFrame, size: int, seed: int, hard: float = 0.2) -> DataFrame:
    """The columns of pool (sample_id, hard, ...) with stage, copy, position and prompt_exposure: three stages of size rows.

    Every stage draws a fraction of hard rows (half to even) and the rest from the others, each repeated only where
    there are too few, in its own hash order, and has its own shares of exposures. A pool without rows of a kind
    that is asked for raises ValueError.
    """
    want = round(size * hard)
    counts = {r["hard"]: r["count"] for r in pool.groupBy("hard").count().collect()}
    if absent := [flag for flag, count in ((True, want), (False, size - want)) if count and not counts.get(flag)]:
        raise ValueError(f"no rows with hard in {absent} to draw from")
    out = None
    for k, shares in enumerate(REPLAY):
        stage = None
        for flag, count in ((True, want), (False, size - want)):
            if count:
                drawn = layout.sample_with_repeats(pool.where(F.col("hard") == flag), f"{seed}|{k}", "sample_id", counts[flag], count)
                stage = drawn if stage is None else stage.unionByName(drawn)
        stage = stage.withColumn("_id", F.concat_ws("|", "sample_id", "copy"))
        placed = layout.hash_ranked(stage, f"{seed}|place|{k}", "_id")
        exposure = layout.quota_value(F.col("position"), list(layout.largest_remainder(size, shares).items()))
        done = placed.withColumns({"prompt_exposure": exposure, "stage": F.lit(f"stage{k + 1}"), "position": F.col("position") + k * size}).drop("_id")
        out = done if out is None else out.unionByName(done)
    return out


def replay_stages(samples: DataFrame, size: int, seed: int, hard: float = 0.2) -> DataFrame:
    """Training records of a replay_layout; hard cases are those that a person or more evidence has to decide."""
    pool = samples.drop("position").withColumn("hard", F.expr("need_human OR decision = 'request_more_evidence'"))
    return records(replay_layout(pool, size, seed, hard), F.col("prompt_exposure"), True).drop("hard", "copy")


CATEGORIES = [("conflict", 0.40), ("high_value", 0.20), ("no_evidence", 0.15), ("special_goods", 0.15), ("logistics", 0.10)]


def targeted_samples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Samples of hard categories in weighted shares, decided, with ordered tags."""
    base = generate_samples(spark, n, seed).drop("intent", "decision", "risk_level", "need_human", "reason_codes")
    draw = layout.unit(str(seed), "category", F.col("position"))
    base = base.withColumn("category", layout.phase_exposure(F.lit(0.0), draw, [(1.0, CATEGORIES)]))
    on = lambda c: F.col("category") == c
    base = base.withColumns({
        "evidence_conflict": F.col("evidence_conflict") | on("conflict"),
        "order_amount": F.when(on("high_value"), 1299).otherwise(F.col("order_amount")),
        "has_quality_issue": F.col("has_quality_issue") | on("no_evidence"), "has_evidence": F.col("has_evidence") & ~on("no_evidence"),
        "is_fresh": F.col("is_fresh") | on("special_goods"), "logistics_issue": F.col("logistics_issue") | on("logistics"),
    })
    tags = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("target_"), F.col("category")), F.when(F.col("evidence_conflict"), "evidence_conflict"), F.when(F.col("order_amount") >= 1000, "high_value_order"), F.when(F.col("logistics_issue"), "logistics_issue"))))
    return rules.decide_refund(base).withColumn("hard_tags", tags)


def ablation_eval(samples: DataFrame) -> DataFrame:
    """Per sample 4 original exposures, 6 prompt ablations under full, and 10 fact mutations under 3 exposures."""
    spark = samples.sparkSession
    kinds = [("original", e) for e in EXPOSURES] + [(k, "full") for k in ABLATIONS]
    plain = samples.crossJoin(F.broadcast(spark.createDataFrame(kinds, "ablation_type string, _e string"))).withColumn("mutation_type", F.lit("none"))
    changes = [("used", {"is_used": True}), ("unused", {"is_used": False}), ("amount_high", {"order_amount": 2499}), ("amount_low", {"order_amount": 59}), ("conflict", {"evidence_conflict": True}), ("late", {"days_since_delivery": 18}), ("early", {"days_since_delivery": 1}), ("evidence", {"has_evidence": True}), ("no_evidence", {"has_evidence": False}), ("frequent", {"refund_count_30d": 3})]
    names = sorted({c for _, m in changes for c in m})
    kind = {c: dict(samples.dtypes)[c] for c in names}
    dim = spark.createDataFrame([(k, *(m.get(c) for c in names)) for k, m in changes], "mutation_type string, " + ", ".join(f"_{c} {kind[c]}" for c in names))
    mutated = samples.drop("intent", "decision", "risk_level", "need_human", "reason_codes").crossJoin(F.broadcast(dim)).withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*(f"_{c}" for c in names))
    mutated = rules.decide_refund(mutated).withColumn("ablation_type", F.lit("fact_mutation")).crossJoin(F.broadcast(spark.createDataFrame([(e,) for e in ("full", "minimal", "no_skill")], "_e string")))
    both = records(plain.unionByName(mutated), F.col("_e"), False).drop("_e")
    return both.withColumn("messages", ablated_messages(F.col("messages"), F.col("ablation_type")))


def ablated_messages(messages: Column, kind: Column) -> Column:
    """messages with what an ablation leaves of the full system text; unchanged for any other kind."""
    out = messages
    for name, parts in ABLATIONS.items():
        text = "\n\n".join([*(PARTS[p] for p in parts), *([SHORT_RULES] if name == "rules_only_full" else [])])
        out = F.when(kind == name, M.with_system(messages, F.lit(text))).otherwise(out)
    return out


# ---- pilot cases of three skills, one prototype a reason code ----

BASE = {
    "refund": dict(product_type="standard", days_since_delivery=3, is_used=False, is_resellable=True, has_quality_issue=False, has_evidence=False, order_amount_cny=199, refund_count_30d=0, user_claim="no_reason", order_status="delivered", seller_fault=False, logistics_issue=False, evidence_conflict=False, order_info_conflict=False),
    "warranty": dict(product_category="electronics", days_since_purchase=100, warranty_days=365, failure_type="manufacturing_defect", failure_description_present=True, has_purchase_proof=True, has_diagnostic_evidence=True, unauthorized_repair=False, unauthorized_repair_caused_current_failure=False, extended_coverage=False, prior_repair_count=0, same_failure_recurrence=False, serial_status="match", safety_recall=False, claim_amount_cny=800, evidence_conflict=False),
    "expense": dict(expense_category="meal", amount="120.00", currency="CNY", hotel_nights=0, days_since_expense=5, has_receipt=True, receipt_matches_amount=True, business_purpose_present=True, manager_approved=False, project_code_valid=True, is_duplicate_claim=False, is_personal_expense=False, is_weekend_or_holiday=False, international_trip=False, policy_exception_documented=False, evidence_conflict=False),
}
CASES = {
    "refund": {
        "missing_required_facts": dict(order_status="unknown", days_since_delivery=None), "evidence_conflict": dict(evidence_conflict=True), "order_info_conflict": dict(order_info_conflict=True),
        "high_value_order": dict(order_amount_cny=1000), "frequent_refund_user": dict(refund_count_30d=3), "logistics_issue_supported": dict(logistics_issue=True, seller_fault=True),
        "logistics_issue_insufficient_evidence": dict(logistics_issue=True), "quality_issue_no_evidence": dict(has_quality_issue=True), "quality_issue_return_refund": dict(has_quality_issue=True, has_evidence=True),
        "quality_issue_refund_only": dict(has_quality_issue=True, has_evidence=True, is_used=True), "special_goods_exclusion": dict(product_type="fresh"), "within_7_days_unused": {}, "used_or_not_resellable": dict(is_used=True), "over_7_days_no_quality_issue": dict(days_since_delivery=8),
    },
    "warranty": {
        "safety_recall": dict(safety_recall=True), "evidence_conflict": dict(evidence_conflict=True), "serial_mismatch": dict(serial_status="mismatch"), "serial_missing": dict(serial_status="missing"),
        "purchase_proof_missing": dict(has_purchase_proof=False), "failure_description_missing": dict(failure_description_present=False), "abnormal_claim_amount": dict(claim_amount_cny=3000),
        "unauthorized_repair_causal": dict(unauthorized_repair=True, unauthorized_repair_caused_current_failure=True), "repeat_failure_after_repairs": dict(days_since_purchase=400, prior_repair_count=2, same_failure_recurrence=True),
        "warranty_expired": dict(days_since_purchase=400), "extended_damage_covered": dict(failure_type="liquid_damage", extended_coverage=True), "accidental_or_liquid_not_covered": dict(failure_type="accidental_damage"),
        "manufacturing_defect_supported": {}, "diagnostic_evidence_missing": dict(has_diagnostic_evidence=False), "normal_wear_excluded": dict(failure_type="normal_wear"), "failure_type_unclear": dict(failure_type="unknown"),
    },
    "expense": {
        "duplicate_claim": dict(is_duplicate_claim=True), "evidence_conflict": dict(evidence_conflict=True), "receipt_amount_mismatch": dict(receipt_matches_amount=False), "receipt_missing": dict(has_receipt=False, receipt_matches_amount=False),
        "business_purpose_missing": dict(business_purpose_present=False), "project_code_invalid": dict(project_code_valid=False), "high_value_expense": dict(amount="5000.00"), "high_value_foreign_currency": dict(amount="300.00", currency="USD"),
        "personal_expense": dict(is_personal_expense=True), "late_submission": dict(days_since_expense=31), "exception_manager_approval_missing": dict(days_since_expense=31, policy_exception_documented=True),
        "documented_policy_exception": dict(days_since_expense=31, policy_exception_documented=True, manager_approved=True), "cap_override_approved": dict(amount="300.01", manager_approved=True), "category_cap_exceeded": dict(amount="300.01"), "standard_compliant": {},
    },
}
SPLITS = {"train": 600, "validation": 64, "discovery_eval": 64, "confirmation": 64}
SEGMENTS = [("stage1", {"full": 510, "partial": 90}), ("stage2", {"full": 120, "partial": 330, "minimal": 150}), ("stage3", {"partial": 120, "minimal": 270, "no_skill": 210})]
CONDITIONS = ["full", "partial", "minimal", "no_skill", "no_system", "irrelevant", "paraphrase_a", "paraphrase_b"]
ENDPOINTS = ["random_mix_order", "staged_order"]


def _ddl(skill: str) -> str:
    kinds = {bool: "boolean", int: "int", str: "string"}
    return ", ".join(f"{k} {kinds[type(v)]}" for k, v in BASE[skill].items())


def skill_cases(spark: SparkSession, skill: str, splits: Mapping[str, int] = SPLITS) -> DataFrame:
    """Cases of all splits of a skill: prototypes in turn, decided, hashed, never twice the same facts.

    Prototypes are literal rows joined by number; a neutral fact that no rule reads at its value
    (an amount below all limits) tells cases of one prototype apart.
    """
    codes = list(CASES[skill])
    protos = spark.createDataFrame([(i, code, *({**BASE[skill], **CASES[skill][code]}).values()) for i, code in enumerate(codes)], f"_p int, wanted string, {_ddl(skill)}")
    upto, rows = 0, []
    for split, count in splits.items():
        rows.append((split, upto, upto + count - 1))
        upto += count
    slots = spark.createDataFrame(rows, "split string, low int, high int").select("split", F.explode(F.sequence("low", "high")).alias("slot"))
    cases = slots.withColumn("_p", (F.col("slot") % len(codes)).cast("int")).join(F.broadcast(protos), "_p").drop("_p").withColumn("_turn", F.floor(F.col("slot") / len(codes)).cast("int"))
    if skill == "refund":
        cases = cases.withColumn("order_amount_cny", F.when(F.col("order_amount_cny") < 1000, F.col("order_amount_cny") + F.col("_turn")).otherwise(F.col("order_amount_cny") + F.col("_turn")))
    elif skill == "warranty":
        cases = cases.withColumn("claim_amount_cny", F.col("claim_amount_cny") + F.col("_turn"))
    else:
        cases = cases.withColumn("amount", (F.col("amount").cast("decimal(18,2)") + F.col("_turn") * F.lit("0.01").cast("decimal(4,2)")).cast("string"))
    decided = rules.decide(cases.drop("_turn"), skill)
    checked = decided.withColumn("code", F.when(F.col("code") == F.col("wanted"), F.col("code")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("prototype of"), "wanted", F.lit("gave"), "code"))))
    facts = facts_json(list(BASE[skill]))
    return checked.select(F.concat_ws("_", F.lit(skill), "split", "slot").alias("case_id"), F.lit(skill).alias("skill_id"), "split", "slot", facts.alias("fields"), "decision", "risk_level", "need_human", "code", F.sha2(facts, 256).alias("facts_hash"), F.sha2(F.concat(F.lit(f"{skill}|"), facts), 256).alias("semantic_case_hash"))


def training_arms(cases: DataFrame, version: str = "v1") -> DataFrame:
    """1,800 records a skill: three segments over its 600 training cases, exposures by exact quota, and
    positions of the same records in the staged and in the mixed order."""
    train = cases.where("split = 'train'")
    out = None
    for k, (segment, quotas) in enumerate(SEGMENTS):
        placed = layout.ranked(train, [layout.hash_key("exposure", F.lit(segment), F.col("semantic_case_hash")), F.col("semantic_case_hash")], ["skill_id"], "_place")
        part = placed.withColumn("segment_id", F.lit(segment)).withColumn("_segment", F.lit(k)).withColumn("prompt_exposure", layout.quota_value(F.col("_place"), list(quotas.items())))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("record_id", layout.hash_key(version, F.col("skill_id"), F.col("semantic_case_hash"), F.col("segment_id"), F.col("prompt_exposure"))).drop("_place")
    staged = layout.ranked(out, [F.col("_segment"), layout.hash_key("within", F.col("record_id")), F.col("record_id")], ["skill_id"], "staged_position")
    return layout.ranked(staged, [layout.hash_key("mix", F.col("record_id")), F.col("record_id")], ["skill_id"], "mixed_position").drop("_segment")


def eval_requests(cases: DataFrame, split: str = "discovery_eval") -> DataFrame:
    """1,024 requests a skill: 64 cases under 8 conditions at 2 endpoints."""
    spark = cases.sparkSession
    dim = F.broadcast(spark.createDataFrame([(c, e) for c in CONDITIONS for e in ENDPOINTS], "prompt_condition string, endpoint string"))
    rows = cases.where(F.col("split") == split).crossJoin(dim)
    return rows.withColumn("pairing_key", F.concat_ws("|", "skill_id", "semantic_case_hash", "prompt_condition", "endpoint"))


#: Factor settings by condition; the last condition has all three, in the user's message. Two conditions are among those of eval_requests.
FACTORS = ["identity", "schema", "business_rules"]
SETTINGS = {f"isb_{i}{s}{b}": (bool(i), bool(s), bool(b)) for i in (1, 0) for s in (1, 0) for b in (1, 0)}
PLACED, BRIDGES = "isb_111_user_placement", ["isb_111", "isb_110"]


def _factorial(cases: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """cases under conditions at both endpoints, with factor levels, placement, messages and their hashes. An empty system text is
    left out; the placed condition has one message, prompt and facts."""
    spark = cases.sparkSession
    rows = [(c, *SETTINGS.get(c, (None,) * 3), e) for c in conditions for e in ENDPOINTS]
    dim = F.broadcast(spark.createDataFrame(rows, f"condition string, {', '.join(f'{f} boolean' for f in FACTORS)}, endpoint string"))
    placed = F.col("condition") == PLACED
    levels = F.when(~placed, F.struct(*FACTORS))
    parts = [("identity", F.concat(F.lit("You decide cases of "), F.col("skill_id"))), ("schema", F.lit("Answer as JSON")), ("business_rules", F.lit("Apply the rules in order"))]
    everything = F.concat_ws("\n", *(text for _, text in parts))
    built = F.when(placed, M.build(None, F.concat(everything, F.lit("\n\n"), F.col("fields")))).otherwise(M.build(M.composed(parts, F.struct(*FACTORS)), F.col("fields")))
    out = cases.crossJoin(dim).withColumns({"factor_levels": levels, "messages": built, "placement": F.when(placed, "user").otherwise("system"), "pairing_key": F.concat_ws("|", "skill_id", "semantic_case_hash", "condition", "endpoint")})
    return out.drop(*FACTORS).withColumns({"record_id": F.sha2("pairing_key", 256), "messages_sha256": F.sha2(F.to_json("messages"), 256)})


def _only(cases: DataFrame, split: str, count: int | None) -> DataFrame:
    """cases, which must all be of one split and count a skill."""
    per = cases.groupBy("skill_id").agg(F.count("*").alias("n"), F.bool_and(F.col("split") == split).alias("own")).collect()
    if strange := [r["skill_id"] for r in per if not r["own"]]:
        raise PermissionError(f"{strange}: cases of another split than {split}")
    if wrong := {r["skill_id"]: r["n"] for r in per if count is not None and r["n"] != count}:
        raise ValueError(f"{count} cases a skill are asked for, not {wrong}")
    return cases


def factorial_requests(cases: DataFrame, split: str = "discovery_eval", count: int | None = 64) -> DataFrame:
    """1,152 requests a skill: 64 cases of a split, the eight settings of three components and all of them placed in the user's
    message, at 2 endpoints. count None takes any number of cases."""
    return _factorial(_only(cases.where(F.col("split") == split), split, count), [*SETTINGS, PLACED])


def smoke_requests(cases: DataFrame, count: int | None = 2) -> DataFrame:
    """Requests of exactly two validation cases a skill under the conditions that no earlier request has; raises PermissionError
    if any case is of another split."""
    new = [c for c in [*SETTINGS, PLACED] if c not in BRIDGES]
    return _factorial(_only(cases, "validation", count), new).withColumn("split", F.lit("validation_smoke"))


def bundle_errors(cases: DataFrame, arms: DataFrame, requests: DataFrame, splits: Mapping[str, int] = SPLITS) -> DataFrame:
    """(check, detail): everything a bundle violates; empty if it is sound."""
    spark = cases.sparkSession
    expected = spark.createDataFrame(list(splits.items()), "split string, expected int")
    skills = cases.select("skill_id").distinct()
    counts = cases.groupBy("skill_id", "split").agg(F.count("*").alias("n"))
    quota = skills.crossJoin(F.broadcast(expected)).join(counts, ["skill_id", "split"], "left").where("NOT n <=> expected").select(F.lit("split_count").alias("check"), F.concat_ws("|", "skill_id", "split").alias("detail"))
    shared = cases.groupBy("semantic_case_hash").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("split_overlap"), "semantic_case_hash")
    doubled = arms.groupBy("record_id").count().where("count > 1").select(F.lit("duplicate_record"), "record_id")
    want = spark.createDataFrame([(s, e, n) for s, q in SEGMENTS for e, n in q.items()], "segment_id string, prompt_exposure string, expected bigint")
    have = arms.groupBy("skill_id", "segment_id", "prompt_exposure").agg(F.count("*").alias("n"))
    mixes = skills.crossJoin(F.broadcast(want)).join(have, ["skill_id", "segment_id", "prompt_exposure"], "full").where("NOT n <=> expected").select(F.lit("exposure_count"), F.concat_ws("|", "skill_id", "segment_id", "prompt_exposure"))
    per = requests.groupBy("skill_id", "semantic_case_hash").agg(F.count("*").alias("n"), F.count_distinct("pairing_key").alias("d")).where(f"n <> {len(CONDITIONS) * len(ENDPOINTS)} OR d <> n").select(F.lit("request_cells"), "semantic_case_hash")
    return quota.union(shared).union(doubled).union(mixes).union(per)


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def enumerated(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """df with a 1-based position within the columns by."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
