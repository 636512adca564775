"""First-match rule engines, compiled to one CASE expression.

An engine is an ordered list of rules (predicate, decision, reason code). Predicates are SQL
boolean expressions over the fact columns; compile() folds the list into a lazily evaluated
CASE, so a decision is one projection without shuffles or Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import requests

HIGH_VALUE = 1000
FREQUENT_REFUNDS = 3


class Rule(NamedTuple):
    when: str
    decision: str
    code: str


#: Risk level and human review of each decision.
CONTRACT = {
    "approve": ("low", False),
    "approve_with_conditions": ("medium", False),
    "request_more_evidence": ("medium", False),
    "reject": ("low", False),
    "manual_review": ("high", True),
}

RETURNABLE = "(NOT is_used AND is_resellable AND product_type <> 'virtual')"

REFUND_PILOT = [
    Rule("days_since_delivery IS NULL OR order_status = 'unknown'", "request_more_evidence", "missing_required_facts"),
    Rule("evidence_conflict", "manual_review", "evidence_conflict"),
    Rule("order_info_conflict", "manual_review", "order_info_conflict"),
    Rule(f"order_amount_cny >= {HIGH_VALUE}", "manual_review", "high_value_order"),
    Rule(f"refund_count_30d >= {FREQUENT_REFUNDS}", "manual_review", "frequent_refund_user"),
    Rule("logistics_issue AND (seller_fault OR has_evidence)", "approve", "logistics_issue_supported"),
    Rule("logistics_issue", "request_more_evidence", "logistics_issue_insufficient_evidence"),
    Rule("has_quality_issue AND NOT has_evidence", "request_more_evidence", "quality_issue_no_evidence"),
    Rule(f"has_quality_issue AND {RETURNABLE}", "approve_with_conditions", "quality_issue_return_refund"),
    Rule("has_quality_issue", "approve", "quality_issue_refund_only"),
    Rule("product_type IN ('fresh', 'customized', 'virtual') AND user_claim IN ('no_reason', 'size_not_fit', 'exchange')", "reject", "special_goods_exclusion"),
    Rule(f"days_since_delivery <= 7 AND {RETURNABLE}", "approve_with_conditions", "within_7_days_unused"),
    Rule("days_since_delivery <= 7", "reject", "used_or_not_resellable"),
    Rule("true", "reject", "over_7_days_no_quality_issue"),
]

WARRANTY = [
    Rule("safety_recall", "approve_with_conditions", "safety_recall"),
    Rule("evidence_conflict", "manual_review", "evidence_conflict"),
    Rule("serial_status = 'mismatch'", "manual_review", "serial_mismatch"),
    Rule("serial_status = 'missing'", "request_more_evidence", "serial_missing"),
    Rule("NOT has_purchase_proof", "request_more_evidence", "purchase_proof_missing"),
    Rule("NOT failure_description_present", "request_more_evidence", "failure_description_missing"),
    Rule("claim_amount_cny >= 3000", "manual_review", "abnormal_claim_amount"),
    Rule("unauthorized_repair_caused_current_failure", "reject", "unauthorized_repair_causal"),
    Rule("days_since_purchase > warranty_days AND prior_repair_count >= 2 AND same_failure_recurrence", "manual_review", "repeat_failure_after_repairs"),
    Rule("days_since_purchase > warranty_days", "reject", "warranty_expired"),
    Rule("failure_type IN ('accidental_damage', 'liquid_damage') AND extended_coverage", "approve_with_conditions", "extended_damage_covered"),
    Rule("failure_type IN ('accidental_damage', 'liquid_damage')", "reject", "accidental_or_liquid_not_covered"),
    Rule("failure_type = 'manufacturing_defect' AND has_diagnostic_evidence", "approve", "manufacturing_defect_supported"),
    Rule("failure_type = 'manufacturing_defect'", "request_more_evidence", "diagnostic_evidence_missing"),
    Rule("failure_type = 'normal_wear'", "reject", "normal_wear_excluded"),
    Rule("true", "request_more_evidence", "failure_type_unclear"),
]

#: Exchange rates to CNY and category caps in CNY; a hotel's cap is per night.
RATES = {"CNY": "1", "USD": "7.20", "EUR": "7.80", "JPY": "0.048", "GBP": "9.10", "HKD": "0.92"}
CAPS = {"meal": 300, "local_transport": 500, "office_supply": 1000, "training": 3000}
HOTEL_NIGHT = 1200

EXCEPTION = "(is_personal_expense OR days_since_expense > 30)"
EXPENSE = [
    Rule("is_duplicate_claim", "manual_review", "duplicate_claim"),
    Rule("evidence_conflict", "manual_review", "evidence_conflict"),
    Rule("has_receipt AND NOT receipt_matches_amount", "manual_review", "receipt_amount_mismatch"),
    Rule("NOT has_receipt", "request_more_evidence", "receipt_missing"),
    Rule("NOT business_purpose_present", "request_more_evidence", "business_purpose_missing"),
    Rule("NOT project_code_valid", "request_more_evidence", "project_code_invalid"),
    Rule("currency = 'CNY' AND amount_cny >= 5000", "manual_review", "high_value_expense"),
    Rule("currency <> 'CNY' AND amount_cny >= 2000", "manual_review", "high_value_foreign_currency"),
    Rule("is_personal_expense AND NOT policy_exception_documented", "reject", "personal_expense"),
    Rule("days_since_expense > 30 AND NOT policy_exception_documented", "reject", "late_submission"),
    Rule(f"{EXCEPTION} AND NOT manager_approved", "request_more_evidence", "exception_manager_approval_missing"),
    Rule(EXCEPTION, "approve_with_conditions", "documented_policy_exception"),
    Rule("amount_cny > cap_cny AND manager_approved", "approve_with_conditions", "cap_override_approved"),
    Rule("amount_cny > cap_cny", "reject", "category_cap_exceeded"),
    Rule("true", "approve", "standard_compliant"),
]

ENGINES = {"refund": REFUND_PILOT, "warranty": WARRANTY, "expense": EXPENSE}


def compile_rules(rules: list[Rule]) -> Column:
    """struct(decision, risk_level, need_human, code) of the first rule that holds."""
    chain = None
    for rule in rules:
        risk, human = CONTRACT[rule.decision]
        if rule.code == "safety_recall":
            risk, human = "high", True
        outcome = F.struct(F.lit(rule.decision).alias("decision"), F.lit(risk).alias("risk_level"), F.lit(human).alias("need_human"), F.lit(rule.code).alias("code"))
        chain = F.when(F.expr(rule.when), outcome) if chain is None else chain.when(F.expr(rule.when), outcome)
    return chain


def decide(facts: DataFrame, engine: str) -> DataFrame:
    """facts with decision, risk_level, need_human and code of a named engine."""
    if engine == "expense":
        facts = with_expense_amounts(facts)
    return facts.withColumn("_result", compile_rules(ENGINES[engine])).select("*", "_result.*").drop("_result")


def decide_by_key(facts: DataFrame, key: str = "skill_id") -> DataFrame:
    """Engine dispatch: every row is decided by the engine that its key names."""
    chain = None
    for name, rules in ENGINES.items():
        chain = F.when(F.col(key) == name, compile_rules(rules)) if chain is None else chain.when(F.col(key) == name, compile_rules(rules))
    return facts.withColumn("_result", chain).select("*", "_result.*").drop("_result")


def with_expense_amounts(facts: DataFrame) -> DataFrame:
    """facts with amount_cny (rounded half up to cents) and cap_cny."""
    rates = F.create_map(*[F.lit(x) for pair in ((k, v) for k, v in RATES.items()) for x in pair])
    caps = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    rate = F.try_element_at(rates, F.col("currency")).try_cast("decimal(10,3)")
    amount = F.round(F.col("amount").try_cast("decimal(18,2)") * rate, 2).cast("decimal(18,2)")
    cap = F.when(F.col("expense_category") == "hotel", HOTEL_NIGHT * F.col("hotel_nights")).otherwise(F.try_element_at(caps, F.col("expense_category")))
    return facts.withColumn("amount_cny", amount).withColumn("cap_cny", cap.cast("decimal(18,2)"))


# The first refund engine: intent, a base decision, and a risk overlay with several reason codes.

_TRUE = "('1', 'true', 'yes', 'y')"


def normalised(facts: DataFrame) -> DataFrame:
    """Refund facts from columns of any type: text counts as true if it spells one of the accepted
    words, unreadable numbers are 0 (days: null), and the derived product flags are filled in."""
    out = facts
    have = dict(facts.dtypes)
    for name in ("is_used", "is_resellable", "has_quality_issue", "has_evidence", "is_customized", "is_virtual", "is_fresh", "seller_fault", "logistics_issue", "evidence_conflict", "order_info_conflict"):
        if name not in have:
            out = out.withColumn(name, F.lit(False))
        elif have[name] == "string":
            out = out.withColumn(name, F.coalesce(F.expr(f"lower(trim({name})) IN {_TRUE}"), F.lit(False)))
        else:
            out = out.withColumn(name, F.coalesce(F.col(name).cast("boolean"), F.lit(False)))
    for name in ("order_amount", "refund_count_30d"):
        out = out.withColumn(name, F.coalesce(F.col(name).try_cast("int"), F.lit(0)) if name in have else F.lit(0))
    out = out.withColumn("days_since_delivery", F.col("days_since_delivery").try_cast("int") if "days_since_delivery" in have else F.lit(None).cast("int"))
    for name, value in (("product_type", "virtual"), ("product_type", "customized"), ("product_type", "fresh")):
        out = out.withColumn(f"is_{value}", F.col(f"is_{value}") | F.coalesce(F.col(name) == value, F.lit(False)))
    return out


INTENTS = {
    "exchange": "exchange_request",
    "complaint": "complaint",
    "strong_complaint": "complaint",
    "size_not_fit": "return_refund_request",
    "no_reason": "return_refund_request",
}

REFUND_BASE = [
    Rule("logistics_issue AND (seller_fault OR has_evidence)", "allow_refund", "logistics_issue"),
    Rule("logistics_issue", "request_more_evidence", "logistics_issue"),
    Rule("has_quality_issue AND NOT has_evidence", "request_more_evidence", "quality_issue_no_evidence"),
    Rule("has_quality_issue AND (is_virtual OR is_used OR NOT is_resellable)", "allow_refund", "quality_issue_with_evidence"),
    Rule("has_quality_issue", "allow_return_refund", "quality_issue_with_evidence"),
    Rule("is_virtual", "deny", "virtual_goods_denied"),
    Rule("is_fresh", "deny", "fresh_goods_no_reason_denied"),
    Rule("is_customized", "deny", "customized_goods_no_reason_denied"),
    Rule("days_since_delivery <= 7 AND NOT is_used AND is_resellable AND intent = 'exchange_request'", "allow_exchange", "within_7_days_unused"),
    Rule("days_since_delivery <= 7 AND NOT is_used AND is_resellable", "allow_return_refund", "within_7_days_unused"),
    Rule("days_since_delivery <= 7", "deny", "used_or_not_resellable"),
    Rule("true", "deny", "over_7_days_no_quality_issue"),
]

MISSING = "(days_since_delivery IS NULL OR order_status IS NULL OR order_status NOT IN ('delivered', 'not_delivered', 'closed'))"


def refund_base() -> Column:
    """struct(decision, code) of the first base rule that holds; needs intent."""
    chain = None
    for rule in REFUND_BASE:
        outcome = F.struct(F.lit(rule.decision).alias("decision"), F.lit(rule.code).alias("code"))
        chain = F.when(F.expr(rule.when), outcome) if chain is None else chain.when(F.expr(rule.when), outcome)
    return chain


def explain_refund(facts: DataFrame) -> DataFrame:
    """decide_refund with explanation, the reason in words."""
    return requests.explained(decide_refund(facts), refund_base(), MISSING)


def decide_refund(facts: DataFrame) -> DataFrame:
    """facts with intent, decision, risk_level, need_human and reason_codes of the first refund engine.

    Missing facts come before any risk; a risk turns whatever the base decision was into a manual
    review and keeps its reason code in front.
    """
    intents = F.create_map(*[F.lit(x) for pair in INTENTS.items() for x in pair])
    out = facts.withColumn("intent", F.coalesce(F.try_element_at(intents, F.col("user_claim")), F.lit("refund_request")))
    order_conflict = F.expr("order_info_conflict OR (coalesce(user_claim, '') = 'claims_unused_but_used' AND is_used)")
    risks = F.array_compact(F.array(
        F.when(F.col("evidence_conflict"), "evidence_conflict"),
        F.when(order_conflict, "order_info_conflict"),
        F.when(F.col("order_amount") >= HIGH_VALUE, "high_value_order"),
        F.when(F.col("refund_count_30d") >= FREQUENT_REFUNDS, "frequent_refund_user"),
    ))
    out = out.withColumn("_base", refund_base()).withColumn("_risks", risks).withColumn("_missing", F.expr(MISSING))
    risky = F.size("_risks") > 0
    severe = F.arrays_overlap("_risks", F.array(F.lit("evidence_conflict"), F.lit("order_info_conflict"))) | (F.size("_risks") >= 2)
    asks = F.col("_missing") | (~risky & (F.col("_base.decision") == "request_more_evidence"))
    human = ~F.col("_missing") & risky
    return out.select(
        *facts.columns,
        "intent",
        F.when(F.col("_missing"), "request_more_evidence").when(risky, "manual_review").otherwise(F.col("_base.decision")).alias("decision"),
        F.when(asks, "medium").when(~risky, "low").when(severe, "high").otherwise("medium").alias("risk_level"),
        human.alias("need_human"),
        F.when(F.col("_missing"), F.array(F.lit("manual_review_required")))
        .when(risky, F.array_distinct(F.concat(F.array("_base.code"), "_risks", F.array(F.lit("manual_review_required")))))
        .otherwise(F.array("_base.code")).alias("reason_codes"),
    )


#: What a row of facts must satisfy: (violation, predicate of a sound row).
DOMAINS = {
    "refund": [
        ("product_type", "product_type IN ('standard', 'fresh', 'customized', 'virtual')"),
        ("order_status", "order_status IN ('delivered', 'not_delivered', 'closed', 'unknown')"),
        ("days_negative", "days_since_delivery IS NULL OR days_since_delivery >= 0"),
        ("virtual_resellable", "product_type <> 'virtual' OR NOT is_resellable"),
        ("unknown_with_days", "order_status <> 'unknown' OR days_since_delivery IS NULL"),
        ("known_without_days", "order_status NOT IN ('delivered', 'closed') OR days_since_delivery IS NOT NULL"),
        ("not_delivered_facts", "order_status <> 'not_delivered' OR (coalesce(days_since_delivery, -1) = 0 AND logistics_issue)"),
        ("seller_fault_without_logistics", "NOT seller_fault OR logistics_issue"),
    ],
    "warranty": [
        ("product_category", "product_category IN ('electronics', 'appliance', 'tool', 'other')"),
        ("failure_type", "failure_type IN ('manufacturing_defect', 'accidental_damage', 'liquid_damage', 'normal_wear', 'unknown')"),
        ("serial_status", "serial_status IN ('missing', 'match', 'mismatch')"),
        ("negative_number", "days_since_purchase >= 0 AND warranty_days >= 0 AND prior_repair_count >= 0"),
        ("cause_without_repair", "NOT unauthorized_repair_caused_current_failure OR unauthorized_repair"),
        ("recurrence_without_repair", "NOT same_failure_recurrence OR prior_repair_count >= 1"),
    ],
    "expense": [
        ("expense_category", "expense_category IN ('meal', 'local_transport', 'office_supply', 'training', 'hotel')"),
        ("currency", "currency IN ('CNY', 'USD', 'EUR', 'JPY', 'GBP', 'HKD')"),
        ("hotel_nights", "if(expense_category = 'hotel', hotel_nights >= 1, hotel_nights = 0)"),
        ("days_negative", "days_since_expense >= 0"),
        ("receipt_match_without_receipt", "has_receipt OR NOT receipt_matches_amount"),
        ("amount", "coalesce(try_cast(amount as decimal(38,18)) > 0 AND try_cast(amount as decimal(38,18)) = round(try_cast(amount as decimal(38,18)), 2), false)"),
    ],
}


def violations(facts: DataFrame, engine: str) -> DataFrame:
    """facts with the array of violated domain constraints, in order."""
    tests = [F.when(~F.coalesce(F.expr(sound), F.lit(False)), name) for name, sound in DOMAINS[engine]]
    return facts.withColumn("violations", F.array_compact(F.array(*tests)))


def require_keys(df: DataFrame, expected: list[str]) -> None:
    """Closed key set: raises unless the columns are exactly the expected ones."""
    missing, unexpected = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    if missing or unexpected:
        raise ValueError(f"missing {missing}, unexpected {unexpected}")


def recheck(cases: DataFrame, engine: str) -> DataFrame:
    """Rows whose stored decision or reason code differs from what the engine decides now."""
    now = decide(cases.withColumnsRenamed({"decision": "stored_decision", "code": "stored_code"}).drop("risk_level", "need_human"), engine)
    return now.where(~(F.col("decision").eqNullSafe(F.col("stored_decision")) & F.col("code").eqNullSafe(F.col("stored_code"))))
